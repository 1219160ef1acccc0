"""Exact substring deduplication: bytes covered by a long enough string that starts elsewhere too.

A suffix array of everything would need a tuple per byte, many times the input.  Only sampled suffixes
are sorted here: in each text, every run of windows (strings of the given length) shares one anchor, the
least hashed short string in them.  Equal windows have equal anchors at equal offsets, so

1. suffix tuples (anchor, whole stretch of the run) meet in Spark's shuffle; stretches that occur twice
   are repeated as a whole: their common prefix is at least the stretch;
2. the induction step goes back to single positions only where an anchor is shared but stretches differ,
   which is at the ends of repeats: short runs of windows whose common bytes are unique are settled at
   once, and of the rest each window by its own hash.

All decisions are about hashes of whole strings; nothing is dropped, capped or sampled away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import CHUNK_BYTES, Chunk, Rolling, ranges
from tableprep.session import written

LENGTH = 200  # bytes of a string that counts as repeated
ANCHOR = 80  # bytes of an anchor
STEP = 16  # windows in a short run
BROADCAST_KEYS = 1_000_000


class Anchors:
    """The runs of windows of a chunk's texts: their anchors, extents and hashes."""

    def __init__(self, chunk: Chunk, length: int, width: int):
        self.chunk, self.length = chunk, length
        data = chunk.data
        self.hashes = Rolling(data)
        lengths = chunk.lengths
        usable = np.flatnonzero(lengths >= length)
        counts = lengths[usable] - length + 1
        self.first = np.zeros(0, np.int64)
        if not len(usable):
            return
        # the least anchor hash in each window, by doubling; the place breaks ties and comes back with it
        n = len(data) - width + 1
        short = self.hashes.of(np.arange(n), np.arange(n) + width)
        best = (short & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
        span, reach = length - width + 1, 1
        while 2 * reach <= span:
            best = np.minimum(best[: len(best) - reach], best[reach:])
            reach *= 2
        if reach < span:
            best = np.minimum(best[: len(best) - (span - reach)], best[span - reach :])
        owner = np.repeat(usable, counts)
        at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + chunk.starts[owner]
        anchor = best[at] & np.uint64(0xFFFFFFFF)
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
        begin = np.flatnonzero(fresh)
        end = np.concatenate([begin[1:], [len(at)]]) - 1
        self.owner, self.first, self.last = owner[begin], at[begin], at[end]
        self.anchor = anchor[begin].astype(np.int64)
        self.gram = short[self.anchor]
        self.extent = self.hashes.of(self.first, self.last + length)
        self.weight = np.ones(len(self.first), dtype=np.int32)
        self.join_equal()

    def join_equal(self) -> None:
        """Neighbouring runs of equal content (a repeated character, say) become one that repeats itself."""
        again = np.zeros(len(self.first), dtype=bool)
        again[1:] = (self.extent[1:] == self.extent[:-1]) & (self.owner[1:] == self.owner[:-1])
        begin = np.flatnonzero(~again)
        end = np.concatenate([begin[1:], [len(again)]]) - 1
        self.last = self.last[end]
        self.weight = np.minimum(end - begin + 1, 2).astype(np.int32)
        kept = (self.owner, self.first, self.anchor, self.gram, self.extent)
        self.owner, self.first, self.anchor, self.gram, self.extent = (x[begin] for x in kept)


def suffix_tuples(keyed: DataFrame, length: int, width: int) -> DataFrame:
    """``gram, extent, weight, key, first, last, anchor`` of every run; places count from the start of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, chunk in sliced_chunks(batch.column(1)):
                runs = Anchors(chunk, length, width)
                if len(runs.first):
                    start = chunk.starts[runs.owner]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(runs.gram.view(np.int64)), pa.array(runs.extent.view(np.int64)), pa.array(runs.weight),
                         pa.array(keys[i:j][runs.owner]), pa.array((runs.first - start).astype(np.int32)),
                         pa.array((runs.last - start).astype(np.int32)), pa.array((runs.anchor - start).astype(np.int32))],
                        names=["gram", "extent", "weight", "key", "first", "last", "anchor"],
                    )

    schema = "gram long, extent long, weight int, key long, first int, last int, anchor int"
    return keyed.select("key", "text").mapInArrow(run, schema)


def sliced_chunks(column: pa.Array) -> Iterator[tuple[int, int, Chunk]]:
    """Chunks of a column of texts; only one chunk's texts are copied at a time."""
    texts = column.cast(pa.binary())
    for i, j in ranges(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), CHUNK_BYTES):
        yield i, j, Chunk(texts.slice(i, j - i).to_pylist())


def with_lists(keyed: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts that have a list, with it; only their texts are shuffled as long as the keys fit a broadcast."""
    keys = lists.select("key")
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    chosen = keyed.join(F.broadcast(keys), "key", "left_semi") if few else keyed
    return chosen.join(lists, "key")


class Listed:
    """The runs listed for the texts of a chunk, flat: owner, first, last and anchor within the chunk."""

    def __init__(self, runs: pa.ListArray, chunk: Chunk):
        flat = runs.flatten()
        names = [f.name for f in flat.type]
        self.owner = np.repeat(np.arange(len(runs)), np.diff(runs.offsets.to_numpy()))
        start = chunk.starts[self.owner]
        place = lambda c: flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) + start
        self.first, self.last = place("first"), place("last")
        self.anchor = place("anchor") if "anchor" in names else self.first


def stretched(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts 2, 3: items 0 0 1 1 1 and steps 0 1 0 1 2."""
    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def over_lists(asked: DataFrame, schema: str, hashes) -> DataFrame:
    """Apply ``hashes(listed, chunk)`` to texts with their lists; it returns owners and one array per column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, chunk in sliced_chunks(batch.column(1)):
                owner, columns = hashes(Listed(batch.column(2).slice(i, j - i), chunk), chunk)
                if len(owner):
                    made = {"key": pa.array(keys[i:j][owner]), **{k: pa.array(v) for k, v in columns.items()}}
                    yield pa.RecordBatch.from_arrays(list(made.values()), names=list(made))

    return asked.select("key", "text", "runs").mapInArrow(run, schema)


def core_hashes(asked: DataFrame, length: int) -> DataFrame:
    """``key, core, first, last`` of short runs: windows whose distances to the anchor agree but for a remainder.

    The core is what all windows of such a short run share; it lies alike in equal windows elsewhere.
    """
    step = max(1, min(STEP, length // 4))

    def hashes(listed, chunk):
        low, high = (listed.anchor - listed.last) // step, (listed.anchor - listed.first) // step
        item, more = stretched(high - low + 1)
        end = listed.anchor[item] - (low[item] + more) * step  # the last window of the short run
        core = Rolling(chunk.data).of(end, end - step + 1 + length)
        owner = listed.owner[item]
        start = chunk.starts[owner]
        first, last = np.maximum(listed.first[item], end - step + 1), np.minimum(listed.last[item], end)
        return owner, {"core": core.view(np.int64), "first": (first - start).astype(np.int32), "last": (last - start).astype(np.int32)}

    return over_lists(asked, "key long, core long, first int, last int", hashes)


def window_hashes(asked: DataFrame, length: int) -> DataFrame:
    """``key, window, at`` of every window in the listed runs."""

    def hashes(listed, chunk):
        item, more = stretched(listed.last - listed.first + 1)
        at = listed.first[item] + more
        owner = listed.owner[item]
        window = Rolling(chunk.data).of(at, at + length)
        return owner, {"window": window.view(np.int64), "at": (at - chunk.starts[owner]).astype(np.int32)}

    return over_lists(asked, "key long, window long, at int", hashes)


def listed_runs(runs: DataFrame, *fields: str) -> DataFrame:
    """``key, runs``: the runs of each text, which bounds their number."""
    return written(runs.groupBy("key").agg(F.collect_list(F.struct(*fields)).alias("runs")), "runs")


def repeated_spans(keyed: DataFrame, length: int, width: int) -> DataFrame:
    """``key, spans``: ranges of bytes covered by repeated strings, for texts that have any."""
    tuples = suffix_tuples(keyed, length, width)
    # summed per task before the shuffle, so an anchor in common content is no hot key
    anchors = tuples.groupBy("gram").agg(F.sum("weight").alias("uses")).where("uses > 1").select("gram")
    active = written(tuples.join(written(anchors, "anchors"), "gram"), "active")
    # one place of each stretch speaks for all of its places
    one = F.min(F.struct("key", "first", "last", "anchor")).alias("one")
    stretches = written(active.groupBy("gram", "extent").agg(F.sum("weight").alias("uses"), one), "stretches")
    twice = stretches.where("uses > 1").select("gram", "extent")
    whole = active.join(twice, ["gram", "extent"]).select("key", F.col("first").alias("start"), (F.col("last") + length).alias("stop"))
    several = stretches.groupBy("gram").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("gram")
    unclear = stretches.join(several, "gram").select("one.*")
    cores = written(core_hashes(with_lists(keyed, listed_runs(unclear, "first", "last", "anchor")), length), "cores")
    open_cores = cores.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core")
    still = listed_runs(cores.join(open_cores, "core"), "first", "last")
    windows = written(window_hashes(with_lists(keyed, still), length), "windows")
    found = windows.groupBy("window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("window")
    single = windows.join(found, "window").select("key", F.col("at").alias("start"), (F.col("at") + length).alias("stop"))
    spans = F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans")  # of one text, bounded by it
    return whole.unionAll(single).groupBy("key").agg(spans)


def cut(text: bytes, spans: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of a text, and the maximal removed runs."""
    runs: list[list[int]] = []
    for span in spans:
        if runs and span["start"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], span["stop"])
        else:
            runs.append([span["start"], span["stop"]])
    kept, free = [], 0
    for start, stop in runs:
        kept.append(text[free:start])
        free = stop
    return b"".join([*kept, text[free:]]), [(a, b) for a, b in runs]


def cut_texts(keyed: DataFrame, spans: DataFrame) -> DataFrame:
    """``key, n_removed, n_spans, kept`` of the texts that have spans: what is left of them, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for i, j in ranges(pc.binary_length(texts).to_pylist()):
                some = texts.slice(i, j - i).to_pylist()
                done = [cut(text, listed.as_py()) for text, listed in zip(some, batch.column(2).slice(i, j - i))]
                removed = [sum(b - a for a, b in runs) for _, runs in done]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(removed, pa.int64()),
                     pa.array([len(runs) for _, runs in done], pa.int64()), pa.array([kept for kept, _ in done], pa.binary())],
                    names=["key", "n_removed", "n_spans", "kept"],
                )

    listed = with_lists(keyed, spans).select("key", "text", "spans")
    return listed.mapInArrow(run, "key long, n_removed long, n_spans long, kept binary")


def keyed_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, key``: rows that agree in id and text share a key, and have the same repeats."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64("doc_id", text).alias("key"))


def repeat_report(docs: DataFrame, length: int = LENGTH, width: int = ANCHOR) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document.

    Every byte covered by a ``length``-byte string that starts anywhere else, in the same text or
    another, is removed.  Null texts are empty; repeated rows are repeats of each other; texts shorter
    than ``length`` are left alone; very long texts are worked on alone.  Other columns are not read.
    """
    keyed = keyed_texts(docs)
    spans = written(repeated_spans(keyed.select("key", "text"), length, width), "spans")
    changed = cut_texts(keyed.select("key", "text"), spans).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")
    changed = written(changed.dropDuplicates(["key"]), "changed")
    plain = keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    return plain.join(changed, "key", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
    )
