"""Benchmark decontamination with suffix arrays of the training texts.

Every shard (the texts of one chunk) gets a word-level suffix array.  All windows of the benchmark are
looked up in it at once by binary search; runs of windows on one diagonal make the longest verbatim
matches.  Benchmark tables above a bound are broadcast block by block, each block adding to the hits of
the blocks before it, so memory does not grow with either table and no text is ever shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import ALNUM, LOWER, Chunk, Rolling, annotate, blocks, chunks, sha
from tableprep.session import written

BLOCK_BYTES = 8 << 20  # benchmark text in one broadcast
SHARD_BYTES = 1 << 20  # training text in one suffix array

OUTPUTS = (
    "n_words long, hit_runs array<struct<start:int,stop:int>>, items array<string>, "
    "matches array<struct<item_id:string,item_start:int,doc_start:int,n_words:int>>"
)
#: While blocks are joined, matches also name the long item (a digest) that their span was cut from.
PARTS = OUTPUTS.replace("item_id:string,", "item_id:string,whole:string,")


class Probe:
    """The windows of one block of benchmark items, in the form that shards are searched with."""

    def __init__(self, items: list[tuple[tuple[str, str, int], str]], window: int):
        chunk = Chunk([(text or "").encode() for _, text in items])
        data = LOWER[chunk.data]
        starts, ends, owner = chunk.words(ALNUM)
        hashes = Rolling(data).of(starts, ends)
        self.window = window
        self.names = [name for name, _ in items]
        self.vocabulary, ids = np.unique(hashes, return_inverse=True)
        # the spelling behind each hash, for the exact check of a hit
        first = np.unique(hashes, return_index=True)[1]
        raw = data.tobytes()
        self.spelling = [raw[starts[i] : ends[i]] for i in first]
        self.bits = max(1, int(len(self.vocabulary)).bit_length())
        self.per_key = 64 // self.bits
        self.n_keys = -(-window // self.per_key)
        counts = np.bincount(owner, minlength=len(items)) if len(owner) else np.zeros(len(items), dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(counts)])
        where, lengths, item_of, offset = [], [], [], []
        for k, n in enumerate(counts):
            if n:
                here = np.arange(max(1, n - window + 1))
                where.append(begin[k] + here)
                lengths.append(np.full(len(here), min(n, window)))
                item_of.append(np.full(len(here), k))
                offset.append(here)
        join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
        where, lengths, self.item_of, self.offset = join(where), join(lengths), join(item_of), join(offset)
        padded = np.concatenate([ids.astype(np.int64) + 1, np.zeros(window + self.per_key, np.int64)])
        keys = self.pack(padded, where)
        self.masks = [self.mask(lengths, k) for k in range(self.n_keys)]
        keys = [key & mask for key, mask in zip(keys, self.masks)]
        rows = np.stack([*keys, lengths.astype(np.uint64)], axis=1) if len(where) else np.zeros((0, self.n_keys + 1), np.uint64)
        unique, self.window_of = np.unique(rows, axis=0, return_inverse=True)
        self.window_of = self.window_of.reshape(-1)
        self.lengths = unique[:, -1].astype(np.int64)
        self.keys = [unique[:, k].copy() for k in range(self.n_keys)]
        self.masks = [self.mask(self.lengths, k) for k in range(self.n_keys)]
        order = np.argsort(self.window_of, kind="stable")
        self.by_window = order
        self.first_of = np.searchsorted(self.window_of[order], np.arange(len(unique) + 1))

    def pack(self, ids: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Word ids from each position on, several to a 64-bit key whose order is the words' order."""
        keys = []
        for k in range(self.n_keys):
            key = np.zeros(len(at), dtype=np.uint64)
            for j in range(self.per_key):
                key = (key << np.uint64(self.bits)) | ids[at + k * self.per_key + j].astype(np.uint64)
            keys.append(key)
        return keys

    def mask(self, lengths: np.ndarray, k: int) -> np.ndarray:
        """Bits of key ``k`` that belong to a window of so many words."""
        inside = np.clip(lengths - k * self.per_key, 0, self.per_key)
        full = np.full(len(lengths), (1 << (self.bits * self.per_key)) - 1, dtype=np.uint64)
        low = (self.per_key - inside).astype(np.uint64) * np.uint64(self.bits)
        cleared = np.where(low >= 64, np.uint64(0), (full >> np.minimum(low, np.uint64(63))) << np.minimum(low, np.uint64(63)))
        return cleared

    def bounds(self, keys: list[np.ndarray], above: bool) -> np.ndarray:
        """Binary search of all windows at once: the first suffix not below (or above) each window."""
        low = np.zeros(len(self.lengths), dtype=np.int64)
        high = np.full(len(self.lengths), len(keys[0]), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) >> 1
            before = np.zeros(len(open_), dtype=bool)
            tied = np.ones(len(open_), dtype=bool)
            for key, wanted, mask in zip(keys, self.keys, self.masks):
                here, there = key[middle] & mask[open_], wanted[open_]
                before |= tied & (here < there)
                tied &= here == there
            before |= tied & above
            low[open_[before]] = middle[before] + 1
            high[open_[~before]] = middle[~before]

    def search(self, chunk: Chunk) -> tuple[np.ndarray, dict[int, tuple]]:
        """Words per text, and for texts with hits: hit runs, item names, matches."""
        data = LOWER[chunk.data]
        starts, ends, owner = chunk.words(ALNUM)
        n_words = np.bincount(owner, minlength=len(chunk.texts)) if len(owner) else np.zeros(len(chunk.texts), np.int64)
        if not len(starts) or not len(self.lengths):
            return n_words, {}
        hashes = Rolling(data).of(starts, ends)
        slot = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[slot] == hashes
        # one empty word behind each text keeps matches inside it
        place = np.arange(len(starts)) + owner
        ids = np.zeros(len(starts) + len(chunk.texts) + self.n_keys * self.per_key + 1, dtype=np.int64)
        ids[place[known]] = slot[known] + 1
        suffixes = np.flatnonzero(ids)
        if not len(suffixes):
            return n_words, {}
        keys = self.pack(ids, suffixes)
        order = np.lexsort(keys[::-1])
        suffixes, keys = suffixes[order], [key[order] for key in keys]
        first, last = self.bounds(keys, False), self.bounds(keys, True)
        found = np.flatnonzero(last > first)
        if not len(found):
            return n_words, {}
        counts = (last - first)[found]
        window = np.repeat(found, counts)
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = suffixes[np.repeat(first[found], counts) + step]
        # back from places with gaps to words
        gap_at = np.concatenate([[0], np.cumsum(n_words + 1)])
        text = np.searchsorted(gap_at, at, side="right") - 1
        word = at - text
        raw = data.tobytes()
        return n_words, self.report(chunk, text, word, window, starts, ends, raw, n_words, ids, place)

    def report(self, chunk, text, word, window, starts, ends, raw, n_words, ids, place) -> dict[int, tuple]:
        begin = np.concatenate([[0], np.cumsum(n_words)])
        order = np.argsort(text, kind="stable")
        cuts = np.searchsorted(text[order], np.arange(len(chunk.texts) + 1))
        result = {}
        for t in np.unique(text):
            mine = order[cuts[t] : cuts[t + 1]]
            hits = []
            for w, u in zip((word[mine] - begin[t]).tolist(), window[mine].tolist()):
                length = int(self.lengths[u])
                span = range(begin[t] + w, begin[t] + w + length)
                if all(raw[starts[i] : ends[i]] == self.spelling[ids[place[i]] - 1] for i in span):
                    hits.append((w, u, length))
            if hits:
                result[int(t)] = self.merge(hits)
        return result

    def merge(self, hits: list[tuple[int, int, int]]) -> tuple:
        """Hit runs, items, and the longest matches: windows that follow each other on one diagonal."""
        diagonals: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for w, u, length in hits:
            for row in self.by_window[self.first_of[u] : self.first_of[u + 1]].tolist():
                item, offset = int(self.item_of[row]), int(self.offset[row])
                diagonals.setdefault((item, w - offset), []).append((offset, length))
        matches = []
        for (item, shift), windows in diagonals.items():
            windows.sort()
            start, stop = windows[0][0], windows[0][0] + windows[0][1]
            previous = windows[0][0]
            for offset, length in windows[1:]:
                if offset != previous + 1:
                    matches.append((self.names[item], start, start + shift, stop - start))
                    start = offset
                previous, stop = offset, offset + length
            matches.append((self.names[item], start, start + shift, stop - start))
        runs = join_runs([(w, w + length) for w, _, length in hits])
        return runs, sorted({m[0] for m in matches}), sorted(matches, key=lambda m: (m[2], m[0], m[1]))


def join_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching ranges as their union."""
    joined: list[list[int]] = []
    for start, stop in sorted(runs):
        if joined and start <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], stop)
        else:
            joined.append([start, stop])
    return [tuple(r) for r in joined]


def spans(text: bytes, window: int, bound: int) -> list[tuple[int, str]]:
    """A text as spans of about ``bound`` bytes and at least a window, each with the number of its first word.

    Neighbours share ``window`` - 1 words, so that every window lies in one span.
    """
    starts, ends, _ = Chunk([text]).words(ALNUM)
    n, i, made = len(starts), 0, []
    while True:
        j = min(n, max(i + window, int(np.searchsorted(ends, starts[i] + bound, side="right")))) if n else 0
        made.append((i, text[starts[i] : ends[j - 1]].decode("utf-8", "replace") if n else ""))
        if j == n:
            return made
        i = j - window + 1


def benchmark_spans(items: DataFrame, window: int, bound: int) -> DataFrame:
    """``item_id, whole, first, text`` of all different items; long ones as overlapping spans of words."""
    items = items.select("item_id", "text").distinct()

    def cut(texts):
        made = [spans(t, window, bound) for t in texts]
        return [[sha(t) for t in texts], [[{"first": i, "span": s} for i, s in m] for m in made]]

    fits = F.octet_length("text") <= bound
    short = items.where(fits).select("item_id", F.lit("").alias("whole"), F.lit(0).alias("first"), "text")
    long = annotate(items.where(~fits), "text", "whole string, spans array<struct<first:int,span:string>>", cut)
    long = long.select("item_id", "whole", F.explode("spans").alias("s"))
    return short.unionAll(long.select("item_id", "whole", "s.first", F.col("s.span").alias("text")))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``n_words, hit_runs, items, matches``.

    A window is ``window`` consecutive words of an item, or a whole shorter item.  ``hit_runs`` are
    ranges of word numbers inside occurrences, ``matches`` the longest verbatim matches with their
    places.  Null or empty texts have no words and no hits; items without words never occur; an item
    without an id is named ``null``; rows of one item_id count as one item; repeated documents are
    judged one by one; very long texts are shards of their own.  Repeated benchmark rows count once,
    and items longer than a block are searched as spans.  Columns of ``docs`` named like a result
    column are replaced.
    """
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.col("text").alias("text")
    ).where("text IS NOT NULL")
    spark = docs.sparkSession
    result = None
    parts = written(benchmark_spans(items, window, BLOCK_BYTES), "benchmark")
    for rows in blocks(parts, "octet_length(text)", BLOCK_BYTES):
        named = [((r["item_id"], r["whole"], r["first"]), r["text"]) for r in rows]
        shared = spark.sparkContext.broadcast(Probe(named, window))

        def compute(texts, shared=shared):
            probe = shared.value
            out = [[], [], [], []]
            for _, _, chunk in chunks(texts, SHARD_BYTES):
                n_words, found = probe.search(chunk)
                out[0] += n_words.tolist()
                for k in range(len(chunk.texts)):
                    runs, names, matches = found.get(k, ((), (), ()))
                    out[1].append([{"start": a, "stop": b} for a, b in runs])
                    out[2].append(sorted({name for name, _, _ in names}))
                    out[3].append([
                        {"item_id": name, "whole": whole, "item_start": first + start, "doc_start": at, "n_words": n}
                        for (name, whole, first), start, at, n in matches
                    ])
            return out

        if result is None:
            result = annotate(docs, text, PARTS, compute)
            continue
        before = written(result, "contamination")
        names = {"hit_runs": "__runs", "items": "__items", "matches": "__matches"}
        more = annotate(before.withColumnsRenamed(names), text, PARTS, compute)
        result = more.withColumns({c: F.concat(F.col(c), F.col(p)) for c, p in names.items()}).drop(*names.values())
        result = result.withColumn("items", F.array_sort(F.array_distinct("items")))
        result = result.withColumn("hit_runs", joined_runs("hit_runs"))
    return result.withColumn("matches", joined_matches("matches", window))


def joined_matches(column: str, window: int):
    """Matches by place, those joined that were cut because their item was: the next window in the next span."""
    cut = (
        "m -> named_struct('item_id', m.item_id, 'whole', m.whole, 'shift', m.doc_start - m.item_start, "
        "'item_start', m.item_start, 'doc_start', m.doc_start, 'n_words', m.n_words)"
    )
    ordered = f"array_sort(transform(filter({column}, m -> m.whole <> ''), {cut}))"
    follows = (
        "element_at(ms, -1).item_id = m.item_id and element_at(ms, -1).whole = m.whole and element_at(ms, -1).shift = m.shift "
        f"and m.item_start = element_at(ms, -1).item_start + element_at(ms, -1).n_words - {window - 1}"
    )
    extended = (
        "named_struct('item_id', m.item_id, 'whole', m.whole, 'shift', m.shift, 'item_start', element_at(ms, -1).item_start, "
        "'doc_start', element_at(ms, -1).doc_start, 'n_words', m.item_start + m.n_words - element_at(ms, -1).item_start)"
    )
    kind = "array<struct<item_id:string,whole:string,shift:int,item_start:int,doc_start:int,n_words:int>>"
    joined = (
        f"aggregate({ordered}, cast(array() as {kind}), (ms, m) -> if(size(ms) > 0 and {follows}, "
        f"concat(slice(ms, 1, size(ms) - 1), array({extended})), concat(ms, array(m))))"
    )
    plain = "m -> named_struct('doc_start', m.doc_start, 'item_id', m.item_id, 'item_start', m.item_start, 'n_words', m.n_words)"
    ranked = f"array_sort(concat(transform(filter({column}, m -> m.whole = ''), {plain}), transform({joined}, {plain})))"
    final = "m -> named_struct('item_id', m.item_id, 'item_start', m.item_start, 'doc_start', m.doc_start, 'n_words', m.n_words)"
    return F.expr(f"transform({ranked}, {final})")


def joined_runs(column: str):
    """The union of ranges in an array column, as ranges in order."""
    return F.expr(
        f"aggregate(array_sort({column}), cast(array() as array<struct<start:int,stop:int>>), (runs, r) -> "
        "if(size(runs) > 0 and r.start <= element_at(runs, -1).stop, "
        "concat(slice(runs, 1, size(runs) - 1), array(named_struct('start', element_at(runs, -1).start, "
        "'stop', greatest(element_at(runs, -1).stop, r.stop)))), concat(runs, array(r))))"
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: words, hit words, items with occurring windows and their digest."""
    found = find_contamination(docs.select("doc_id", "text"), benchmark, window)
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(hit_runs, 0L, (n, r) -> n + r.stop - r.start)").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hit_runs") > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").alias("text"))
    found = find_contamination(packed, benchmark, window)
    return found.where(F.size("hit_runs") == 0).select("row.*")
