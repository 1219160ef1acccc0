"""Alignment of two tokenizers' tokens over the same text, and corpus-wide counts of linked ids.

Tokenizer A (byte-level BPE of the tokenizers library) reads a space and the text, tokenizer B
(sentencepiece) reads the text and adds that space itself.  A text is cut before every space or line end
that follows other characters; tokens of neither side reach over such a place, so every distinct chunk is
aligned once per task's table and documents are put together from their chunks.

Within chunks the libraries' own spans are the coarse cuts: character offsets of A, byte spans of B.  Where
a token ends inside a character (an A token of some bytes of it, a B token of byte fallback) the spans only
name the whole character; there the decoded bytes say where the token ends.  All work of a chunk is done
for many chunks at once, on arrays of token ends.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import ranges
from tableprep.session import scratch_scope, written

MARK = "▁"
TABLE_CHUNKS = 400_000  # a task's table starts anew beyond so many chunks
TABLE_CHARACTERS = 8 << 20  # or so many characters of chunks
JOINED = 512  # chunks handed to a library as one string
FIRST = " a"  # stands in front of every such string, so that its first chunk is one like others
PIECE = 1 << 19  # texts are worked on in pieces of about so many bytes; a longer one in segments
HOT_PAIRS = 1 << 20  # id pairs whose counts are broadcast, 16 bytes each; the rarer ones are joined
TASK_PAIRS = 1 << 20  # id pairs a counting task holds before it hands them on

CHUNKS = re.compile(r"\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
CUT = re.compile(r"\S[ \n]")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in entries of byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """Bytes of every id of a vocabulary, and its decimal ids with each separator behind."""

    def __init__(self, entries: list[bytes], last: str):
        self.bytes = entries
        self.lengths = np.array([len(b) for b in entries], dtype=np.int64)
        self.shown = np.array([[f"{i}," for i in range(len(entries))], [f"{i}{last}" for i in range(len(entries))]], dtype=object)

    def spells(self, ids: list[int], data: bytes) -> bool:
        return b"".join(map(self.bytes.__getitem__, ids)) == data

    def ends(self, ids: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Byte ends of tokens from coarse byte spans: inside a character, by the decoded bytes."""
        sure = np.ones(len(ids), dtype=bool)
        sure[:-1] = (stops[:-1] <= starts[1:]) & (stops[:-1] > starts[:-1])
        if sure.all():
            return stops
        spelt = np.cumsum(self.lengths[ids])
        last = np.maximum.accumulate(np.where(sure, np.arange(len(ids)), -1))
        base = np.where(last >= 0, stops[last] - spelt[last], 0)
        return np.where(sure, stops, spelt + base)


class Aligner:
    """A table of aligned chunks, filled as texts need it."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        letters = byte_letters()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.left = Side([bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries], "|")
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.check(pieces)
        spelt = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)
        ]
        self.right = Side(spelt, ";")
        self.n_b = len(pieces)
        self.kind = np.uint32 if len(entries) * self.n_b <= 1 << 32 else np.uint64
        self.clear()

    def check(self, pieces: list[str]) -> None:
        crossing = [p for p in pieces if not re.fullmatch(f"{MARK}*[^{MARK}\n]*", p)]
        if crossing:
            raise ValueError(f"pieces cross space markers or line ends, so chunks are not independent: {crossing[:3]}")
        if self.b.normalize("Åﬁ ①\n  x") != f"{MARK}Åﬁ{MARK}①\n{MARK}{MARK}x":
            raise ValueError("the model normalises texts; chunks need one that only marks spaces")

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.shown: list[str] = []
        self.characters = 0
        self.counts = np.zeros((5, 1 << 14), dtype=np.int64)  # tokens of A and of B, groups, links; 1 if spelt right
        self.ends = np.zeros(1 << 14, dtype=np.int64)
        self.links = np.zeros(1 << 16, dtype=self.kind)

    @staticmethod
    def cut(text: str) -> list[str]:
        """Keys of the chunks of a text that begins with a space or a line end.

        A key is the chunk, without its first space unless another space or a line end comes next.
        """
        if text[1:].replace("\n", " ").split(" ") == text.split():
            return text.replace("\n", " \n")[1:].split(" ")
        return [c if c[0] == "\n" or c[1:2] in (" ", "\n") and c[1:2] else c[1:] for c in CHUNKS.findall(text)]

    def slots_of(self, cut: list[list[str]]) -> np.ndarray:
        if len(self.slots) > TABLE_CHUNKS or self.characters > TABLE_CHARACTERS:
            self.clear()
        flat = list(chain.from_iterable(cut))
        new = dict.fromkeys(flat).keys() - self.slots.keys()
        if new:
            self.add(list(new))
        return np.array(list(map(self.slots.__getitem__, flat)), dtype=np.int64)

    def add(self, keys: list[str]) -> None:
        chunks = [k if k[:1] in (" ", "\n") and k else " " + k for k in keys]
        last = [i for i, c in enumerate(chunks) if c[-1].isspace()]  # nothing may follow in their string
        others = sorted(set(range(len(chunks))) - set(last)) if last else range(len(chunks))
        strings = [list(others[at : at + JOINED]) for at in range(0, len(others), JOINED)] + [[i] for i in last]
        for at in range(0, len(strings), 64):
            self.align(keys, chunks, strings[at : at + 64])

    def align(self, keys: list[str], chunks: list[str], strings: list[list[int]]) -> None:
        """Align the chunks of some strings and put them into the table."""
        texts = ["".join([FIRST, *[chunks[i] for i in s]]) for s in strings]
        of_a = self.a.encode_batch(texts, add_special_tokens=False)
        of_b = self.b.encode([t[1:] for t in texts], return_type="offset_mapping", return_bytes=True, num_threads=1)
        members: list[int] = []  # the chunk of each piece of the joined bytes; -1 for what stands in front
        sizes: list[int] = []
        a_ids, a_ends, b_ids, b_ends, base = [], [], [], [], 0
        for string, text, a, b in zip(strings, texts, of_a, of_b):
            data, ids = text.encode(), a.ids
            if not (self.left.spells(ids, data) and self.right.spells(b["ids"], data)):
                if len(string) == 1:
                    self.put([keys[string[0]]], np.zeros((5, 1), dtype=np.int64), [""], np.zeros(0, dtype=self.kind))
                else:
                    self.align(keys, chunks, [[i] for i in string])
                continue
            ids, spans = np.array(ids, dtype=np.int64), spans_of(a.offsets)
            plain = len(data) == len(text)
            if not plain:
                points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
                width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
                spans = np.concatenate([[0], np.cumsum(width)])[spans]
            a_ids.append(ids)
            a_ends.append(base + self.left.ends(ids, spans[:, 0], spans[:, 1]))
            ids, spans = np.array(b["ids"], dtype=np.int64), spans_of(b["offsets"]) + 1
            spans[0, 0] = 0
            b_ids.append(ids)
            b_ends.append(base + self.right.ends(ids, spans[:, 0], spans[:, 1]))
            members.append(-1)
            members += string
            sizes.append(len(FIRST))
            sizes += [len(chunks[i]) if plain else len(chunks[i].encode()) for i in string]
            base += len(data)
        if members:
            joined = [np.concatenate(x) for x in (a_ids, a_ends, b_ids, b_ends)]
            self.store(keys, np.array(members), np.cumsum(sizes), *joined)

    def store(self, keys, members, stops, a_ids, a_ends, b_ids, b_ends) -> None:
        both = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
        again = both[1:] == both[:-1]
        cuts = both[1:][again]  # where a token of each side ends
        edges = both[np.concatenate([[True], ~again])]  # each stretch between two edges is the overlap of one A and one B token
        links = a_ids[np.searchsorted(a_ends, edges)] * self.n_b + b_ids[np.searchsorted(b_ends, edges)]
        through = [np.searchsorted(x, stops, side="right") for x in (a_ends, b_ends, cuts, edges)]
        if len(stops) and not (cuts[through[2] - 1] == stops).all():
            raise ValueError("a token reaches over the end of a chunk")
        in_a, in_b = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        shown = np.empty(len(a_ids) + len(b_ids), dtype=object)
        at_a = np.arange(len(a_ids)) + np.searchsorted(in_b, in_a, side="left")
        at_b = np.arange(len(b_ids)) + np.searchsorted(in_a, in_b, side="right")
        shown[at_a] = self.left.shown[(cuts[in_a] == a_ends).astype(np.int8), a_ids]
        shown[at_b] = self.right.shown[(cuts[in_b] == b_ends).astype(np.int8), b_ids]
        parts = shown.tolist()
        before = [np.concatenate([[0], x[:-1]]) for x in through]
        counts = np.array([t - s for s, t in zip(before, through)] + [np.ones(len(stops), dtype=np.int64)])
        kept = np.flatnonzero(members >= 0)
        lo, hi = (before[0] + before[1])[kept].tolist(), (through[0] + through[1])[kept].tolist()
        texts = ["".join(parts[i:j]) for i, j in zip(lo, hi)]
        names = [keys[m] for m in members[kept].tolist()]
        self.put(names, counts[:, kept], texts, links[np.repeat(members >= 0, counts[3])].astype(self.kind))

    def put(self, keys: list[str], counts: np.ndarray, shown: list[str], links: np.ndarray) -> None:
        """Add chunks with their counts, the texts of their groups and all their links one after the other."""
        n, k = len(self.shown), len(keys)
        while n + k > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)], axis=1)
        start = int(self.ends[n - 1]) if n else 0
        while start + len(links) > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        self.links[start : start + len(links)] = links
        self.ends[n : n + k] = start + np.cumsum(counts[3])
        self.counts[:, n : n + k] = counts
        self.shown += shown
        self.slots.update(zip(keys, range(n, n + k)))
        self.characters += sum(map(len, keys))

    def links_of(self, slots: np.ndarray) -> np.ndarray:
        ends = self.ends[slots]
        counts = self.counts[3][slots]
        after = np.cumsum(counts)
        total = int(after[-1]) if len(after) else 0
        return self.links[np.arange(total) + np.repeat(ends - after, counts)]

    def parts(self, texts: list[bytes | None]) -> Iterator[tuple]:
        """(row, part, tokens of A, of B, groups, links, text of the groups, linked id pairs) of each text.

        A text of several parts has a row for each; its texts of groups are to be joined by ``;``.  What
        is spelt differently by a tokenizer gives one part of zeros.
        """
        nothing = (0, 0, 0, 0, "", np.zeros(0, dtype=self.kind))
        for i, j in ranges([len(t or b"") for t in texts], PIECE):
            whole = [decoded(t) for t in texts[i:j]]
            if j == i + 1 and len(texts[i] or b"") > PIECE and whole[0]:
                if all(self.spelt(self.slots_of([self.cut(s)])) for s in segments(whole[0])):
                    for part, segment in enumerate(segments(whole[0])):
                        keys = self.cut(segment)
                        yield (i, part, *self.made(self.slots_of([keys])))
                else:
                    yield (i, 0, *nothing)
                continue
            cut = [self.cut(" " + t) if t else [] for t in whole]
            slots, at = self.slots_of(cut), 0
            for k, keys in enumerate(cut):
                own = slots[at : at + len(keys)]
                at += len(keys)
                yield (i + k, 0, *(self.made(own) if len(own) and self.spelt(own) else nothing))

    def spelt(self, slots: np.ndarray) -> bool:
        return bool(self.counts[4][slots].all())

    def made(self, slots: np.ndarray) -> tuple:
        counts = self.counts[:4, slots].sum(axis=1).tolist()
        return (*counts, "".join(map(self.shown.__getitem__, slots.tolist()))[:-1], self.links_of(slots))


def spans_of(offsets: list[tuple[int, int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(offsets), dtype=np.int64, count=2 * len(offsets)).reshape(-1, 2)


def decoded(text: bytes | None) -> str:
    try:
        return (text or b"").decode()
    except UnicodeDecodeError:  # no tokenizer can spell it
        return ""


def segments(text: str, size: int = PIECE) -> Iterator[str]:
    """A space and the text, cut where chunks begin, in segments of at least ``size`` characters but the last."""
    start, lead = 0, " "
    while start < len(text):
        cut = CUT.search(text, start + size)
        stop = cut.start() + 1 if cut else len(text)
        yield lead + text[start:stop]
        start, lead = stop, ""


@lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


PARTS = "n_a long, n_b long, n_groups long, n_links long, groups string, groups_sha256 string, links binary"


def align_tokens(docs: DataFrame, a: str, b: str, key: str = "doc_id", text: str = "text", groups: bool = True) -> DataFrame:
    """Token groups and linked id pairs of every text.

    ``a`` is a byte-level tokenizer file, ``b`` a sentencepiece model, both on paths every executor has.
    Returns ``row`` (one number per row of ``docs``, also for repeated ones), ``key``, ``part``, the counts
    of tokens, groups and links, ``groups`` (``a1,a2|b1;a3|b2,b3``, ids in order), ``groups_sha256`` and
    ``links``: pair numbers (A id times the number of B ids plus B id) as little-endian integers of 4 bytes
    (8 for vocabularies whose pairs need them).  A text above half a megabyte has several parts, each with
    its own groups; the last one's ``groups_sha256`` is that of all (null before).  Without ``groups`` the
    column is null and only the digest is kept.  A null or empty text, and one that a tokenizer spells in
    other bytes (a space marker in it), has one part of zeros and an empty digest.  A stretch without
    spaces and line ends is one chunk, however long.  Other columns of ``docs`` are left out.
    """
    schema = f"row long, {docs.select(key).schema[0].name} {docs.schema[key].dataType.simpleString()}, part int, {PARTS}"
    frame = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`"), F.col(f"`{text}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for i, j in ranges(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 8 * PIECE):
                for rows in pieces(aligner(a, b).parts(texts.slice(i, j - i).to_pylist())):
                    yield made(batch.slice(i, j - i), rows)

    def pieces(parts: Iterator[tuple]) -> Iterator[list[tuple]]:
        """Runs of parts with digests, cut so that none holds many links."""
        rows: list[tuple] = []
        held, state = 0, hashlib.sha256()
        last = None
        for part in parts:
            if last is not None:
                rows.append(closed(last, state, part[1] > 0))
                held += len(last[7])
                if part[1] == 0:
                    state = hashlib.sha256()
            if held > 4 * PIECE:
                yield rows
                rows, held = [], 0
            last = part
        if last is not None:
            rows.append(closed(last, state, False))
        if rows:
            yield rows

    def closed(part: tuple, state, goes_on: bool) -> tuple:
        if part[1]:
            state.update(b";")
        state.update(part[6].encode())
        digest = None if goes_on else state.hexdigest() if part[2] else ""
        return (*part[:6], part[6] if groups else None, digest, part[7].astype(part[7].dtype.newbyteorder("<")).tobytes())

    def made(batch: pa.RecordBatch, rows: list[tuple]) -> pa.RecordBatch:
        index, *columns = zip(*rows)
        taken = batch.select([0, 1]).take(pa.array(index, pa.int64()))
        kinds = [pa.int32(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.binary()]
        arrays = [*taken.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]]
        return pa.RecordBatch.from_arrays(arrays, names=["row", key, "part", *PARTS.replace(",", "").split()[::2]])

    return frame.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame, kind: str) -> DataFrame:
    """How often each pair of ids is linked, over all ``links``: counted per task, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh: list[np.ndarray] = []
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for links in batch.column(0):
                fresh.append(np.frombuffer(links.as_buffer(), dtype=kind))
                size += len(fresh[-1])
                if size > TASK_PAIRS:
                    counted = [summed([*counted, np.unique(np.concatenate(fresh), return_counts=True)])]
                    fresh, size = [], 0
                    if len(counted[0][0]) > TASK_PAIRS // 2:
                        yield as_batch(counted.pop())
        if fresh or counted:
            last = np.concatenate([*fresh, np.zeros(0, dtype=kind)])
            yield as_batch(summed([*counted, np.unique(last, return_counts=True)]))

    def summed(counted):
        pairs = np.concatenate([p for p, _ in counted])
        order = np.argsort(pairs, kind="stable")
        pairs, n = pairs[order], np.concatenate([n for _, n in counted])[order]
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.zeros(0, np.int64)
        return pairs[first], np.add.reduceat(n, first) if len(first) else n

    def as_batch(counted) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in counted], names=["pair", "n"])

    return aligned.select("links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def least_hot(pairs: DataFrame, most: int) -> int:
    """The least count from which on at most ``most`` pairs are counted so often."""
    step = F.floor(F.log2("n") * 8).cast("int")
    bins = pairs.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.max("n").alias("top")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for i, bin_ in enumerate(bins):
        total += bin_["pairs"]
        if total > most:
            return (least or bins[0]["top"] + 1) if i == 0 else bins[i]["top"] + 1
        least = bin_["top"]
    return 0


SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def alignment_report(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per document: tokens, groups and links, how many links are their B id's commonest, and their counts' sum.

    Counts of pairs are over all of ``docs``.  Those of the ``HOT_PAIRS`` commonest pairs (a bound proven
    by a histogram of counts) are broadcast; links of rarer pairs are joined by shuffle, where no pair has
    more rows than the least broadcast count.  One row per row of ``docs``; an empty table gives none.
    """
    spark = docs.sparkSession
    with scratch_scope(spark) as keep:
        aligned = written(align_tokens(docs, a, b, groups=False).drop("groups"), "aligned")
        tool = aligner(a, b)
        kind, n_b = np.dtype(tool.kind).newbyteorder("<").str, tool.n_b
        pairs = written(pair_counts(aligned, kind), "pairs")
        top = pairs.groupBy((F.col("pair") % n_b).alias("b")).agg(F.max("n").alias("top"))
        tops = top.toArrow().to_pydict()  # one row per B id at most
        best = np.zeros(n_b, dtype=np.int64)
        best[np.array(tops["b"], dtype=np.int64)] = tops["top"]
        least = least_hot(pairs, HOT_PAIRS)
        hot = pairs.where(F.col("n") >= least).toArrow()
        codes, counts = hot["pair"].to_numpy().astype(tool.kind), hot["n"].to_numpy()
        order = np.argsort(codes)
        shared = spark.sparkContext.broadcast((codes[order], counts[order], best))
        sums = written(aligned.mapInArrow(summing(shared, kind, n_b), SUMMED), "sums")
        rare = sums.select("row", F.explode("rare").alias("rare")).select("row", "rare.pair", "rare.uses")
        cold = pairs.where(F.col("n") < least).withColumn("b", F.col("pair") % n_b).join(F.broadcast(top), "b")
        late = rare.join(cold, "pair").select(
            "row",
            *[F.lit(0).cast("long").alias(c) for c in SUMS[:4]],
            F.when(F.col("n") == F.col("top"), F.col("uses")).otherwise(0).cast("long").alias("n_best"),
            (F.col("n") * F.col("uses")).alias("count_sum"),
        )
        both = sums.drop("rare").unionByName(late, allowMissingColumns=True)
        made = both.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in SUMS], F.max("groups_sha256").alias("groups_sha256")
        )
        result = keep(written(made.drop("row"), "alignment"))
        shared.unpersist()
    return result


SUMMED = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
    "groups_sha256 string, rare array<struct<pair:long,uses:long>>"
)


def summing(shared, kind: str, n_b: int):
    """Counts of each part's links from the broadcast table; pairs that it lacks are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, best = shared.value
        for batch in batches:
            n_best, count_sum, rare = [], [], []
            for links in batch.column("links"):
                pairs = np.sort(np.frombuffer(links.as_buffer(), dtype=kind))  # sorted needles are found faster
                at = np.searchsorted(codes, pairs)
                at[at == len(codes)] = 0
                found = codes[at] == pairs if len(codes) else np.zeros(len(pairs), dtype=bool)
                n = counts[at[found]] if len(codes) else np.zeros(0, dtype=np.int64)
                n_best.append(int((n == best[pairs[found] % n_b]).sum()))
                count_sum.append(int(n.sum()))
                values, uses = np.unique(pairs[~found], return_counts=True)
                rare.append([{"pair": int(p), "uses": int(u)} for p, u in zip(values, uses)])
            columns = {c: batch.column(c) for c in ("row", "doc_id", "n_a", "n_b", "n_groups", "n_links")}
            columns |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
            columns["groups_sha256"] = batch.column("groups_sha256")
            columns["rare"] = pa.array(rare, pa.list_(pa.struct([("pair", pa.int64()), ("uses", pa.int64())])))
            yield pa.RecordBatch.from_pydict(columns)

    return run
