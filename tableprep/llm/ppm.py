"""Language-model scores by prediction by partial matching over byte contexts.

All contexts of up to three bytes of the training texts form the trie; Spark counts its leaves.  The
probability of a byte comes from the longest known context, with escapes (method C) to shorter ones and
exclusion of the symbols already ruled out.  Beside it stands a smoothed word unigram model.  Both
models' tables may outgrow a task: the trie is used in blocks by the last byte of the context, whose
size is bounded by the byte alphabet, and rare words are joined by shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import LOWER, NOT_SPACE, Chunk, Rolling, annotate, chunks
from tableprep.llm.language import fold
from tableprep.session import written

ORDER = 3
START, END = 0xFF, 0xFE  # bytes that UTF-8 never has: before a text, and its last symbol
SYMBOLS = 257
BLOCK_GRAMS = 4_000_000  # leaves of the trie broadcast at once, unless one last byte has more
COMMON_WORDS = 300_000  # words whose counts are broadcast
COMMON_LENGTH = 64  # in characters; longer words are joined

HEAD, TAIL = bytes([START] * ORDER), bytes([END])


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Every symbol with its context as one number (context bytes, then symbol), and symbols per text."""
    data = np.frombuffer(b"".join([HEAD + t + TAIL for t in texts]), dtype=np.uint8).astype(np.uint32)
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    packed = data.copy()
    for back in range(1, ORDER + 1):
        packed[back:] |= data[:-back] << np.uint32(8 * back)
    return packed[data != START], sizes


class Trie:
    """Counts of contexts of all orders, from counts of (context, symbol) of the highest order."""

    def __init__(self, leaves: np.ndarray, counts: np.ndarray, unigrams: np.ndarray):
        order = np.argsort(leaves)
        keys, values = leaves[order], counts[order].astype(np.float64)
        self.levels = []
        for n in range(ORDER, 0, -1):
            self.levels.append(self.level(keys, values))
            shorter, inverse = np.unique(keys & np.uint32((1 << (8 * n)) - 1), return_inverse=True)
            keys, values = shorter, np.bincount(inverse, weights=values, minlength=len(shorter))
        seen = np.flatnonzero(unigrams)  # of all contexts, not only of a block
        self.levels.append(self.level(seen.astype(np.uint32), unigrams[seen].astype(np.float64)))
        self.excluded = [self.ruled_out(n) for n in range(ORDER)]
        self.leaves = self.levels[0][0]
        self.logs = np.log(self.probability(self.leaves))

    @staticmethod
    def level(keys, values):
        contexts, first, kinds = np.unique(keys >> np.uint32(8), return_index=True, return_counts=True)
        totals = np.add.reduceat(values, first) if len(first) else np.zeros(0)
        return keys, values, contexts, totals, kinds.astype(np.float64)

    def ruled_out(self, n: int) -> np.ndarray:
        """Per context of level ``n``: the count, one order lower, of the symbols it has seen itself."""
        keys, _, contexts, _, _ = self.levels[n]
        below_keys, below_values = self.levels[n + 1][:2]
        bits = 8 * (ORDER - n)
        below = find(below_keys, below_values, keys & np.uint32((1 << bits) - 1))
        return np.bincount(np.searchsorted(contexts, keys >> np.uint32(8)), weights=below, minlength=len(contexts))

    def probability(self, wanted: np.ndarray) -> np.ndarray:
        p, escape = np.zeros(len(wanted)), np.ones(len(wanted))
        open_ = np.ones(len(wanted), dtype=bool)
        ruled_total, ruled_kinds = np.zeros(len(wanted)), np.zeros(len(wanted))
        for n, (keys, values, contexts, totals, kinds) in enumerate(self.levels):
            bits = 8 * (ORDER - n + 1)
            gram = wanted & np.uint32((1 << bits) - 1) if bits < 32 else wanted
            context = gram >> np.uint32(8)
            count = find(keys, values, gram)
            total = find(contexts, totals, context) - ruled_total
            kind = find(contexts, kinds, context) - ruled_kinds
            all_ = total + kind
            live = open_ & (all_ > 0) & (total > 0)
            found = live & (count > 0)
            p[found] = (escape * count / np.maximum(all_, 1))[found]
            open_ &= ~found
            on = live & ~found
            escape[on] *= (kind / np.maximum(all_, 1))[on]
            if n < ORDER:
                ruled_total = find(contexts, self.excluded[n], context)
                ruled_kinds = find(contexts, kinds, context)
        p[open_] = escape[open_] / (SYMBOLS - len(self.levels[-1][0]))
        return p

    def log_probability(self, wanted: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.leaves, wanted), max(len(self.leaves) - 1, 0))
        if not len(self.leaves):
            return np.log(self.probability(wanted))
        logs = self.logs[at]
        missing = np.flatnonzero(self.leaves[at] != wanted)
        if len(missing):
            unique, inverse = np.unique(wanted[missing], return_inverse=True)
            logs[missing] = np.log(self.probability(unique))[inverse]
        return logs


def find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def count_leaves(docs: DataFrame) -> DataFrame:
    """``gram, n``: symbols with their contexts over all texts, counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for i, j, chunk in chunks(texts, 2 << 20):
                keys, n = np.unique(grams(chunk.texts)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def count_words(docs: DataFrame) -> DataFrame:
    """``word, n`` over all texts, lower-cased A-Z, counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            for _, _, chunk in chunks(texts, 2 << 20):
                data = LOWER[chunk.data]
                starts, ends, _ = chunk.words(NOT_SPACE)
                _, first, n = np.unique(Rolling(data).of(starts, ends), return_index=True, return_counts=True)
                raw = data.tobytes()
                words = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(words, type=pa.string()), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Words:
    """Counts of the common words behind hashes of their spelling."""

    def __init__(self, words: list[str], counts: np.ndarray, complete: bool):
        chunk = Chunk([w.encode() for w in words])
        hashes = Rolling(chunk.data).of(chunk.starts, chunk.starts + chunk.lengths)
        order = np.argsort(hashes)
        self.hashes, self.logs, self.complete = hashes[order], np.log10(counts[order] + 1.0), complete

    def score(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[dict]]]:
        """Per text: words, known words, sum of log10(count + 1), words to look up elsewhere."""
        data, texts = LOWER[chunk.data], len(chunk.texts)
        starts, ends, owner = chunk.words(NOT_SPACE)
        hashes = Rolling(data).of(starts, ends)
        n_words = np.bincount(owner, minlength=texts)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            known = self.hashes[at] == hashes
            logs = np.where(known, self.logs[at], 0.0)
        else:
            known, logs = np.zeros(len(hashes), dtype=bool), np.zeros(len(hashes))
        rest: list[list[dict]] = [[] for _ in range(texts)]
        if not self.complete:
            raw = data.tobytes()
            for i in np.flatnonzero(~known).tolist():
                rest[owner[i]].append(raw[starts[i] : ends[i]].decode("utf-8", "replace"))
        return n_words, np.bincount(owner, known, texts).astype(np.int64), np.bincount(owner, logs, texts), rest


def trie_blocks(leaves: DataFrame) -> Iterator[tuple[set[int], Trie]]:
    """The trie by the last byte of the context: byte sets and what is needed for contexts ending in them."""
    last = F.shiftright("gram", 8).bitwiseAND(255)
    unigrams = np.zeros(256)
    for r in leaves.groupBy(F.col("gram").bitwiseAND(255).alias("s")).agg(F.sum("n").alias("n")).collect():
        unigrams[r["s"]] = r["n"]
    sizes = {r["b"]: r["count"] for r in leaves.groupBy(last.alias("b")).count().collect()}
    packs: list[tuple[list[int], int]] = [([], 0)]
    for b in range(256):
        size = sizes.get(b, 0)
        if packs[-1][0] and packs[-1][1] + size > BLOCK_GRAMS:
            packs.append(([], 0))
        packs[-1] = (packs[-1][0] + [b], packs[-1][1] + size)
    for members, _ in packs:
        kept = (leaves if len(packs) == 1 else leaves.where(last.isin(members))).select("gram", "n").toArrow()
        keys = kept["gram"].to_numpy().astype(np.uint32)
        yield set(members), Trie(keys, kept["n"].to_numpy(), unigrams)


def score_texts(docs: DataFrame, train: DataFrame) -> DataFrame:
    """All rows and columns of ``docs`` with ``n_tokens, n_known, train_tokens, base_score, score``.

    ``base_score`` is the word model's log10 probability, ``score`` that of the byte contexts, whole texts
    with their end each.  Null and empty texts are just their end.  Without training texts every word is
    unknown and every symbol equally likely.  Repeated rows are scored one by one, and train as often as
    they occur.  Columns of ``docs`` named like a result column are replaced.
    """
    spark = docs.sparkSession
    texts = train.select(F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = written(count_words(texts), "words")
    leaves = written(count_leaves(texts), "contexts")
    n_train = texts.count()
    row = vocabulary.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    tokens, kinds = (row["n"] or 0) + n_train, row["v"] + (n_train > 0)
    common = vocabulary.where(F.length("word") <= COMMON_LENGTH).orderBy(F.desc("n"), "word").limit(COMMON_WORDS)
    top = common.toArrow()
    words = Words(top["word"].to_pylist(), top["n"].to_numpy(), complete=len(top) == row["v"])
    shared_words = spark.sparkContext.broadcast(words)
    per_token, end_log = np.log10(tokens + kinds + 1.0), np.log10(n_train + 1.0)
    results = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "__rest", "__row"]
    own = [c for c in docs.columns if c.lower() not in results]
    scored = None
    for members, trie in trie_blocks(leaves):
        mine = np.zeros(256, dtype=bool)
        mine[list(members)] = True
        shared_trie, first = spark.sparkContext.broadcast(trie), scored is None

        def compute(batch, shared_trie=shared_trie, mine=mine, first=first):
            out: list[list] = [[], [], [], [], []]
            for _, _, chunk in chunks(batch):
                wanted, sizes = grams(chunk.texts)
                logs = np.zeros(len(wanted))
                at = np.flatnonzero(mine[(wanted >> np.uint32(8)) & np.uint32(255)])
                logs[at] = shared_trie.value.log_probability(wanted[at])
                out[0] += (np.add.reduceat(logs, np.cumsum(sizes) - sizes) / np.log(10)).tolist()
                if first:
                    n_words, known, base, rest = shared_words.value.score(chunk)
                    out[1] += (n_words + 1).tolist()
                    out[2] += (known + (n_train > 0)).tolist()
                    out[3] += (base + end_log - (n_words + 1) * per_token).tolist()
                    out[4] += rest
            return out if first else out[:1]

        if scored is None:
            outputs = "score double, n_tokens long, n_known long, base_score double, __rest array<string>"
            scored = annotate(docs.select(*[F.col(f"`{c}`") for c in own]), "text", outputs, compute)
        else:
            before = written(scored, "scored").withColumnRenamed("score", "__score")
            scored = annotate(before, "text", "score double", compute).withColumn("score", F.col("score") + F.col("__score"))
            scored = scored.drop("__score")
    scored = scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
    return with_rare_words(scored, vocabulary) if not words.complete else scored.drop("__rest")


def with_rare_words(scored: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add what words beyond the common ones contribute, by a join on the word."""
    rows = written(scored.withColumn("__row", F.monotonically_increasing_id()), "rare")
    uses = rows.select("__row", F.explode("__rest").alias("word")).groupBy("__row", "word").agg(F.count(F.lit(1)).alias("uses"))
    found = uses.join(vocabulary, "word").groupBy("__row").agg(
        F.sum("uses").alias("__known"), F.sum(F.col("uses") * F.log10(F.col("n") + 1)).alias("__log")
    )
    joined = rows.join(found, "__row", "left")
    more = lambda c: F.coalesce(c, F.lit(0))
    return joined.withColumns(
        {"n_known": F.col("n_known") + more("__known"), "base_score": F.col("base_score") + more("__log")}
    ).drop("__row", "__rest", "__known", "__log")


def score_report(docs: DataFrame) -> DataFrame:
    """Scores of all documents by models of those outside the held-out fold."""
    own = docs.select("doc_id", "text", (fold("doc_id", 7) == 2).alias("held_out"))
    scored = score_texts(own, own.where(~F.col("held_out")))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
