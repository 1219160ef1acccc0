"""Importance resampling towards a target: hashed n-gram counts, log ratios, a weighted draw without putting back.

A 256-byte table lower-cases a text and blanks its separators, ``bytes.split`` yields its words.  The CRC-32
of a word seeds that of the two words it begins, so n-grams are extended without being written out; Counters
reduce the codes of a run of words.  Only bucket counts of the corpus and of the target (a vector each) pass
through the driver.  The draw orders all scores by ranges, so that no task sees more than its range.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.llm.words import per_text, word_runs
from tableprep.session import scratch_scope, written

WORDS = 2  # words of the longest feature
BUCKETS = 10_000
LEAST_WORDS = 20  # shorter documents are not drawn
SHARE = 25  # per cent of the documents long enough
SEED = 7
HELD_CODES = 1 << 17  # codes a counting task holds before it folds them into buckets


def gram_runs(text: bytes | None, most: int) -> Iterator[tuple[int, Counter]]:
    """For each run of a text's words: how many they are, and the CRC-32 codes of the n-grams that end in it."""
    before: list[bytes] = []
    for run in word_runs(text):
        words, old = before + run, len(before)
        codes = list(map(crc32, words))
        counts = Counter(codes[old:])
        for k in range(1, most):
            codes = list(map(crc32, words[k:], map(crc32, repeat(b" "), codes)))
            counts.update(codes[max(0, old - k) :])
        yield len(run), counts
        before = words[-(most - 1) :] if most > 1 else []


def in_buckets(counts: Counter, buckets: int) -> np.ndarray:
    codes = np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))
    weights = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    return np.bincount(codes % buckets, weights=weights, minlength=buckets).astype(np.int64)


def bucket_counts(docs: DataFrame, words: int = WORDS, buckets: int = BUCKETS, text: str = "text") -> list[int]:
    """How many features of all texts fall into each bucket: one vector per task, summed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros(buckets, dtype=np.int64), Counter()
        for batch in batches:
            for value in batch.column(0).cast(pa.binary()):
                for _, counts in gram_runs(value.as_py(), words):
                    held.update(counts)
                    if len(held) > HELD_CODES:
                        total += in_buckets(held, buckets)
                        held.clear()
        total += in_buckets(held, buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = docs.select(F.col(f"`{text}`")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    vector = [0] * buckets
    for bucket, n in counted.collect():  # one row per bucket at most
        vector[bucket] = n
    return vector


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of each bucket's smoothed share in the target and in the source, floored."""
    n, s_all, t_all = len(source), sum(source), sum(target)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source, target)]


def importance_weights(docs: DataFrame, gains: list[int], words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, words, features and the floored mean gain of every row; a text without words has weight 0."""
    shared = docs.sparkSession.sparkContext.broadcast(np.array(gains, dtype=np.int64))

    def compute(texts):
        gain = shared.value
        made: tuple[list[int], ...] = ([], [], [])
        for text in texts:
            n_words = n_features = total = 0
            for n, counts in gram_runs(text, words):
                n_words += n
                n_features += counts.total()
                total += int(in_buckets(counts, len(gain)) @ gain) if len(counts) > len(gain) else summed(counts, gain)
            for column, value in zip(made, (n_words, n_features, total // n_features if n_features else 0)):
                column.append(value)
        return list(made)

    return per_text(docs, [key], text, "n_words long, n_features long, weight long", compute)


def summed(counts: Counter, gain: np.ndarray) -> int:
    codes = np.fromiter(counts.keys(), dtype=np.int64, count=len(counts))
    return int(gain[codes % len(gain)] @ np.fromiter(counts.values(), dtype=np.int64, count=len(counts)))


def resampling_report(
    docs: DataFrame,
    target: DataFrame,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    words: int = WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """Per document: features, weight, score, and its rank if it is drawn.

    ``score`` is the weight plus a Gumbel draw that depends on ``seed`` and ``doc_id`` alone, in thousandths;
    of the documents with ``least_words`` words the ``share`` per cent with the highest scores are drawn, ties
    to the smaller ``doc_id``.  Null and empty texts have no features and weight 0, a null ``doc_id`` draws as
    the empty text and comes after others in ties; repeated rows are drawn one by one.  Very long texts are
    read in runs of words.  Columns besides ``doc_id`` and ``text`` are left out; without rows there is no
    result row, without target rows all gains favour rare buckets.
    """
    with scratch_scope(docs.sparkSession) as keep:
        gains = bucket_gains(bucket_counts(docs, words, buckets), bucket_counts(target, words, buckets))
        weights = importance_weights(docs, gains, words)
        number = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
        luck = F.floor(-1000 * F.log(-F.log((number.cast("double") + 0.5) / 4294967296)))
        scored = weights.withColumn("score", (F.col("weight") + luck).cast("long"))
        scored = scored.withColumn("able", F.col("n_words") >= least_words).withColumn("__at", F.monotonically_increasing_id())
        scored = written(scored, "scores")
        order = [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"), "__at"]
        ordered = scored.repartitionByRange(*order).sortWithinPartitions(*order)
        placed = written(ordered.withColumn("place", F.monotonically_increasing_id()).drop("__at"), "ranked")
        drawn = with_ranks(placed, share)
        return keep(written(drawn.select("doc_id", "n_features", "weight", "score", "rank", "n_words"), "drawn"))


def with_ranks(placed: DataFrame, share: int) -> DataFrame:
    """Ranks from ``place``: the partition in its upper bits, the row within it in the lower 33."""
    part = F.shiftright("place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.count_if("able").alias("able")).collect()
    before, starts = 0, []
    for row in sorted(sizes, key=lambda r: r["part"]):  # one row per partition
        starts.append((row["part"], before))
        before += row["rows"]
    most = share * sum(row["able"] for row in sizes) // 100
    offsets = placed.sparkSession.createDataFrame(starts, "part long, start long")
    rank = F.col("start") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    ranked = placed.withColumn("part", part).join(F.broadcast(offsets), "part")
    return ranked.withColumn("rank", F.when(F.col("able") & (rank <= most), rank))


def resample(docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of ``docs`` that ``resampling_report`` draws, all their columns; rows of one id go together."""
    ids = resampling_report(docs, target, **parameters).where(F.col("rank").isNotNull()).select("doc_id").distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
