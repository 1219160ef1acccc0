"""Quality rules: fixed limits first, then robust multivariate outliers per language and source.

Statistics of each text become a vector of transformed rates.  Per (language, source) a minimum covariance
determinant estimate is iterated by concentration steps: distances of all rows, the share of rows nearest
to the centre, their mean and covariance.  Every step is an aggregate per group with partial sums, so a
group with a third of all rows is no burden; nothing is sampled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.llm.common import NOT_SPACE, Chunk, Rolling, annotate, byte_class, chunks, mix
from tableprep.session import written

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
SYMBOLS = byte_class(*[(ord(c), ord(c)) for c in "#*$%&|<>"])
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of words in repeated three-word windows

SHARE = 0.75  # of a group's rows that an estimate rests on
STEPS = 4
PRIOR_ROWS = 10  # rows' worth of a prior covariance mixed into each estimate
REJECTED_SHARE = 1e-3  # of normally distributed rows that the distance limit would reject
BROADCAST_GROUPS = 20_000

#: Transformed statistics, as SQL.  Sizes and symbols are log-scaled; the two shares are not, as a single
#: repeated line would otherwise set a text far apart from the many that have none.
FEATURES = {
    "v0": "ln(1 + n_words)",
    "v1": "ln(word_chars / n_words)",
    "v2": "ln(1 + 100 * n_symbols / word_chars)",
    "v3": "2 * n_dup_lines / n_lines",
    "v4": "2 * n_repeat_words / n_words",
}
DIMENSIONS = len(FEATURES)
#: Standard deviation each feature has at least.  Length alone is no fault, and the fixed rules already bound
#: repeated words (``v4 <= 1``): both count for little next to symbols and repeated lines.
SPREAD_FLOORS = np.array([1.0, 0.25, 0.25, 0.225, 0.4])
#: Standard deviation of each feature in the prior.
PRIOR_SPREADS = np.array([0.5, 0.5, 0.5, 0.2, 0.5])


def chunk_statistics(chunk: Chunk) -> list[np.ndarray]:
    data, texts = chunk.data, len(chunk.texts)
    ends = chunk.starts + chunk.lengths

    def per_text(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[ends] - sums[chunk.starts]

    solid = NOT_SPACE[data]
    starts, stops, owner = chunk.words(NOT_SPACE)
    hashes = Rolling(data)
    words = hashes.of(starts, stops)
    n_words = np.bincount(owner, minlength=texts)

    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate([[0], breaks[:-1] + 1]) if len(breaks) else np.zeros(0, np.int64)
    solid_sums = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    full = np.flatnonzero(solid_sums[breaks] > solid_sums[line_starts])
    line_owner = np.searchsorted(chunk.starts, line_starts[full], side="right") - 1
    lines = tagged(hashes.of(line_starts[full], breaks[full]), line_owner)
    n_lines = np.bincount(line_owner, minlength=texts)
    _, first = np.unique(lines, return_index=True)
    n_dup_lines = n_lines - np.bincount(line_owner[first], minlength=texts)

    repeated = np.zeros(len(words) + 2, dtype=bool)
    if len(words) > 2:
        at = np.flatnonzero(owner[2:] == owner[:-2])
        windows = tagged(mix(mix(words[at]) + words[at + 1]) + words[at + 2], owner[at])
        order = np.argsort(windows)
        same = windows[order][1:] == windows[order][:-1]
        twice = at[np.concatenate([order[1:][same], order[:-1][same]])]
        for step in range(3):
            repeated[twice + step] = True
    n_repeat = np.bincount(owner, weights=repeated[: len(words)], minlength=texts).astype(np.int64)
    chars = per_text((solid == 1) & ((data & 0xC0) != 0x80))
    return [n_words, chars, per_text(SYMBOLS[data]), n_dup_lines, n_repeat, n_lines]


def tagged(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between texts."""
    return mix(hashes ^ mix(owner.astype(np.uint64) + np.uint64(1)))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with the statistics of their texts; null and empty texts have zeros."""

    def compute(texts):
        parts = [chunk_statistics(chunk) for _, _, chunk in chunks(texts)]
        return [np.concatenate(column) for column in zip(*parts)] if parts else [[]] * 6

    return annotate(docs, text, STATISTICS, compute)


def fails_rules() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def chi2_cdf(x: float, degrees: int) -> float:
    """Series of the lower incomplete gamma function."""
    a, x = degrees / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a))) if x > 0 else 0.0


def chi2_quantile(p: float, degrees: int) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, degrees) < p else (low, middle)
    return high


#: What makes the covariance of the nearest rows consistent for normal data.
CONSISTENCY = SHARE / chi2_cdf(chi2_quantile(SHARE, DIMENSIONS), DIMENSIONS + 2)
LIMIT = chi2_quantile(1 - REJECTED_SHARE, DIMENSIONS)
PAIRS = [(i, j) for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
ESTIMATE = "g_lang string, g_source string, centre array<double>, inverse array<double>"


def first_estimate(rows: DataFrame) -> DataFrame:
    """Medians and quartile spreads of each feature per group."""
    quartiles = rows.groupBy("g_lang", "g_source").agg(
        *[F.percentile_approx(v, [0.25, 0.5, 0.75], 1000).alias(v) for v in FEATURES]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                q = np.array([list(getattr(row, v)) for v in FEATURES])
                spread = ((q[:, 2] - q[:, 0]) / 1.349) ** 2 + SPREAD_FLOORS**2
                made.append((row.g_lang, row.g_source, q[:, 1].tolist(), np.diag(1 / spread).ravel().tolist()))
            yield pd.DataFrame(made, columns=["g_lang", "g_source", "centre", "inverse"])

    return quartiles.mapInPandas(run, ESTIMATE)


def next_estimate(near: DataFrame) -> DataFrame:
    """Mean and regularised covariance of the rows near each group's centre."""
    moments = near.groupBy("g_lang", "g_source").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(v).alias(f"m{i}") for i, v in enumerate(FEATURES)],
        *[F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}{j}") for i, j in PAIRS],
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for row in batch.itertuples(index=False):
                scatter = np.zeros((DIMENSIONS, DIMENSIONS))
                for i, j in PAIRS:
                    scatter[i, j] = scatter[j, i] = getattr(row, f"c{i}{j}")
                scatter = (CONSISTENCY * scatter * row.n + PRIOR_ROWS * np.diag(PRIOR_SPREADS**2)) / (row.n + PRIOR_ROWS)
                inverse = np.linalg.inv(scatter + np.diag(SPREAD_FLOORS**2))
                centre = [getattr(row, f"m{i}") for i in range(DIMENSIONS)]
                made.append((row.g_lang, row.g_source, centre, inverse.ravel().tolist()))
            yield pd.DataFrame(made, columns=["g_lang", "g_source", "centre", "inverse"])

    return moments.mapInPandas(run, ESTIMATE)


def with_distance(rows: DataFrame, estimate: DataFrame, how: str = "inner") -> DataFrame:
    """Squared Mahalanobis distance of each row to its group's centre."""
    kept = written(estimate, "estimate")
    few = kept.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = rows.join(F.broadcast(kept) if few else kept, ["g_lang", "g_source"], how)
    gap = [F.col(v) - F.col("centre")[i] for i, v in enumerate(FEATURES)]
    terms = [gap[i] * gap[j] * F.col("inverse")[i * DIMENSIONS + j] for i in range(DIMENSIONS) for j in range(DIMENSIONS)]
    return joined.withColumn("distance", sum(terms[1:], terms[0])).drop("centre", "inverse")


def robust_estimate(rows: DataFrame) -> DataFrame:
    """Minimum covariance determinant estimates of all groups by concentration steps."""
    estimate = first_estimate(rows)
    for _ in range(STEPS):
        placed = with_distance(rows, estimate)
        reach = placed.groupBy("g_lang", "g_source").agg(F.percentile_approx("distance", SHARE, 1000).alias("reach"))
        reach = written(reach, "reach")
        few = reach.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
        near = placed.join(F.broadcast(reach) if few else reach, ["g_lang", "g_source"]).where("distance <= reach")
        estimate = next_estimate(near)
    return estimate


def judge_quality(docs: DataFrame) -> DataFrame:
    """Columns of ``docs`` but the text, with statistics, ``base_failed, distance, outlier, kept``.

    Needs ``text, lang, source``; null languages and sources count as empty texts.  Rows that fail the
    fixed rules take no part in the estimates and have no distance.  Groups of a few rows lean on the
    prior covariance, a single row is its own centre; repeated rows count each.  Null or empty texts fail.
    """
    made = ["g_lang", "g_source", *FEATURES, "base_failed", "distance", "outlier", "kept"]
    own = [c for c in docs.columns if c.lower() not in made]
    keyed = docs.select(
        *[F.col(f"`{c}`") for c in own],
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("g_lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("g_source"),
    )
    statistics = text_statistics(keyed).drop("text").withColumn("base_failed", fails_rules())
    solid = {v: F.when(~F.col("base_failed"), F.expr(sql)) for v, sql in FEATURES.items()}
    rows = written(statistics.withColumns(solid), "statistics")
    estimate = robust_estimate(rows.where(~F.col("base_failed")))
    placed = with_distance(rows, estimate, "left")
    outlier = F.coalesce(~F.col("base_failed") & (F.col("distance") > LIMIT), F.lit(False))
    return (
        placed.withColumn("outlier", outlier)
        .withColumn("kept", ~F.col("base_failed") & ~outlier)
        .drop("g_lang", "g_source", *FEATURES)
    )
