"""The data behind the charts of a table: histogram, box plot, correlation, count plot, summary.

One profile chooses the columns and feeds the charts.  What a chart needs beyond it is one aggregate
for all columns together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial
from itertools import combinations, permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.functions.exprs import bin_edges, histogram_bin
from tableprep.functions.types import as_double, col, dtype_of, kind_of, nan_to_null, number_columns
from tableprep.operators import frequencies
from tableprep.operators.profile import SMALL_TABLE_ROWS, ColumnStats, Profile, profile
from tableprep.plans.decide import top_variance, useful_categories
from tableprep.session import together

BINS = 30
HEAD_ROWS = 10
COUNT_PLOT_VALUES = 20
PAIRS_PER_JOB = 600
SMALL_PAIRS_PER_JOB = 60
SIDE_BY_SIDE = 6
ROWS_PER_PRODUCT = 2048
PRODUCTS = ("n", "x", "y", "xx", "yy", "xy")


@dataclass
class EdaResult:
    manifest: DataFrame
    histogram: DataFrame
    boxplot: DataFrame
    correlation: DataFrame | None
    count_plot: DataFrame
    summary: DataFrame


def histogram(df: DataFrame, stats: list[ColumnStats], bins: int = BINS) -> DataFrame:
    """``(column, bin, low, high, n)`` for every bin, empty ones included."""
    df = nan_to_null(df)
    spark = df.sparkSession
    stats = [s for s in stats if s.filled]
    schema = "column string, bin int, low double, high double"
    frame = []
    for s in stats:
        edges = bin_edges(float(s.low), float(s.high), bins)
        frame += [(s.name, b, edges[b], edges[b + 1]) for b in range(bins)]
    edges_frame = spark.createDataFrame(frame, schema)
    if not stats:
        return edges_frame.withColumn("n", F.lit(0).cast("bigint"))
    binned = df.select(
        *[
            histogram_bin(as_double(s.name, dtype_of(df, s.name)), float(s.low), float(s.high), bins).alias(f"c{i}")
            for i, s in enumerate(stats)
        ]
    )
    names = F.create_map(*[F.lit(x) for i, s in enumerate(stats) for x in (f"c{i}", s.name)])
    counts = (
        binned.unpivot([], [f"c{i}" for i in range(len(stats))], "slot", "bin")
        .filter("bin IS NOT NULL")
        .groupBy("slot", "bin")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(names[F.col("slot")].alias("column"), "bin", "n")
    )
    return (
        edges_frame.join(F.broadcast(counts), ["column", "bin"], "left")
        .select("column", "bin", "low", "high", F.coalesce("n", F.lit(0)).alias("n"))
    )


def boxplot(df: DataFrame, stats: list[ColumnStats]) -> DataFrame:
    """``(column, whisker_low, q1, median, q3, whisker_high, fliers)``.

    Whiskers end at the most extreme value inside the 1.5 IQR fences, or at the box if there is none.
    """
    df = nan_to_null(df)
    schema = (
        "column string, whisker_low double, q1 double, median double, q3 double, whisker_high double, fliers bigint"
    )
    stats = [s for s in stats if s.filled]
    if not stats:
        return df.sparkSession.createDataFrame([], schema)
    exprs = []
    for i, s in enumerate(stats):
        x = as_double(s.name, dtype_of(df, s.name))
        low, high = s.fences
        exprs += [F.min(F.when(x >= low, x)).alias(f"lo{i}"), F.max(F.when(x <= high, x)).alias(f"hi{i}")]
        exprs.append(F.count_if((x < low) | (x > high)).alias(f"o{i}"))
    row = df.agg(*exprs).first()
    out = []
    for i, s in enumerate(stats):
        low, high = row[f"lo{i}"], row[f"hi{i}"]
        low = s.q1 if low is None or low > s.q1 else low
        high = s.q3 if high is None or high < s.q3 else high
        out.append((s.name, low, s.q1, s.median, s.q3, high, row[f"o{i}"]))
    return df.sparkSession.createDataFrame(out, schema)


def correlation(df: DataFrame, stats: Profile | None = None) -> DataFrame | None:
    """Pearson matrix in long form ``(x, y, r)`` over pairwise complete rows; None below two numbers.

    A pair with a constant side has no correlation (null), also on the diagonal.  The table is read
    once: a few pairs are one generated aggregate, many are products of Arrow batches.
    """
    df = nan_to_null(df)
    names = number_columns(df)
    if len(names) < 2:
        return None
    stats = stats or profile(df, names, quartiles=())
    out = {(n, n): (None if stats[n].constant else 1.0) for n in names}
    pairs = [(a, b) for a, b in combinations(names, 2) if not (stats[a].constant or stats[b].constant)]
    out.update(dict.fromkeys(permutations(names, 2)))
    # Centred at the known means, plain sums of products are accurate and cheap.
    centred = df.select(
        *[
            (as_double(n, dtype_of(df, n)) - F.lit(float(stats[n].mean or 0.0))).alias(f"d{i}")
            for i, n in enumerate(names)
        ]
    )
    at = {n: F.col(f"d{i}") for i, n in enumerate(names)}

    def some_pairs(chunk: list[tuple[str, str]]) -> None:
        exprs = []
        for i, (a, b) in enumerate(chunk):
            x, y = at[a], at[b]
            exprs.append(F.sum(x * y).alias(f"xy{i}"))
            if stats[a].nulls or stats[b].nulls:
                both = x.isNotNull() & y.isNotNull()
                for name, e in {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y}.items():
                    exprs.append(F.sum(F.when(both, e)).alias(f"{name}{i}"))
        row = centred.agg(*exprs).first()
        for i, (a, b) in enumerate(chunk):
            if stats[a].nulls or stats[b].nulls:
                r = _pearson(*[row[f"{k}{i}"] for k in ("n", "x", "y", "xx", "yy", "xy")])
            else:
                r = row[f"xy{i}"] / stats[a].rows / (stats[a].std_pop * stats[b].std_pop)
            out[a, b] = out[b, a] = r

    if len(pairs) <= PAIRS_PER_JOB:
        size = PAIRS_PER_JOB
        if stats.rows <= SMALL_TABLE_ROWS:
            size = min(size, max(SMALL_PAIRS_PER_JOB, math.ceil(len(pairs) / SIDE_BY_SIDE)))
        chunks = [pairs[i : i + size] for i in range(0, len(pairs), size)]
        together(*[partial(some_pairs, chunk) for chunk in chunks])
    else:
        moving = [i for i, n in enumerate(names) if not stats[n].constant]
        for row in product_sums(centred.select(*[f"d{i}" for i in moving])).collect():
            a, b = names[moving[row["i"]]], names[moving[row["j"]]]
            out[a, b] = out[b, a] = _pearson(*[row[k] for k in ("n", "x", "y", "xx", "yy", "xy")])
    return df.sparkSession.createDataFrame([(a, b, out[a, b]) for a in names for b in names], "x string, y string, r double")


def product_sums(df: DataFrame) -> DataFrame:
    """``(i, j, n, x, y, xx, yy, xy)`` for all pairs of columns ``i < j``, over rows where both have values.

    One scan: every task multiplies its batches as matrices and sends one row per pair.
    """
    width = len(df.columns)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        n, x, xx, xy = (np.zeros((width, width)) for _ in range(4))
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_PRODUCT):
                part = batch.slice(start, ROWS_PER_PRODUCT)
                values = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in part.columns], axis=1)
                there = (~np.isnan(values)).astype(float)
                values = np.nan_to_num(values)
                n += there.T @ there
                x += values.T @ there
                xx += (values * values).T @ there
                xy += values.T @ values
        i, j = np.triu_indices(width, 1)
        sums = [n[i, j], x[i, j], x[j, i], xx[i, j], xx[j, i], xy[i, j]]
        columns = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), *map(pa.array, sums)]
        yield pa.RecordBatch.from_arrays(columns, names=["i", "j", *PRODUCTS])

    sums = df.mapInArrow(run, "i int, j int, " + ", ".join(f"{k} double" for k in PRODUCTS))
    return sums.groupBy("i", "j").agg(*[F.sum(k).alias(k) for k in PRODUCTS])


def _pearson(n: float | None, x: float, y: float, xx: float, yy: float, xy: float) -> float | None:
    """From sums over the rows where both sides have a value; no spread on a side, no correlation."""
    if not n:
        return None
    spread = (xx - x * x / n) * (yy - y * y / n)
    tiny = 1e-24 * xx * yy
    return (xy - x * y / n) / math.sqrt(spread) if spread > tiny else None


def count_plot(df: DataFrame, columns: list[str], k: int = COUNT_PLOT_VALUES) -> DataFrame:
    return frequencies.top_values(df, columns, k)


def describe(df: DataFrame, stats: Profile) -> DataFrame:
    """``(column, stat, value)`` with the eight usual statistics of every number column."""
    rows = []
    for s in stats.of_kind("number"):
        values = {
            "count": s.filled,
            "mean": s.mean,
            "std": s.std,
            "min": s.low,
            "25%": s.q1,
            "50%": s.median,
            "75%": s.q3,
            "max": s.high,
        }
        rows += [(s.name, stat, None if v is None else float(v)) for stat, v in values.items()]
    return df.sparkSession.createDataFrame(rows, "column string, stat string, value double")


def describe_dates(df: DataFrame) -> DataFrame:
    """``(column, stat, value)``: count, mean, min, quartiles and max of date and time columns.

    Moments are to the second; the count stands in ``n`` and the other statistics in ``value``.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields if kind_of(f.dataType) == "datetime"}
    schema = "column string, stat string, n bigint, value timestamp_ntz"
    if not kinds:
        return df.sparkSession.createDataFrame([], schema)
    epoch = F.lit("1970-01-01").cast("timestamp_ntz")
    seconds = [
        F.timestamp_diff("MICROSECOND", epoch, col(c).cast("timestamp_ntz")).cast("double").alias(f"c{i}") / 1e6
        for i, c in enumerate(kinds)
    ]
    numbers = df.select(*[e.alias(f"c{i}") for i, e in enumerate(seconds)])
    stats = profile(numbers, numbers.columns)
    rows = []
    for name, s in zip(kinds, stats):
        rows.append((name, "count", s.filled, None))
        facts = {"mean": s.mean, "min": s.low, "25%": s.q1, "50%": s.median, "75%": s.q3, "max": s.high}
        rows += [(name, stat, None, None if v is None else float(round(v))) for stat, v in facts.items()]
    found = df.sparkSession.createDataFrame(rows, "column string, stat string, n bigint, seconds double")
    moment = F.timestamp_add("SECOND", F.col("seconds").cast("bigint"), epoch)
    return found.select("column", "stat", "n", moment.alias("value"))


def head(df: DataFrame, n: int = HEAD_ROWS, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in ``order_by`` (nulls first); without an order any ``n`` rows, as files come."""
    return (df.orderBy(*[col(c) for c in order_by]) if order_by else df).limit(n)


def sample_statistics(df: DataFrame, stats: Profile | None = None, k: int = 5) -> DataFrame:
    """``(column, stat, item, value)``: mean, std, min, max of numbers; distinct count and top values of the rest."""
    df = nan_to_null(df)
    stats = stats or profile(df, quartiles=(), distinct=[s for s in df.columns if s not in number_columns(df)])
    rows = []
    for s in stats:
        if s.kind == "number":
            facts = {"mean": s.mean, "std": s.std, "min": s.low, "max": s.high}
            rows += [(s.name, stat, None, None if v is None else float(v)) for stat, v in facts.items()]
        elif s.kind != "other":
            rows.append((s.name, "unique_count", None, float(s.distinct)))
    facts = df.sparkSession.createDataFrame(rows, "column string, stat string, item string, value double")
    others = [s.name for s in stats if s.kind not in ("number", "other")]
    top = frequencies.top_values(df, others, k)
    return facts.unionAll(top.select("column", F.lit("top"), F.col("value"), F.col("n").cast("double")))


def summary(df: DataFrame, stats: Profile) -> DataFrame:
    """``(position, column, dtype, kind, rows, columns, missing, distinct_values)``, one row per column."""
    rows = [
        (i, s.name, s.dtype, s.kind, stats.rows, len(stats.columns), s.nulls, s.distinct)
        for i, s in enumerate(stats)
    ]
    return df.sparkSession.createDataFrame(
        rows,
        "position int, column string, dtype string, kind string, rows bigint, columns int, missing bigint, "
        "distinct_values bigint",
    )


def profile_eda(df: DataFrame, known: Profile | None = None, exact_distinct: bool = True) -> Profile:
    return profile(df, distinct=None, screen=not exact_distinct, known=known)


def chart_list(stats: Profile) -> list[tuple[str, str | None]]:
    """Charts in drawing order: ``(type, column)``, the heatmap without a column."""
    out: list[tuple[str, str | None]] = []
    for s in top_variance(stats):
        out += [("histogram", s.name), ("boxplot", s.name)]
    if len(stats.of_kind("number")) >= 2:
        out.append(("heatmap", None))
    return out + [("countplot", s.name) for s in useful_categories(stats)]


def eda(df: DataFrame, stats: Profile | None = None) -> EdaResult:
    df = nan_to_null(df)
    stats = stats or profile_eda(df)
    top = top_variance(stats)
    manifest = df.sparkSession.createDataFrame(
        [(i, kind, column) for i, (kind, column) in enumerate(chart_list(stats))],
        "seq int, type string, column string",
    )
    return EdaResult(
        manifest,
        *together(
            lambda: histogram(df, top),
            lambda: boxplot(df, top),
            lambda: correlation(df, stats),
            lambda: count_plot(df, [s.name for s in useful_categories(stats)]),
        ),
        summary(df, stats),
    )
