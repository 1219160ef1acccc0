"""Value frequencies of many columns at once: distinct counts, modes, top values.

Columns of one type are unpivoted to ``(column, value)`` and grouped once, so a table costs one
shuffle per value type instead of one per column.  Partial aggregation keeps a hot value to one
record per task.  Where only the number of distinct values matters, long texts are replaced by
their SHA-256 before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.types import col, dtype_of, is_integer, is_text

LONG_TEXT_BYTES = 64
ESTIMATES_PER_JOB = 10


def _family(dtype: T.DataType) -> str:
    """The type under which columns can share one unpivot without losing digits."""
    if is_integer(dtype):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if is_text(dtype):
        return "string"
    return dtype.simpleString()


def _families(df: DataFrame, columns: Iterable[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for name in columns:
        out.setdefault(_family(dtype_of(df, name)), []).append(name)
    return out


def short_key(text: Column) -> Column:
    """The text itself, or its SHA-256 when it is long.  A digest is longer than any text kept as it is."""
    return F.when(F.octet_length(text) < LONG_TEXT_BYTES, text).otherwise(F.sha2(text, 256))


def _unpivoted(df: DataFrame, family: str, names: list[str], shorten: bool) -> DataFrame:
    def value(name: str) -> Column:
        c = col(name).cast(family) if dtype_of(df, name).simpleString() != family else col(name)
        return short_key(c) if shorten and family == "string" else c

    narrow = df.select(*[value(n).alias(f"c{i}") for i, n in enumerate(names)])
    long = narrow.unpivot([], [f"c{i}" for i in range(len(names))], "slot", "value")
    return long.filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: Iterable[str]) -> list[tuple[str, list[str], DataFrame]]:
    """Per value type: ``(type, columns, DataFrame(slot, value, n))``; slot ``c0`` is the first column."""
    return [
        (family, names, _unpivoted(df, family, names, False).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n")))
        for family, names in _families(df, columns).items()
    ]


def _count_parts(df: DataFrame, columns: list[str], step: int) -> DataFrame:
    """``(tag, n, repeats)`` per column: distinct values, and whether any occurs twice."""
    tag = {name: i for i, name in enumerate(columns)}
    union = None
    for family, names in _families(df, columns).items():
        slots = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (f"c{i}", tag[n])])
        long = _unpivoted(df, family, names, True)
        if step > 1:
            long = long.filter(F.pmod(F.xxhash64("value"), F.lit(step)) == 0)
        part = (
            long.groupBy("slot", "value")
            .agg(F.count(F.lit(1)).alias("copies"))
            .groupBy("slot")
            .agg(F.count(F.lit(1)).alias("n"), (F.max("copies") > 1).alias("repeats"))
            .select(slots[F.col("slot")].alias("tag"), "n", "repeats")
        )
        union = part if union is None else union.unionAll(part)
    return union


def distinct_counts(df: DataFrame, columns: Iterable[str]) -> dict[str, int]:
    """Exact number of distinct non-null values of each column, in one job."""
    columns = list(columns)
    if not columns:
        return {}
    found = {row["tag"]: row["n"] for row in _count_parts(df, columns, 1).collect()}
    return {name: found.get(i, 0) for i, name in enumerate(columns)}


def estimated_counts(df: DataFrame, columns: Iterable[str]) -> dict[str, int]:
    """Estimated distinct counts: one aggregate per few columns, no shuffle of values."""
    columns, out = list(columns), {}
    for start in range(0, len(columns), ESTIMATES_PER_JOB):
        names = columns[start : start + ESTIMATES_PER_JOB]
        row = df.agg(*[F.approx_count_distinct(col(n)).alias(f"d{i}") for i, n in enumerate(names)]).first()
        out.update({n: row[f"d{i}"] for i, n in enumerate(names)})
    return out


def sliced_counts(df: DataFrame, columns: Iterable[str], step: int) -> dict[str, tuple[int, bool]]:
    """Distinct values, and whether one repeats, among those whose hash falls in one of ``step`` slices."""
    columns = list(columns)
    if not columns:
        return {}
    found = {row["tag"]: (row["n"], row["repeats"]) for row in _count_parts(df, columns, step).collect()}
    return {name: found.get(i, (0, False)) for i, name in enumerate(columns)}


def top_values(df: DataFrame, columns: Iterable[str], k: int) -> DataFrame:
    """``(column, value, n, rank)``: the ``k`` most frequent values, ties by smallest value.

    ``rank <= k`` becomes a per-task group limit, so at most ``k`` rows per column and task move.
    """
    parts = []
    for _, names, counts in value_counts(df, columns):
        order = Window.partitionBy("slot").orderBy(F.desc("n"), F.asc("value"))
        labels = F.create_map(*[F.lit(x) for i, n in enumerate(names) for x in (f"c{i}", n)])
        parts.append(
            counts.withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k)
            .select(labels[F.col("slot")].alias("column"), F.col("value").cast("string").alias("value"), "n", "rank")
        )
    if not parts:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint, rank int")
    union = parts[0]
    for part in parts[1:]:
        union = union.unionAll(part)
    return union


def modes(df: DataFrame, columns: Iterable[str]) -> dict[str, str]:
    """Most frequent value of each column as text, smallest on ties; all-null columns are absent."""
    columns = list(columns)
    if not columns:
        return {}
    return {row["column"]: row["value"] for row in top_values(df, columns, 1).collect()}
