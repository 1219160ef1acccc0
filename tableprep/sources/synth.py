"""The load-test table: columns by position, as one projection over row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The categories, repeated in order.
CATEGORIES = ["A", "B", "C", "D"]


def synth_columns(row: Column, rows: int, columns: int = 10, seed: int = 0) -> list[Column]:
    """Noisy row numbers, cyclic categories and an even ramp from 0 to 1.5 * rows, by position mod 3."""
    step = rows * 1.5 / (rows - 1) if rows > 1 else 0.0
    letters = F.array(*[F.lit(c) for c in CATEGORIES])
    out = []
    for i in range(columns):
        if i % 3 == 0:
            out.append((row + F.randn(seed + i)).alias(f"numeric_col_{i}"))
        elif i % 3 == 1:
            at = F.pmod(row, F.lit(len(CATEGORIES))).cast("int") + 1
            out.append(F.element_at(letters, at).alias(f"categorical_col_{i}"))
        else:
            out.append((row * F.lit(step)).alias(f"float_col_{i}"))
    return out


def synth_table(spark: SparkSession, rows: int = 1000, columns: int = 10, seed: int = 0) -> DataFrame:
    return spark.range(rows).select(*synth_columns(F.col("id"), rows, columns, seed))
