"""What the query modules share: registration, table access and derived tables in both dialects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def gap(condition: str, column: str, name: str | None = None) -> str:
    """A column with missing values, in words both dialects read."""
    return f"CASE WHEN {condition} THEN NULL ELSE {column} END AS {name or column}"


class Derived:
    """A table derived by one projection whose text serves Spark and the oracle."""

    def __init__(self, source: str, columns: list[str]):
        self.source, self.columns = source, columns

    @property
    def sql(self) -> str:
        return f"SELECT {', '.join(self.columns)} FROM {self.source}"

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, self.source).selectExpr(*self.columns)


# Test tables have no missing values; this one has them in every pattern that decides differently.
GAPPY = Derived(
    "events",
    [
        "event_id",
        "ts",
        gap("event_id % 3 = 0", "event_type"),
        gap("event_id % 7 = 0", "value"),
        gap("event_id % 2 = 0", "props"),
        gap("event_id % 10 <> 0", "value", "mostly_missing"),
        "CASE WHEN event_id % 2 = 0 THEN CAST(5 AS BIGINT) END AS constant",
        gap("event_id % 20 = 0", "user_id", "user_ref"),
    ],
)
GAPPY_TYPES = {
    "event_id": "bigint",
    "ts": "timestamp_ntz",
    "event_type": "string",
    "value": "double",
    "props": "string",
    "mostly_missing": "double",
    "constant": "bigint",
    "user_ref": "bigint",
}
GAPPY_NUMBERS = ["event_id", "value", "mostly_missing", "constant", "user_ref"]
GAPPY_TEXTS = ["event_type", "props"]


def sql_mode(column: str, source: str) -> str:
    """Most frequent value, smallest on ties."""
    return (
        f"(SELECT {column} FROM (SELECT {column}, count(*) AS n FROM {source} WHERE {column} IS NOT NULL "
        f"GROUP BY {column}) ORDER BY n DESC, {column} LIMIT 1)"
    )


def sql_fences(column: str, source: str) -> str:
    """One row ``q1, q3, lo, hi``."""
    return (
        f"(SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM "
        f"(SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source}))"
    )


def union_all(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)
