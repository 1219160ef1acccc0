"""Advice as data: questions go out as a table, answers come back as a table and are parsed here.

An answer is free text with one JSON object in it, mostly inside a code fence.  Parsing is built-in
expressions only, so a million answers cost one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.operators.profile import Profile, profile
from tableprep.plans.decide import FILL_ACTIONS, Suggestions, advice_candidates

# Texts that stand in for missing answers.
DEFAULT_ACTION = "mean"
DEFAULT_REASON = "No reason provided"
FALLBACK_NUMBER = ("median", "Default: median for numerical columns")
FALLBACK_OTHER = ("mode", "Default: mode for categorical columns")
LOW_IMPORTANCE = "Low importance"
NO_REASONING = "No reasoning provided"
NO_SUMMARY = "No summary provided"
NO_RECOMMENDATIONS = "No recommendations provided"
FALLBACK_RECOMMENDATIONS = (
    "Review cleaned data for domain-specific validation. Consider retrying for detailed AI-generated report."
)
QUOTA_SIGNS = ("quota", "429", "rate limit")
DIGEST_ROWS = 10
LISTS = ("encoding", "scaling", "drop", "new_features")


def fenced(answer: Column) -> Column:
    """The JSON part of an answer: a json fence anywhere wins, then a plain fence, then all of it.

    A fence that is never closed takes the rest.
    """

    def after(fence: str) -> Column:
        start = F.position(F.lit(fence), answer) + len(fence)
        return F.substring_index(F.substr(answer, start), "```", 1)

    return (
        F.when(F.contains(answer, F.lit("```json")), after("```json"))
        .when(F.contains(answer, F.lit("```")), after("```"))
        .otherwise(answer)
    )


def _read_object(answers: DataFrame, answer: str, fields: str = "map<string,string>") -> DataFrame:
    """Add ``__m``: the answer's JSON object read as ``fields``, null unless there is exactly one object.

    The object is read as the only element of a list, so that anything after it makes it unreadable.
    """
    listed = answers.withColumn("__text", F.concat(F.lit("["), fenced(F.col(answer)), F.lit("]")))
    read = listed.withColumn(
        "__all", F.when(F.try_parse_json("__text").isNotNull(), F.from_json("__text", f"array<{fields}>"))
    )
    return read.withColumn("__m", F.when(F.size("__all") == 1, F.element_at("__all", 1))).drop("__text", "__all")


def _member(members: Column, name: str, default: str) -> Column:
    return F.when(F.map_contains_key(members, name), F.try_element_at(members, F.lit(name))).otherwise(default)


def parse_strategy(answers: DataFrame, answer: str = "answer", dtype: str = "dtype") -> DataFrame:
    """Add ``action`` and ``reason``.  An answer without a readable object gets the type's default."""
    numeric = F.col(dtype).isin("tinyint", "smallint", "int", "bigint", "float", "double") | F.col(dtype).startswith(
        "decimal"
    )
    parsed = _read_object(answers, answer)
    bad = F.col("__m").isNull()

    def pick(i: int, name: str, default: str) -> Column:
        fallback = F.when(numeric, FALLBACK_NUMBER[i]).otherwise(FALLBACK_OTHER[i])
        return F.when(bad, fallback).otherwise(_member(F.col("__m"), name, default))

    return parsed.select(
        *[F.col(c) for c in answers.columns],
        pick(0, "action", DEFAULT_ACTION).alias("action"),
        pick(1, "reason", DEFAULT_REASON).alias("reason"),
    )


def parse_features(answers: DataFrame, key: str, answer: str = "answer") -> DataFrame:
    """``(key, list, position, column, method, name, description, reason)``, one row per advised step.

    Texts in the drop list become rows with a standard reason.  An unreadable answer gives no rows.
    """
    step = "struct<column:string,method:string,name:string,description:string,reason:string>"
    fields = ",".join(f"{n}:array<{'string' if n == 'drop' else step}>" for n in LISTS)
    parsed = _read_object(answers.select(F.col(key), F.col(answer)), answer, f"struct<{fields}>")

    def dropped(entry: Column) -> Column:
        as_object = F.from_json(entry, step)
        bare = F.from_json(F.to_json(F.struct(entry.alias("column"), F.lit(LOW_IMPORTANCE).alias("reason"))), step)
        return F.when(F.startswith(F.ltrim(entry), F.lit("{")), as_object).otherwise(bare)

    def steps(name: str) -> Column:
        listed = F.col(f"__m.{name}")
        if name == "drop":
            listed = F.transform(listed, dropped)
        return F.transform(
            F.coalesce(listed, F.array().cast(f"array<{step}>")),
            lambda s, i: F.struct(F.lit(name).alias("list"), i.alias("position"), s.alias("step")),
        )

    every = F.flatten(F.array(*[steps(n) for n in LISTS]))
    return (
        parsed.select(F.col(key), F.explode(every).alias("e"))
        .select(F.col(key), "e.list", "e.position", "e.step.*")
    )


def suggestions_of(steps: DataFrame) -> Suggestions:
    """One table's parsed steps, for ``plan_features``.  Steps are as few as a table has columns."""
    out = Suggestions()
    for row in steps.orderBy("list", "position").collect():
        spec = {k: row[k] for k in ("column", "method", "name", "description", "reason") if row[k] is not None}
        getattr(out, row["list"]).append(spec)
    return out


def parse_report(answers: DataFrame, answer: str = "answer") -> DataFrame:
    """Add ``reasoning``, ``summary`` and ``recommendations``; a list of them becomes dashed lines."""
    parsed = _read_object(answers, answer)
    raw = _member(F.col("__m"), "recommendations", NO_RECOMMENDATIONS)
    listed = F.from_json(raw, "array<string>")
    lines = F.array_join(F.transform(listed, lambda x: F.concat(F.lit("- "), x)), "\n")
    readable = F.col("__m").isNotNull()
    return parsed.select(
        *[F.col(c) for c in answers.columns],
        F.when(readable, _member(F.col("__m"), "reasoning", NO_REASONING)).alias("reasoning"),
        F.when(readable, _member(F.col("__m"), "summary", NO_SUMMARY)).alias("summary"),
        F.when(readable, F.when(raw.rlike(r"(?s)^\s*\[") & listed.isNotNull(), lines).otherwise(raw)).alias(
            "recommendations"
        ),
    )


def fallback_report(actions: Column, error: Column) -> tuple[Column, Column, Column]:
    """Reasoning, summary and recommendations when the report could not be had."""
    return (
        F.format_string(
            "Dataset cleaned using %d actions. AI-assisted cleaning was attempted but report generation "
            "encountered an error: %s",
            actions,
            F.substring(error, 1, 100),
        ),
        F.format_string("Cleaned %d columns with missing values. Data quality improved.", actions),
        F.lit(FALLBACK_RECOMMENDATIONS),
    )


def is_quota_error(error: Column) -> Column:
    """Errors that end the attempt without a report."""
    out = F.lit(False)
    for sign in QUOTA_SIGNS:
        out = out | F.contains(F.lower(error), F.lit(sign))
    return out


def report_digest(log: DataFrame, order: str = "seq", rows: int = DIGEST_ROWS) -> DataFrame:
    """The first log rows with shortened texts, as a report request carries them."""
    return (
        log.orderBy(order)
        .limit(rows)
        .select(
            order,
            F.substring("column", 1, 30).alias("column"),
            F.substring("action", 1, 80).alias("action"),
            "null_count",
            F.coalesce(F.substring("reason", 1, 100), F.lit("")).alias("reason"),
        )
    )


def requests(df: DataFrame, mode: str, stats: Profile | None = None) -> DataFrame:
    """Questions worth asking: ``(column, dtype, null_count, stats, actions)``, at most the mode's budget.

    ``stats`` is the column's profile as JSON.
    """
    schema = "column string, dtype string, null_count bigint, unique_count bigint, min double, max double, "
    schema += "mean double, median double, std double, mode string"
    stats = stats or profile(df, quartiles=())
    asked = [s.name for s in advice_candidates(stats, mode)]
    detail = profile(df, asked, distinct=asked, modes=[n for n in asked if stats[n].kind == "string"]) if asked else ()
    rows = [
        (s.name, s.dtype, s.nulls, s.distinct, *[None if v is None else float(v) for v in (s.low, s.high, s.mean, s.median, s.std)], s.mode)
        for s in sorted(detail, key=lambda s: asked.index(s.name))
    ]
    facts = df.sparkSession.createDataFrame(rows, schema)
    return facts.select(
        "column",
        "dtype",
        "null_count",
        F.to_json(F.struct("dtype", "null_count", "unique_count", "min", "max", "mean", "median", "std", "mode")).alias(
            "stats"
        ),
        F.lit(", ".join(FILL_ACTIONS)).alias("actions"),
    )
