"""Missing values: profile once, decide per column, fill everything in one projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.functions.exprs import number_literal
from tableprep.functions.types import col, nan_to_null, python_text, text_literal
from tableprep.operators import frequencies
from tableprep.operators.ordered import ROWS_PER_RANGE, forward_fill
from tableprep.operators.profile import ColumnStats, Profile, profile
from tableprep.plans.decide import FILL_ACTIONS, Decision, choose_strategies, null_ranking

LOG_SCHEMA = "seq int, column string, null_count bigint, action string, reason string"
UNKNOWN = "Unknown"


@dataclass
class FillStep:
    """What happens to one column: drop it, fill it with a literal, carry values forward, or nothing."""

    column: str
    kind: str  # drop | number | text | unknown | forward | keep
    dtype: str
    value: float | str | None = None

    def expr(self) -> Column:
        c = col(self.column)
        if self.kind == "number":
            return F.coalesce(c, number_literal(self.value, self.dtype)).alias(self.column)
        if self.kind == "text":
            return F.coalesce(c, text_literal(self.value, self.dtype)).alias(self.column)
        if self.kind == "unknown":
            return F.coalesce(c.cast("string"), F.lit(UNKNOWN)).alias(self.column)
        return c


@dataclass
class CleaningPlan:
    steps: list[FillStep] = field(default_factory=list)
    log: list[tuple] = field(default_factory=list)
    order_by: list[str] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    rows_per_range: int = ROWS_PER_RANGE

    @property
    def forward(self) -> list[str]:
        return [s.column for s in self.steps if s.kind == "forward"]

    @property
    def stateless(self) -> bool:
        """Only literals: the plan can run on a stream."""
        return not self.forward

    def apply(self, df: DataFrame) -> DataFrame:
        df = nan_to_null(df)
        if self.forward:
            df = forward_fill(df, self.forward, self.order_by, self.keys, self.rows_per_range)
        steps = {s.column: s for s in self.steps}
        return df.select(
            *[
                steps[c].expr() if c in steps else col(c)
                for c in df.columns
                if c not in steps or steps[c].kind != "drop"
            ]
        )

    def log_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, *row) for i, row in enumerate(self.log)], LOG_SCHEMA)


def _step(s: ColumnStats, decision: Decision) -> tuple[FillStep, str, str]:
    """The fill step of one column with its log action and reason."""
    action, reason = decision.action, decision.reason
    if s.kind == "other" and action != "drop_column":
        return FillStep(s.name, "keep", s.dtype), "Left unchanged", f"Type {s.dtype} is not filled"
    if action in ("mean", "median") and s.kind != "number":
        action = "default"
    if action not in FILL_ACTIONS:
        if s.kind == "number":
            action, reason = "median", "Default strategy for numerical column"
        else:
            action, reason = "mode", "Default strategy for categorical column"
            if s.mode is None:
                return FillStep(s.name, "unknown", s.dtype), f"Filled with mode ({UNKNOWN})", reason
    if action == "drop_column":
        return FillStep(s.name, "drop", s.dtype), "Dropped column", reason
    if action in ("mean", "median"):
        value = s.mean if action == "mean" else s.median
        if value is None:
            return FillStep(s.name, "keep", s.dtype), f"Filled with {action} (nan)", reason
        if s.integer:
            value = round(value)
        return FillStep(s.name, "number", s.dtype, value), f"Filled with {action} ({value:.2f})", reason
    if action == "mode":
        if s.mode is None:
            return (
                FillStep(s.name, "unknown", s.dtype),
                f"Filled with '{UNKNOWN}'",
                f"No mode available, using '{UNKNOWN}'",
            )
        shown = python_text(s.mode, s.dtype)
        return FillStep(s.name, "text", s.dtype, s.mode), f"Filled with mode ({shown})", reason
    if action == "unknown":
        return FillStep(s.name, "unknown", s.dtype), f"Filled with '{UNKNOWN}'", reason
    return FillStep(s.name, "forward", s.dtype), "Forward filled", reason


def read_advice(advice: DataFrame | None, columns: Sequence[str]) -> dict[str, Decision]:
    """The advice rows ``(column, action, reason)`` for ``columns``: one per column, first in text order."""
    if advice is None or not columns:
        return {}
    rows = (
        advice.filter(F.col("column").isin(list(columns)))
        .groupBy("column")
        .agg(F.min(F.struct("action", "reason")).alias("d"))
        .select("column", "d.action", "d.reason")
        .collect()
    )
    return {r["column"]: Decision(r["action"], r["reason"]) for r in rows}


def profile_missing(df: DataFrame) -> Profile:
    """A profile with what the cleaning decisions read, and only for columns that have nulls."""
    first = profile(df, quartiles=())
    gaps = [s.name for s in first if s.nulls]
    if not gaps:
        return first
    texts = [n for n in gaps if first[n].kind not in ("number", "other")]
    known = Profile(first.rows, {n: first[n] for n in gaps})
    first.columns.update(profile(df, gaps, distinct=texts, known=known).columns)
    return first


def _fill_modes(df: DataFrame, choices: list[tuple[ColumnStats, Decision]]) -> None:
    """Look up the modes the decisions call for, and no others: for a text column they are a costly shuffle."""

    def needed(s: ColumnStats, d: Decision) -> bool:
        if s.mode is not None or s.kind == "other":
            return False
        by_default = d.action not in FILL_ACTIONS or d.action in ("mean", "median")
        return d.action == "mode" or (by_default and s.kind != "number")

    wanted = {s.name: s for s, d in choices if needed(s, d)}
    for name, value in frequencies.modes(df, wanted).items():
        wanted[name].mode = value


def plan_cleaning(
    df: DataFrame,
    mode: str = "fast",
    advice: DataFrame | None = None,
    order_by: Sequence[str] = (),
    keys: Sequence[str] = (),
    stats: Profile | None = None,
    rows_per_range: int = ROWS_PER_RANGE,
) -> CleaningPlan:
    """Decide for every column with missing values, worst first.

    ``advice`` (column, action, reason) counts in modes ``smart`` and ``deep`` only, for at most
    three columns above the mode's null share.  ``order_by`` is needed when advice asks for forward fill.
    """
    df = nan_to_null(df)
    stats = stats or profile_missing(df)
    ranked = null_ranking(stats)
    choices = choose_strategies(stats, mode, read_advice(advice if mode != "fast" else None, [s.name for s in ranked]))
    _fill_modes(df, choices)
    plan = CleaningPlan(order_by=list(order_by), keys=list(keys), rows_per_range=rows_per_range)
    for s, decision in choices:
        step, action, reason = _step(s, decision)
        plan.steps.append(step)
        plan.log.append((s.name, s.nulls, action, reason))
    if plan.forward and not plan.order_by:
        raise ValueError(f"forward fill of {plan.forward} needs order_by: a table has no row order of its own")
    return plan


def clean(df: DataFrame, mode: str = "fast", advice: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Cleaned table and its log ``(seq, column, null_count, action, reason)``."""
    plan = plan_cleaning(df, mode, advice, **options)
    return plan.apply(df), plan.log_frame(df.sparkSession)


def fill(df: DataFrame, column: str, action: str, reason: str = "", **options) -> DataFrame:
    """Fill one column by a named action, whatever its null share."""
    df = nan_to_null(df)
    stats, decision = profile(df, [column])[column], Decision(action, reason)
    _fill_modes(df, [(stats, decision)])
    step, _, _ = _step(stats, decision)
    return CleaningPlan([step], [], list(options.get("order_by", ())), list(options.get("keys", ()))).apply(df)
