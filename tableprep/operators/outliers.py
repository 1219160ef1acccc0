"""Outliers: bounds from one profile, counts from one aggregate, treatment in one projection."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.functions.exprs import clamp, far_from_mean, number_literal, outside
from tableprep.functions.types import as_double, col, dtype_of, nan_to_null, number_columns
from tableprep.operators.profile import ColumnStats, Profile, profile
from tableprep.operators.quantiles import Target, solve_counts
from tableprep.plans.decide import MAX_OUTLIER_SHARE
from tableprep.session import scratch_scope, together, written

LOG_SCHEMA = "seq int, column string, outlier_count bigint, method string, action string"
METHODS = ("IQR", "Z-score")
QUARTILE_PAIR = (0.25, 0.75)
NEAR = 0.04  # share of a column's values kept on each side of a quartile
SMALL_ROWS = 2_000_000  # a smaller table is profiled again sooner than staged; the outcome is the same
INNER = 1.2  # in place of 1.5 in the fences that suspects are outside of
ACTIONS = {
    "cap": "Capped to upper/lower bound",
    "remove": "Removed rows",
    "replace_median": "Replaced with median",
}


def outlier_flag(s: ColumnStats, x: Column, method: str, threshold: float = 3.0) -> Column:
    if method == "IQR":
        return outside(x, *s.fences) if s.fences else F.lit(False)
    return far_from_mean(x, s.mean, s.std, threshold) if s.mean is not None else F.lit(False)


@dataclass
class OutlierStep:
    column: str
    strategy: str
    method: str
    stats: ColumnStats
    threshold: float = 3.0

    def flag(self) -> Column:
        return outlier_flag(self.stats, col(self.column).cast("double"), self.method, self.threshold)

    def expr(self) -> Column:
        s = self.stats
        if self.strategy == "cap":
            return clamp(self.column, *s.fences, s.dtype).alias(self.column)
        return F.when(self.flag(), number_literal(s.median, s.dtype)).otherwise(col(self.column)).alias(self.column)


@dataclass
class OutlierPlan:
    steps: list[OutlierStep] = field(default_factory=list)
    log: list[tuple] = field(default_factory=list)

    @property
    def stateless(self) -> bool:
        return all(s.strategy != "remove" for s in self.steps)

    def apply(self, df: DataFrame) -> DataFrame:
        df = nan_to_null(df)
        for s in self.steps:
            if s.strategy == "remove":
                df = df.filter(~s.flag())
        steps = {s.column: s for s in self.steps if s.strategy != "remove"}
        return df.select(*[steps[c].expr() if c in steps else col(c) for c in df.columns])

    def log_frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, *row) for i, row in enumerate(self.log)], LOG_SCHEMA)


def count_outliers(df: DataFrame, stats: list[ColumnStats], method: str, threshold: float = 3.0) -> dict[str, int]:
    """Outliers per column, all columns in one aggregate."""
    if not stats:
        return {}
    row = df.agg(
        *[
            F.count_if(outlier_flag(s, as_double(s.name, dtype_of(df, s.name)), method, threshold)).alias(f"o{i}")
            for i, s in enumerate(stats)
        ]
    ).first()
    return {s.name: row[f"o{i}"] for i, s in enumerate(stats)}


def _skipped(share: float, limit: float) -> str:
    return f"Skipped (outlier percentage {share:.1%} > {limit:.1%})"


def plan_outliers(
    df: DataFrame,
    method: str = "IQR",
    strategy: str = "cap",
    max_share: float = MAX_OUTLIER_SHARE,
    threshold: float = 3.0,
    stats: Profile | None = None,
) -> OutlierPlan:
    """Which columns to treat.  Unknown methods or strategies leave every column alone."""
    plan = OutlierPlan()
    if method not in METHODS:
        return plan
    df = nan_to_null(df)
    names = number_columns(df)
    if strategy == "remove":
        with scratch_scope(df.sparkSession):
            return _plan_removal(df, names, method, max_share, threshold, plan)
    quartiles = names if method == "IQR" or strategy in ("cap", "replace_median") else ()
    stats = stats or profile(df, names, quartiles=quartiles)
    open_columns = [stats[n] for n in names if not stats[n].constant]
    counts = count_outliers(df, open_columns, method, threshold)
    for s in open_columns:
        _decide(plan, s, counts[s.name], method, strategy, max_share, threshold)
    return plan


def _decide(
    plan: OutlierPlan, s: ColumnStats, count: int, method: str, strategy: str, max_share: float, threshold: float
) -> bool:
    """Log one column, add its step when it is to be treated, and say whether it is."""
    if not count:
        return False
    share = count / s.rows
    if share > max_share:
        plan.log.append((s.name, count, method, _skipped(share, max_share)))
        return False
    if strategy not in ACTIONS:
        return False
    plan.steps.append(OutlierStep(s.name, strategy, method, s, threshold))
    plan.log.append((s.name, count, method, ACTIONS[strategy]))
    return True


def _plan_removal(
    df: DataFrame, names: list[str], method: str, max_share: float, threshold: float, plan: OutlierPlan
) -> OutlierPlan:
    """Removing rows changes the statistics of the columns after it.

    All columns still open are judged together; only when one really loses rows are the ones after it
    judged again: by IQR on a large table from what was staged at the first removal, else from a new profile.
    """
    first = profile(df, names, quartiles=())
    left = [n for n in names if not first[n].constant]
    staged: StagedRemoval | None = None
    while left:
        judged = staged.judge(plan.steps, left) if staged else None
        if judged is None:
            stats = profile(df, left, quartiles=left if method == "IQR" else ())
            judged = {n: stats[n] for n in left}, count_outliers(df, [stats[n] for n in left], method, threshold)
        stats, counts = judged
        for i, name in enumerate(left):
            if _decide(plan, stats[name], counts[name], method, "remove", max_share, threshold):
                if method == "IQR" and staged is None and left[i + 1 :] and first.rows > SMALL_ROWS:
                    staged = StagedRemoval(df, {n: stats[n] for n in left}, left[i + 1 :])
                df = df.filter(~plan.steps[-1].flag())
                left = left[i + 1 :]
                break
        else:
            return plan
    return plan


class StagedRemoval:
    """What later columns need after rows were removed, read from the table once.

    Removed rows are outliers, so they all lie among the suspects: rows outside of fences a little narrower
    than the real ones, in some column.  Quartiles move little, so the new ones lie among the values near
    the old ones, which are kept with their counts.  What the removed rows held is counted in the suspects
    and taken off.  Both tables stay as they are, however many columns are treated.  Where a quartile or a
    fence has left what was staged, ``judge`` says so with None and the table itself is read again.
    """

    def __init__(self, df: DataFrame, stats: dict[str, ColumnStats], later: list[str]):
        self.stats = stats
        wide = df.select(*[as_double(n, dtype_of(df, n)).alias(n) for n in stats])
        self.inner = {n: _inner_fences(s) for n, s in stats.items() if s.fences}
        suspect = F.lit(False)
        for n, (low, high) in self.inner.items():
            suspect = suspect | F.coalesce(outside(col(n), low, high), F.lit(False))
        open_names = [n for n in later if stats[n].filled]
        near = [x for p in QUARTILE_PAIR for x in (max(0.0, p - NEAR), min(1.0, p + NEAR))]
        sketches = wide.agg(*[F.percentile_approx(col(n), near, 1000).alias(f"s{i}") for i, n in enumerate(open_names)]).first()
        self.bands = [  # (column, quartile, lowest, highest value kept)
            (n, p, float(sketches[i][2 * k]), float(sketches[i][2 * k + 1]))
            for i, n in enumerate(open_names)
            for k, p in enumerate(QUARTILE_PAIR)
        ]
        self.suspects, self.values, self.below = together(
            lambda: written(wide.filter(suspect), "suspects"),
            lambda: written(self._in_bands(wide).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n")), "near_quartiles"),
            lambda: self._counts(wide),
        )

    def _in_bands(self, wide: DataFrame) -> DataFrame:
        """``(c, v)``: values in each band, ``c`` the band's number."""
        cells = [F.when((col(n) >= low) & (col(n) <= high), col(n)) for n, _, low, high in self.bands]
        return wide.select(F.posexplode(F.array(*cells)).alias("c", "v")).filter("v IS NOT NULL")

    def _counts(self, wide: DataFrame) -> tuple:
        """Rows, and for each band the values of its column and those below it."""
        counts = [F.count(F.lit(1)).alias("rows")]
        for i, (n, _, low, _) in enumerate(self.bands):
            counts += [F.count(col(n)).alias(f"n{i}"), F.count_if(col(n) < low).alias(f"b{i}")]
        return wide.agg(*counts).first()

    def judge(self, steps: list[OutlierStep], left: list[str]) -> tuple[dict[str, ColumnStats], dict[str, int]] | None:
        """Statistics and outlier counts of the columns left, without the rows that ``steps`` remove."""
        gone = F.lit(False)
        for step in steps:
            gone = gone | F.coalesce(step.flag(), F.lit(False))
        removed = self.suspects.filter(gone)
        lost = self._counts(removed)
        targets, numbers = [], []
        for i, (n, p, low, high) in enumerate(self.bands):
            filled = self.below[f"n{i}"] - lost[f"n{i}"]
            if n in left and filled:
                offset = self.below[f"b{i}"] - lost[f"b{i}"]
                targets.append(Target(n, p, filled, low, high, 0, low, high, offset))
                numbers.append(i)
        taken = self._in_bands(removed).select("c", "v", F.lit(-1).cast("bigint").alias("n"))
        kept = self.values.select("c", "v", "n").unionAll(taken).groupBy("c", "v").agg(F.sum("n").alias("n")).filter("n > 0")
        place = F.element_at(F.array(*[F.lit(numbers.index(i) if i in numbers else None).cast("int") for i in range(len(self.bands))]), F.col("c") + 1)
        kept = written(kept.select(place.alias("c"), "v", "n").filter("c IS NOT NULL"), "kept_values")
        sizes = {r["c"]: r["n"] for r in kept.groupBy("c").agg(F.sum("n").alias("n")).collect()}  # one row per band
        if any(t.ranks[0] < 0 or t.ranks[1] >= sizes.get(k, 0) for k, t in enumerate(targets)):
            return None
        solve_counts(kept, targets)
        rows = self.below["rows"] - lost["rows"]
        stats = {n: replace(self.stats[n], rows=rows, nulls=rows, q1=None, median=None, q3=None) for n in left}
        for t in targets:
            s = stats[t.column]
            s.nulls = rows - t.rows
            s.q1, s.q3 = (t.value, s.q3) if t.prob == QUARTILE_PAIR[0] else (s.q1, t.value)
        for s in stats.values():
            if s.fences and not (s.fences[0] <= self.inner[s.name][0] and self.inner[s.name][1] <= s.fences[1]):
                return None
        return stats, count_outliers(self.suspects.filter(~gone), list(stats.values()), "IQR")


def _inner_fences(s: ColumnStats) -> tuple[float, float]:
    return s.q1 - INNER * s.iqr, s.q3 + INNER * s.iqr


def treat_outliers(df: DataFrame, method: str = "IQR", strategy: str = "cap", **options) -> tuple[DataFrame, DataFrame]:
    """Treated table and its log ``(seq, column, outlier_count, method, action)``."""
    plan = plan_outliers(df, method, strategy, **options)
    return plan.apply(df), plan.log_frame(df.sparkSession)


def detect_outliers(df: DataFrame, column: str, method: str = "IQR", threshold: float = 3.0) -> DataFrame:
    """The table with a boolean ``is_outlier`` for one column."""
    df = nan_to_null(df)
    s = profile(df, [column], quartiles=[column] if method == "IQR" else ())[column]
    return df.withColumn("is_outlier", outlier_flag(s, as_double(column, dtype_of(df, column)), method, threshold))


def treat_column(df: DataFrame, column: str, strategy: str, method: str = "IQR", threshold: float = 3.0) -> DataFrame:
    """Treat one column without the share gate."""
    df = nan_to_null(df)
    s = profile(df, [column])[column]
    return OutlierPlan([OutlierStep(column, strategy, method, s, threshold)]).apply(df)
