"""Column statistics of a whole table in a fixed number of Spark jobs.

1. one wide aggregate: rows, nulls, min, max, mean, variance;
2. one sketch of all quartile brackets, and one pass that makes them exact (``quantiles.py``);
3. one frequency job for exact distinct counts and one per value type for modes, only when asked.

What reaches the driver is one row per column.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprep.functions.types import as_double, col, dtype_of, is_integer, kind_of
from tableprep.operators import frequencies, quantiles
from tableprep.session import together

QUARTILES = [0.25, 0.5, 0.75]
# Beyond about this width the generated code of an aggregate is too long to be compiled well.
EXPRESSIONS_PER_JOB = 80
SKETCHES_PER_JOB = 40
# A table this small may lie in one file chunk, that is in one task: its columns are then spread over
# jobs that run side by side instead.  Each reads only its own columns.
SMALL_TABLE_ROWS = 20_000_000
SIDE_BY_SIDE = 6
SLICE_ROWS = 250_000
MIN_SLICES = 4
SMALL_DISTINCT = 100


@dataclass
class ColumnStats:
    name: str
    dtype: str
    kind: str
    integer: bool
    rows: int
    nulls: int
    low: float | int | None = None
    high: float | int | None = None
    mean: float | None = None
    var_pop: float | None = None
    q1: float | None = None
    median: float | None = None
    q3: float | None = None
    distinct: int | None = None
    mode: str | None = None

    @property
    def filled(self) -> int:
        return self.rows - self.nulls

    @property
    def null_share(self) -> float:
        return self.nulls / self.rows if self.rows else 0.0

    @property
    def variance(self) -> float | None:
        """Sample variance; None below two values."""
        if self.var_pop is None or self.filled < 2:
            return None
        return 0.0 if self.low == self.high else self.var_pop * self.filled / (self.filled - 1)

    @property
    def std(self) -> float | None:
        return None if self.variance is None else math.sqrt(self.variance)

    @property
    def std_pop(self) -> float | None:
        if self.var_pop is None:
            return None
        return 0.0 if self.low == self.high else math.sqrt(self.var_pop)

    @property
    def iqr(self) -> float | None:
        return None if self.q1 is None else self.q3 - self.q1

    @property
    def fences(self) -> tuple[float, float] | None:
        if self.q1 is None:
            return None
        return self.q1 - 1.5 * self.iqr, self.q3 + 1.5 * self.iqr

    @property
    def constant(self) -> bool:
        """At most one distinct value, known without counting when min and max are."""
        if self.filled == 0:
            return True
        if self.distinct is not None:
            return self.distinct <= 1
        return self.kind == "number" and self.low == self.high

    @property
    def unique(self) -> bool:
        """Every row has its own value.  An uncounted column is known to repeat one."""
        return self.distinct is not None and self.distinct == self.rows

    def at_most(self, n: int) -> bool:
        """At most ``n`` distinct values.  An uncounted text column is known to have many."""
        return self.distinct is not None and self.distinct <= n


@dataclass
class Profile:
    rows: int
    columns: dict[str, ColumnStats]

    def __getitem__(self, name: str) -> ColumnStats:
        return self.columns[name]

    def __iter__(self):
        return iter(self.columns.values())

    def of_kind(self, *kinds: str) -> list[ColumnStats]:
        return [c for c in self.columns.values() if c.kind in kinds]


def profile(
    df: DataFrame,
    columns: Iterable[str] | None = None,
    *,
    quartiles: Iterable[str] | None = None,
    distinct: Iterable[str] | None = (),
    modes: Iterable[str] = (),
    screen: bool = False,
    approx_quartiles: bool = False,
    approx_distinct: bool = False,
    known: Profile | None = None,
) -> Profile:
    """Profile ``columns`` (all by default) of a table whose NaNs are already null.

    ``quartiles``: number columns that need them (None: all, empty: none).
    ``distinct``: columns to count exactly (None: all).  With ``screen`` a column stays uncounted
    when a slice of its values already proves that it is neither unique nor of few values.
    ``modes``: columns whose most frequent value is needed.
    ``approx_quartiles``: settle for sketched quartiles and save a pass.
    ``approx_distinct``: settle for estimated distinct counts (5 % off) and save the shuffle.
    ``known``: a profile whose columns are unchanged in ``df``; their basic statistics are taken over.
    """
    names = list(df.columns if columns is None else columns)
    stats = {}
    for name in names:
        dtype = dtype_of(df, name)
        stats[name] = ColumnStats(name, dtype.simpleString(), kind_of(dtype), is_integer(dtype), 0, 0)
    numbers = {n for n in names if stats[n].kind == "number"}
    wanted_quartiles = numbers if quartiles is None else numbers & set(quartiles)
    wanted_distinct = [n for n in names if stats[n].kind != "other" and (distinct is None or n in set(distinct))]
    for name, s in (known.columns if known else {}).items():
        if name in stats:
            stats[name] = replace(s)
    fresh = [s for s in stats.values() if known is None or s.name not in known.columns]
    count_distinct = frequencies.estimated_counts if approx_distinct else frequencies.distinct_counts

    def numbers() -> tuple[int, dict[str, int]]:
        """Moments, then what needs them: quartiles beside the screened distinct counts."""
        rows = _moments(df, fresh) if fresh or known is None else known.rows
        pending = [s for s in stats.values() if s.name in wanted_quartiles and s.filled and s.q1 is None]
        _, screened = together(
            lambda: _quartiles(df, pending, approx_quartiles),
            lambda: count_distinct(df, _screened(df, stats, wanted_distinct, rows) if screen else []),
        )
        return rows, screened

    (rows, screened), counts, most = together(
        numbers,
        lambda: count_distinct(df, [] if screen else wanted_distinct),
        lambda: frequencies.modes(df, [n for n in modes if stats[n].kind != "other"]),
    )
    for name, count in {**counts, **screened}.items():
        stats[name].distinct = count
    for name, value in most.items():
        stats[name].mode = value
    return Profile(rows, stats)


def _screened(df: DataFrame, stats: dict[str, ColumnStats], names: list[str], rows: int) -> list[str]:
    """Drop the columns whose exact count cannot change a decision.

    The slice keeps all copies of one value in every ``step`` (by hash), so a repeat inside it proves
    that the column is not unique, and its distinct count is a floor for the column's.
    """
    open_names = []
    for name in names:
        s = stats[name]
        if s.kind == "number" and s.low == s.high:
            s.distinct = min(s.filled, 1)
        elif s.kind != "number" or not s.nulls:
            open_names.append(name)
    step = rows // SLICE_ROWS
    if step < MIN_SLICES:
        return open_names
    left = []
    for name, (floor, repeats) in frequencies.sliced_counts(df, open_names, step).items():
        maybe_unique = not repeats and not stats[name].nulls
        maybe_small = stats[name].kind != "number" and floor <= SMALL_DISTINCT
        if maybe_unique or maybe_small:
            left.append(name)
    return left


def _moments(df: DataFrame, stats: list[ColumnStats]) -> int:
    """Rows of the table; nulls, range, mean and variance of its columns.

    One aggregate with a few expressions per column, as long as it stays narrow.  A wide table's
    columns are stacked to ``(c, v)`` and grouped by ``c`` instead: the same code for every column.
    """
    numbers = [s for s in stats if s.kind == "number"]
    if 1 + len(stats) + 4 * len(numbers) <= EXPRESSIONS_PER_JOB:
        return _narrow_moments(df, stats)
    others = [s for s in stats if s.kind != "number"]
    chunks = [others[i : i + EXPRESSIONS_PER_JOB] for i in range(0, len(others), EXPRESSIONS_PER_JOB)] or [[]]
    rows, found = together(lambda: [_narrow_moments(df, chunk) for chunk in chunks][0], lambda: _stacked_moments(df, numbers))
    for s in numbers:
        filled, low, high, s.mean, s.var_pop, whole_low, whole_high = found.get(s.name, (0, *[None] * 6))
        s.low, s.high = (whole_low, whole_high) if s.integer else (low, high)
        s.rows, s.nulls = rows, rows - filled
    return rows


def _narrow_moments(df: DataFrame, stats: list[ColumnStats]) -> int:
    exprs = [F.count(F.lit(1)).alias("rows")]
    for i, s in enumerate(stats):
        exprs.append(F.count(col(s.name)).alias(f"n{i}"))
        if s.kind == "number":
            x = as_double(s.name, dtype_of(df, s.name))
            exact = col(s.name) if s.integer else x
            exprs += [F.min(exact).alias(f"lo{i}"), F.max(exact).alias(f"hi{i}")]
            exprs += [F.avg(x).alias(f"m{i}"), F.var_pop(x).alias(f"v{i}")]
    row = df.agg(*exprs).first()
    for i, s in enumerate(stats):
        s.rows, s.nulls = row["rows"], row["rows"] - row[f"n{i}"]
        if s.kind == "number":
            s.low, s.high, s.mean, s.var_pop = row[f"lo{i}"], row[f"hi{i}"], row[f"m{i}"], row[f"v{i}"]
    return row["rows"]


def _stacked_moments(df: DataFrame, stats: list[ColumnStats]) -> dict[str, tuple]:
    """Count, min, max, mean, variance, and the range as whole numbers, by name; without values absent."""
    cells = [
        F.struct(
            as_double(s.name, dtype_of(df, s.name)).alias("v"),
            (col(s.name) if s.integer else F.lit(None)).cast("bigint").alias("k"),
        )
        for s in stats
    ]
    long = df.select(F.posexplode(F.array(*cells)).alias("c", "x")).select("c", "x.v", "x.k").filter("v IS NOT NULL")
    wanted = [F.count("v"), F.min("v"), F.max("v"), F.avg("v"), F.var_pop("v"), F.min("k"), F.max("k")]
    rows = long.groupBy("c").agg(*[e.alias(f"a{i}") for i, e in enumerate(wanted)]).collect()
    return {stats[r["c"]].name: tuple(r)[1:] for r in rows}


def _quartiles(df: DataFrame, stats: list[ColumnStats], approx: bool) -> None:
    """Quartiles of columns that have values.

    The sketch runs apart from the moments: mixed into one aggregate it would take them out of
    generated code, which costs more than a second scan of the same columns.
    """
    if not stats:
        return
    sketches = {}
    large = [s for s in stats if s.filled > quantiles.COLLECT_LIMIT and s.low != s.high] if not approx else stats
    spread = math.ceil(len(large) / SIDE_BY_SIDE) or 1
    per_job = min(SKETCHES_PER_JOB, spread) if stats[0].rows <= SMALL_TABLE_ROWS else SKETCHES_PER_JOB

    def sketch_some(chunk: list[ColumnStats]) -> None:
        exprs = []
        for i, s in enumerate(chunk):
            x = as_double(s.name, dtype_of(df, s.name))
            at = F.percentile_approx(x, QUARTILES, quantiles.ACCURACY) if approx else quantiles.sketch(x, QUARTILES)
            exprs.append(at.alias(f"q{i}"))
        row = df.agg(*exprs).first()
        sketches.update({s.name: row[f"q{i}"] for i, s in enumerate(chunk)})

    chunks = [large[i : i + per_job] for i in range(0, len(large), per_job)]
    together(*[partial(sketch_some, chunk) for chunk in chunks])
    if approx:
        for s in stats:
            s.q1, s.median, s.q3 = sketches[s.name]
        return
    targets = {
        s.name: quantiles.make_targets(s.name, QUARTILES, s.filled, float(s.low), float(s.high), sketches.get(s.name))
        for s in stats
    }
    quantiles.solve(df, [t for group in targets.values() for t in group])
    for s in stats:
        s.q1, s.median, s.q3 = (t.value for t in targets[s.name])
