"""Exact quantiles by counts alone.

``percentile`` sends a value-to-count map of the whole column to one reducer, which cannot work for
billions of distinct doubles.  Here a sketch brackets every wanted order statistic, and passes over the
table narrow the brackets: the values of a bracket are counted in bins of equal width, with the least and
greatest value of each bin, and the bin that holds the wanted rank becomes the next bracket.

Bins are cut in the doubles' own order: a double's 64 bits, read as an integer, grow with its value, so a
bin holds as many possible doubles whatever their size.  Each pass takes the next dozen bits, so after six
at most a bin is a single value, however the values lie; mostly the first pass is the last, because a rank
that is the first, the second or the last of its bin is known.  No value list is ever gathered, what reaches
the driver is at most ``BINS`` counts per quantile, and the counts are exact, so a bracket that missed its
target is noticed and opened to the column's whole range.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableprep.functions.types import as_double, dtype_of
from tableprep.session import together

ACCURACY = 10_000
COLLECT_LIMIT = 50_000  # columns of fewer values are not sketched
SLOTS_PER_JOB = 90
SMALL_TABLE_ROWS = 20_000_000
SIDE_BY_SIDE = 4
BINS = 4096


@dataclass
class Target:
    """One wanted quantile: ranks ``low_rank``/``high_rank`` (0-based) bracketed by [lo, hi]."""

    column: str
    prob: float
    rows: int
    lo: float
    hi: float
    inner: int
    floor: float = 0.0
    ceiling: float = 0.0
    offset: int = 0  # of the column's values, those left out below the ones that are looked at
    value: float | None = field(default=None)

    @property
    def position(self) -> float:
        return self.prob * (self.rows - 1)

    @property
    def ranks(self) -> tuple[int, int]:
        return math.floor(self.position) - self.offset, math.ceil(self.position) - self.offset


def bracket_probs(probs: list[float], accuracy: int = ACCURACY) -> list[float]:
    """Percentages whose sketched values enclose ``probs`` under the sketch's rank error."""
    step = 2.0 / accuracy
    out: list[float] = []
    for p in probs:
        out += [max(0.0, p - step), min(1.0, p + step)]
    return out


def sketch(column: Column, probs: list[float], accuracy: int = ACCURACY) -> Column:
    return F.percentile_approx(column, bracket_probs(probs, accuracy), accuracy)


def make_targets(
    column: str,
    probs: list[float],
    rows: int,
    low: float,
    high: float,
    sketched: list[float] | None,
    accuracy: int = ACCURACY,
) -> list[Target]:
    out = []
    for i, p in enumerate(probs):
        if sketched is None or rows <= COLLECT_LIMIT:
            lo, hi, inner = low, high, rows
        else:
            lo, hi = float(sketched[2 * i]), float(sketched[2 * i + 1])
            inner = math.ceil(6 * rows / accuracy) + 2
        out.append(Target(column, p, rows, lo, hi, inner, floor=low, ceiling=high))
    return out


def _interpolate(a: float, b: float, position: float) -> float:
    return a if a == b else a + (b - a) * (position - math.floor(position))


def order_key(value: float) -> int:
    """The bits of a double as an integer that grows with the value; both zeros are 0."""
    magnitude = int.from_bytes(struct.pack(">d", abs(value)))
    return -magnitude if value < 0 else magnitude


def order_keys(v: Column) -> Column:
    """``order_key`` of a column, from exponent and fraction; every step is exact in doubles."""
    m = F.abs(v)
    guess = F.floor(F.log2(m)).cast("int")
    power = lambda e: F.pow(F.lit(2.0), e)
    down = guess - F.when(power(guess) > m, 1).otherwise(0)
    exponent = down + F.when(power(down + 1) <= m, 1).otherwise(0)
    fraction = ((m / power(exponent) - 1.0) * 2.0**52).cast("bigint")
    normal = F.shiftleft((exponent + 1023).cast("bigint"), 52) + fraction
    least = (m * 2.0**537 * 2.0**537).cast("bigint")
    magnitude = (
        F.when(m == math.inf, F.lit(0x7FF << 52).cast("bigint")).when(m < 2.0**-1022, least).otherwise(normal)
    )
    return F.when(v < 0, -magnitude).otherwise(magnitude)


def bin_shift(lo: float, hi: float, bins: int) -> tuple[int, int]:
    """How many low bits of a key to leave out so that [lo, hi] has at most ``bins`` bins, and the first bin."""
    low, high, shift = order_key(lo), order_key(hi), 0
    while (high >> shift) - (low >> shift) + 1 > bins:
        shift += 1
    return shift, low >> shift


def solve(df: DataFrame, targets: list[Target], accuracy: int = ACCURACY, limit: int = BINS) -> None:
    """Fill in ``value`` of every target with at most ``limit`` bins each; jobs are per pass, not per target."""
    pending = [t for t in targets if t.rows > 0]
    for t in pending:
        if t.floor == t.ceiling:
            t.value = t.floor
    pending = [t for t in pending if t.value is None]
    while pending:
        size = SLOTS_PER_JOB
        if pending[0].rows <= SMALL_TABLE_ROWS:
            size = min(size, 3 * math.ceil(len(pending) / (3 * SIDE_BY_SIDE)))
        batches = [pending[i : i + size] for i in range(0, len(pending), size)]
        together(*[partial(_one_pass, df, batch, max(limit, 3)) for batch in batches])
        pending = [t for t in pending if t.value is None]


def solve_counts(counted: DataFrame, targets: list[Target], limit: int = BINS) -> None:
    """Fill in ``value`` of every target from values with counts: rows ``(c, v, n)``, ``c`` the target's number."""
    numbers = {id(t): i for i, t in enumerate(targets)}
    pending = targets
    while pending:
        for start in range(0, len(pending), SLOTS_PER_JOB):
            batch = pending[start : start + SLOTS_PER_JOB]
            place = {numbers[id(t)]: k for k, t in enumerate(batch)}
            local = F.element_at(F.array(*[F.lit(place.get(i)).cast("int") for i in range(len(targets))]), F.col("c") + 1)
            long = counted.select(local.alias("c"), "v", "n").filter("c IS NOT NULL AND v IS NOT NULL")
            _pass_over(long, batch, [[k] for k in range(len(batch))], max(limit, 3))
        pending = [t for t in pending if t.value is None]


def _one_pass(df: DataFrame, batch: list[Target], bins: int) -> None:
    """One pass over the columns of the targets.

    Columns are stacked to ``(c, v)`` and brackets looked up by ``c``, so the generated code stays
    small however many columns there are.
    """
    columns = list(dict.fromkeys(t.column for t in batch))
    of_column = [[i for i, t in enumerate(batch) if t.column == c] for c in columns]
    stacked = F.array(*[as_double(c, dtype_of(df, c)) for c in columns])
    long = df.select(F.posexplode(stacked).alias("c", "v")).filter("v IS NOT NULL")
    _pass_over(long, batch, of_column, bins)


def _pass_over(long: DataFrame, batch: list[Target], of_column: list[list[int]], bins: int) -> None:
    """Count below the brackets, on their ends, and in the bins between; values may have counts ``n``."""
    counts, found = together(
        lambda: _end_counts(long, batch, of_column),
        lambda: _bin_counts(long, batch, of_column, bins),
    )
    for i, t in enumerate(batch):
        below, at_lo, at_hi = counts[i]
        inner = sorted(found.get(i, []))
        _advance(t, below, [(-1, at_lo, t.lo, t.lo), *inner, (bins, at_hi, t.hi, t.hi)])


def _ends(batch: list[Target], of_column: list[list[int]], end: str, w: int) -> Column:
    """The ``w``-th bracket end of the row's column; NaN, which no value is below or reaches, where there is none."""
    ends = [float(getattr(batch[ids[w]], end)) if w < len(ids) else math.nan for ids in of_column]
    return F.element_at(F.array(*[F.lit(e) for e in ends]), F.col("c") + 1)


def _end_counts(long: DataFrame, batch: list[Target], of_column: list[list[int]]) -> dict[int, tuple[int, int, int]]:
    """Values below each bracket, on its lower end and on its upper one (0 where that is the same)."""
    v, counts = F.col("v"), []
    for w in range(max(len(ids) for ids in of_column)):
        lo, hi = _ends(batch, of_column, "lo", w), _ends(batch, of_column, "hi", w)
        for name, hit in (("b", v < lo), ("l", v == lo), ("h", (v == hi) & (lo < hi))):
            count = F.sum(F.when(hit, F.col("n")).otherwise(0)) if "n" in long.columns else F.count_if(hit)
            counts.append(count.alias(f"{name}{w}"))
    rows = {r["c"]: r for r in long.groupBy("c").agg(*counts).collect()}  # one row per column
    return {
        i: tuple(rows[k][f"{x}{w}"] for x in "blh") if k in rows else (0, 0, 0)
        for k, ids in enumerate(of_column)
        for w, i in enumerate(ids)
    }


def _bin_counts(
    long: DataFrame, batch: list[Target], of_column: list[list[int]], bins: int
) -> dict[int, list[tuple[int, int, float, float]]]:
    """Per target the bins between its bracket's ends that have values: (bin, values, least, greatest)."""
    if all(t.lo == t.hi for t in batch):
        return {}
    v = F.col("v")
    hits, any_inside = [], F.lit(False)
    for w in range(max(len(ids) for ids in of_column)):
        lo, hi = _ends(batch, of_column, "lo", w), _ends(batch, of_column, "hi", w)
        inside = (v > lo) & (v < hi)
        targets = F.array(*[F.lit(ids[w] if w < len(ids) else -1) for ids in of_column])
        hits.append(F.when(inside, F.element_at(targets, F.col("c") + 1)))
        any_inside = any_inside | inside
    slots = F.explode(F.array_compact(F.array(*hits))).alias("slot")
    weight = F.col("n") if "n" in long.columns else F.lit(1)
    found = long.filter(any_inside).select("v", weight.alias("n"), order_keys(v).alias("key"), slots)
    cuts = [bin_shift(t.lo, t.hi, bins) for t in batch]
    shift = F.element_at(F.array(*[F.lit(s) for s, _ in cuts]), F.col("slot") + 1)
    first = F.element_at(F.array(*[F.lit(b).cast("bigint") for _, b in cuts]), F.col("slot") + 1)
    binned = found.select("slot", "v", "n", (F.call_function("shiftright", F.col("key"), shift) - first).cast("int").alias("bin"))
    counted = binned.groupBy("slot", "bin").agg(F.sum("n").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    out: dict[int, list[tuple[int, int, float, float]]] = {}
    for slot, bin_, n, least, most in counted.collect():  # at most ``bins`` rows per target
        out.setdefault(slot, []).append((bin_, n, least, most))
    return out


def _advance(t: Target, below: int, found: list[tuple[int, int, float, float]]) -> None:
    """Read the value off the bins, or narrow the bracket to the bin that holds it."""
    first, last = t.ranks
    if first < below or last >= below + sum(n for _, n, _, _ in found):
        if (t.lo, t.hi) == (t.floor, t.ceiling):
            raise RuntimeError(f"values of {t.column!r} lie outside of its range; NaN left?")
        t.lo, t.hi = t.floor, t.ceiling
        return
    known = {}
    for _, n, least, most in found:
        for rank in {first, last} - known.keys():
            if n and rank == below or (below < rank < below + n and least == most):
                known[rank] = least
            elif rank == below + n - 1:
                known[rank] = most
            elif below < rank < below + n:
                t.lo, t.hi = least, most
                return
        below += n
    t.value = _interpolate(known[first], known[last], t.position)
