"""Column expressions shared by the batch operators and the streams: all built-in, all null-aware."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tableprep.functions.types import INTEGER_RANGE, col


def number_literal(value: float | int, dtype: str) -> Column:
    """A statistic as a literal of the column's type; integers are rounded half to even."""
    if dtype in INTEGER_RANGE:
        low, high = INTEGER_RANGE[dtype]
        return F.lit(min(max(round(value), low), high)).cast(dtype)
    return F.lit(float(value)).cast(dtype)


def clamp(name: str, low: float, high: float, dtype: str) -> Column:
    """Values outside [low, high] move to the bound; nulls stay (``least``/``greatest`` skip nulls)."""
    c, lo, hi = col(name), number_literal(low, dtype), number_literal(high, dtype)
    return F.when(c < lo, lo).when(c > hi, hi).otherwise(c)


def outside(x: Column, low: float, high: float) -> Column:
    """True strictly outside [low, high]; a null is never outside."""
    return F.coalesce((x < F.lit(float(low))) | (x > F.lit(float(high))), F.lit(False))


def far_from_mean(x: Column, mean: float, std: float | None, threshold: float) -> Column:
    """|x - mean| / std > threshold; a null or a column without spread never is."""
    if not std:
        return F.lit(False)
    return F.coalesce(F.abs(x - F.lit(float(mean))) / F.lit(float(std)) > F.lit(float(threshold)), F.lit(False))


def cut(x: Column, bins: list[float], labels: list[str]) -> Column:
    """Right-closed intervals: (bins[i], bins[i+1]] gets labels[i]; outside is null."""
    if len(bins) != len(labels) + 1:
        raise ValueError("cut needs one label per interval")
    out = F.when((x > bins[0]) & (x <= bins[1]), labels[0])
    for low, high, label in zip(bins[1:], bins[2:], labels[1:]):
        out = out.when((x > low) & (x <= high), label)
    return out


def standardised(x: Column, mean: float | None, std_pop: float | None) -> Column:
    """(x - mean) / population std; a constant column is only centred."""
    if mean is None:
        return F.lit(None).cast("double")
    return (x.cast("double") - F.lit(float(mean))) / F.lit(float(std_pop) if std_pop else 1.0)


def min_max_scaled(x: Column, low: float | None, high: float | None) -> Column:
    """(x - min) / (max - min); a constant column becomes 0."""
    if low is None:
        return F.lit(None).cast("double")
    spread = float(high) - float(low)
    return (x.cast("double") - F.lit(float(low))) / F.lit(spread if spread else 1.0)


def histogram_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """Index of the equal-width bin, 0-based; the last bin is closed.

    The quotient can land one bin off next to an edge, so it is settled against the edges themselves.
    """
    if low == high:
        low, high = low - 0.5, high + 0.5
    edges = bin_edges(low, high, bins)
    at = F.array(*[F.lit(e) for e in edges])
    guess = F.least(F.floor((x - F.lit(low)) / F.lit(high - low) * F.lit(float(bins))).cast("int"), F.lit(bins - 1))
    return (
        F.when(x.isNull(), None)
        .when(x < F.element_at(at, guess + 1), guess - 1)
        .when((guess < bins - 1) & (x >= F.element_at(at, guess + 2)), guess + 1)
        .otherwise(guess)
    )


def bin_edges(low: float, high: float, bins: int) -> list[float]:
    if low == high:
        low, high = low - 0.5, high + 0.5
    step = (high - low) / bins
    return [low + i * step for i in range(bins)] + [high]
