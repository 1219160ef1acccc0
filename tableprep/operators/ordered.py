"""Running values over an order, without one task per key.

``Window.partitionBy(key).orderBy(t)`` puts a whole key, or with no key the whole table, into one
task.  Here the table is first sorted by (key, order) across partitions and written; a row's place
(its partition, and how many rows stand before it there) tells its range, so all ranges but a
partition's last have the same number of rows, whatever the keys.  The window runs inside a range, and
what earlier ranges of the same key contribute is carried in.  A range boundary interrupts at most one
key, so the carry table has at most two rows per range.  No split point ever becomes part of a plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from tableprep.functions.types import MOMENTS, col, dtype_of, is_number, is_text
from tableprep.operators.frequencies import short_key
from tableprep.session import written

ROWS_PER_RANGE = 2_000_000
RANGE = "__range"
PLACE = "__place"
ROW_BITS = 33  # of a place: the lower ones count the rows of a partition, the upper ones are the partition


def sorted_places(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """The rows sorted by ``by`` across partitions, written once, with their ``PLACE``, which grows with the order."""
    keys = [col(c) for c in by]
    ordered = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ordered.withColumn(PLACE, F.monotonically_increasing_id()), label)


def with_ranges(df: DataFrame, by: Sequence[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add each row's range, a number that grows with the order of ``by``.

    A table of one range is returned as it is, without the column.
    """
    if df.count() <= rows_per_range:
        return df
    rows = F.col(PLACE).bitwiseAND((1 << ROW_BITS) - 1)
    range_ = F.col(PLACE) - rows + F.floor(rows / F.lit(rows_per_range))
    return sorted_places(df, by, "ranges").withColumn(RANGE, range_).drop(PLACE)


def numbered(df: DataFrame, order: Sequence[str], name: str, label: str = "numbered") -> DataFrame:
    """Add the number of rows before each row in ``order``, which must be total: one sort, no window."""
    placed = sorted_places(df, order, label)
    part = F.shiftright(PLACE, ROW_BITS)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__rows"))  # one row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    joined = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    at = F.col("__start") + F.col(PLACE).bitwiseAND((1 << ROW_BITS) - 1)
    return joined.select(*[col(c) for c in df.columns], at.alias(name))


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    sums: dict[str, Column] | None = None,
    lasts: dict[str, Column] | None = None,
    previous: dict[str, Column] | None = None,
    nexts: dict[str, Column] | None = None,
    rows_per_range: int | None = ROWS_PER_RANGE,
) -> DataFrame:
    """Add, for each row in ``order`` within ``keys``:

    ``sums``: the total up to and including the row; ``lasts``: the last non-null value up to and
    including it; ``previous``: the same, before it; ``nexts``: the first non-null value from it on.

    ``order`` must be total within a key: add a unique column when ties are possible.  A table that
    ``with_ranges`` has cut by ``keys + order`` (or by columns between them that the rows left do not
    differ in) is not cut again and keeps its ranges; ``rows_per_range=None`` says that it is small.
    """
    sums, lasts, previous, nexts = dict(sums or {}), dict(lasts or {}), dict(previous or {}), dict(nexts or {})
    given = df.columns
    if RANGE not in given and rows_per_range is not None:
        df = with_ranges(df, [*keys, *order], rows_per_range)
    ranged = RANGE in df.columns
    wanted = {
        **{n: ("sum", e) for n, e in sums.items()},
        **{n: ("last", e) for n, e in lasts.items()},
        **{n: ("previous", e) for n, e in previous.items()},
        **{n: ("next", e) for n, e in nexts.items()},
    }
    kinds = [kind for kind, _ in wanted.values()]
    tags = [short_key(col(k)) if is_text(dtype_of(df, k)) else col(k) for k in keys]
    named = df.select(
        "*",
        *[e.alias(f"__x{i}") for i, (_, e) in enumerate(wanted.values())],
        *[tag.alias(f"__k{i}") for i, tag in enumerate(tags)],
    )
    inside = Window.partitionBy(*[col(c) for c in keys], *([RANGE] if ranged else [])).orderBy(*[col(c) for c in order])
    frames = {
        "sum": inside.rowsBetween(Window.unboundedPreceding, 0),
        "last": inside.rowsBetween(Window.unboundedPreceding, 0),
        "previous": inside.rowsBetween(Window.unboundedPreceding, -1),
        "next": _reversed(keys, order, ranged).rowsBetween(Window.unboundedPreceding, 0),
    }
    local = named.select(
        *[col(c) for c in df.columns],
        *[f"__k{i}" for i in range(len(keys))],
        *[
            (F.sum(f"__x{i}") if kind == "sum" else F.last(f"__x{i}", True)).over(frames[kind]).alias(f"__r{i}")
            for i, kind in enumerate(kinds)
        ],
    )
    if not ranged:
        return local.select(*[col(c) for c in given], *[F.col(f"__r{i}").alias(n) for i, n in enumerate(wanted)])
    carry = _carry(named, len(keys), order, kinds)
    same_place = F.col(f"a.{RANGE}") == F.col(f"b.{RANGE}")
    for i in range(len(keys)):
        same_place = same_place & F.col(f"a.__k{i}").eqNullSafe(F.col(f"b.__k{i}"))
    # At most two rows per range and short keys; with fixed-width values that bounds the bytes too.
    carried = (f.dataType for f in carry.schema.fields if f.name.startswith("__c"))
    if all(is_number(t) or isinstance(t, (T.BooleanType, *MOMENTS)) for t in carried):
        carry = F.broadcast(carry)
    joined = local.alias("a").join(carry.alias("b"), same_place, "left")

    def total(i: int, kind: str) -> Column:
        here, carried = F.col(f"a.__r{i}"), F.col(f"b.__c{i}")
        return here + F.coalesce(carried, F.lit(0)) if kind == "sum" else F.coalesce(here, carried)

    return joined.select(
        *[F.col(f"a.`{c.replace('`', '``')}`").alias(c) for c in given],
        *[total(i, kind).alias(n) for i, (n, kind) in enumerate(zip(wanted, kinds))],
    )


def _reversed(keys: Sequence[str], order: Sequence[str], ranged: bool) -> WindowSpec:
    """The same rows read backwards: a growing frame costs one step per row, a shrinking one does not."""
    return Window.partitionBy(*[col(c) for c in keys], *([RANGE] if ranged else [])).orderBy(
        *[col(c).desc() for c in order]
    )


def _carry(named: DataFrame, keys: int, order: Sequence[str], kinds: list[str]) -> DataFrame:
    """Per (key, range) of a key that spans several ranges: what the other ranges contribute."""
    tags = [f"__k{i}" for i in range(keys)]
    at = F.struct(*[col(c).alias(f"o{i}") for i, c in enumerate(order)])

    def edge(i: int, kind: str) -> Column:
        x = F.col(f"__x{i}")
        if kind == "sum":
            return F.sum(x)
        return (F.min_by if kind == "next" else F.max_by)(x, F.when(x.isNotNull(), at))

    totals = named.groupBy(*tags, RANGE).agg(
        *[edge(i, kind).alias(f"__t{i}") for i, kind in enumerate(kinds)], F.count(F.lit(1)).alias("__rows")
    )
    by_range = Window.partitionBy(*tags)
    earlier = by_range.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    later = by_range.orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)

    def carried(i: int, kind: str) -> Column:
        t = f"__t{i}"
        return F.sum(t).over(earlier) if kind == "sum" else F.last(t, True).over(later if kind == "next" else earlier)

    return totals.select(
        *tags,
        RANGE,
        F.count(F.lit(1)).over(by_range).alias("__ranges"),
        *[carried(i, kind).alias(f"__c{i}") for i, kind in enumerate(kinds)],
    ).filter("__ranges > 1")


def forward_fill(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    keys: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Replace nulls by the last earlier value in ``order`` (within ``keys``); leading nulls stay."""
    filled = running(
        df,
        keys,
        order,
        lasts={f"__f{i}": col(c) for i, c in enumerate(columns)},
        rows_per_range=rows_per_range,
    )
    at = {c: f"__f{i}" for i, c in enumerate(columns)}
    return filled.select(*[(F.col(at[c]).alias(c) if c in at else col(c)) for c in df.columns])
