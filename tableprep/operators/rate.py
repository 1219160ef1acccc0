"""Request-rate audit over an event log.

The number of requests in the window before each one is a difference of two running counts: every
request adds one at its time and takes it away one window later.  Running counts are cut into even
ranges (``ordered.py``), so neither a busy user nor a burst ends up in one task, and the cost per
row does not depend on how many requests a window holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.functions.types import col, dtype_of
from tableprep.operators.ordered import RANGE, ROWS_PER_RANGE, running, with_ranges
from tableprep.session import written

# The limits that apply unless others are given.
DEFAULT_LIMIT = 100
DEFAULT_WINDOW_SECONDS = 60
MICROS = 1_000_000


def micros(df: DataFrame, ts: str) -> Column:
    """Time as microseconds since the epoch; zone-less times count as UTC, whatever the session zone."""
    c, dtype = col(ts), dtype_of(df, ts)
    if isinstance(dtype, T.LongType):
        return c
    if not isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(c.cast("timestamp"))
    days = F.datediff(c.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (F.hour(c) * 60 + F.minute(c)).cast("bigint")
    seconds = F.date_part(F.lit("SECOND"), c) * MICROS
    return (days * 86_400 + minutes * 60) * MICROS + seconds.cast("bigint")


def _windowed(
    df: DataFrame, user: str, ts: str, tie: str, window_seconds: int, rows_per_range: int, oldest: bool
) -> DataFrame:
    """``df`` plus ``__t`` and ``prior`` (and ``__oldest``), on a large table also its ranges over (user, time, tie)."""
    marked = df.withColumn("__t", micros(df, ts))
    leaves = F.col("__t") + F.lit(window_seconds * MICROS)
    arrivals = marked.select("*", F.lit(1).alias("__kind"), F.lit(None).cast("bigint").alias("__leaves"))
    expiries = marked.select(
        *[(col(c) if c in (user, tie) else F.lit(None).cast(dtype_of(df, c)).alias(c)) for c in df.columns],
        leaves.alias("__t"),
        F.lit(0).alias("__kind"),
        leaves.alias("__leaves"),
    )
    # At equal times an expiry comes first: the window is open on its left.
    order = ["__t", "__kind", tie]
    counted = running(
        with_ranges(arrivals.unionAll(expiries), [user, *order], 2 * rows_per_range),
        [user],
        order,
        sums={"__open": F.when(F.col("__kind") == 1, 1).otherwise(-1)},
        nexts={"__next": F.col("__leaves")} if oldest else None,
        rows_per_range=None,
    )
    extra = [(F.col("__next") - F.lit(window_seconds * MICROS)).alias("__oldest")] if oldest else []
    extra += [F.col(RANGE)] if RANGE in counted.columns else []
    prior = (F.col("__open") - 1).cast("bigint").alias("prior")
    return counted.filter("__kind = 1").select(*[col(c) for c in df.columns], "__t", prior, *extra)


def sliding_counts(
    df: DataFrame,
    user: str,
    ts: str,
    tie: str,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``prior``: the user's earlier requests in the window (t - window, t], rejected ones too.

    ``tie`` is a unique column that orders requests of the same instant.
    """
    return _windowed(df, user, ts, tie, window_seconds, rows_per_range, False).drop("__t", RANGE)


def audit(
    df: DataFrame,
    user: str,
    ts: str,
    tie: str,
    limit: int = DEFAULT_LIMIT,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``prior, denied, remaining, reset, retry_after``.

    ``remaining`` is null for denied requests, ``retry_after`` for admitted ones.
    """
    counted = _windowed(df, user, ts, tie, window_seconds, rows_per_range, True)
    leaves = F.lit(window_seconds * MICROS)
    denied = F.col("prior") >= limit
    wait = F.floor((F.col("__oldest") + leaves - F.col("__t")) / F.lit(MICROS)).cast("bigint") + 1
    return counted.select(
        *[col(c) for c in df.columns],
        "prior",
        denied.alias("denied"),
        F.when(~denied, F.lit(limit - 1).cast("bigint") - F.col("prior")).alias("remaining"),
        F.floor((F.col("__t") + leaves) / F.lit(MICROS)).cast("bigint").alias("reset"),
        F.when(denied, F.greatest(F.lit(1).cast("bigint"), wait)).alias("retry_after"),
    )


def admission(
    df: DataFrame,
    user: str,
    ts: str,
    tie: str,
    limit: int = DEFAULT_LIMIT,
    window_seconds: int = DEFAULT_WINDOW_SECONDS,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``admitted``: a request is admitted while fewer than ``limit`` admitted ones lie in its window.

    A request with fewer than ``limit`` requests of any kind before it is admitted in every case.
    Only the others need to be replayed in order, each with the window before it.  Where two of them are
    a window or more apart, all that could matter in between is admitted, so the state is known there:
    the episodes between such places are replayed independently.  Spark sorts an episode; the replay
    reads it as a stream of batches and keeps at most ``limit`` times, so no group is held in memory.
    """
    width = window_seconds * MICROS
    counted = _windowed(df, user, ts, tie, window_seconds, rows_per_range, False)
    shared = {"rows_per_range": None}

    def staged(frame: DataFrame, label: str) -> DataFrame:
        # On a large table every running pass would otherwise repeat the ones before it.
        return written(frame, label) if RANGE in frame.columns else frame

    sure = F.col("prior") < limit
    ahead = staged(
        running(counted, [user], ["__t", tie], nexts={"__doubt": F.when(~sure, F.col("__t"))}, **shared), "audit"
    )
    contested = F.coalesce(F.col("__doubt") - F.col("__t") < width, F.lit(False))
    calm = ahead.filter(~contested).select(*[col(c) for c in df.columns], F.lit(True).alias("admitted"))
    doubtful = running(
        ahead.filter(contested),
        [user],
        ["__t", tie],
        previous={"__before": F.when(~sure, F.col("__t")), "__after_sure": sure},
        **shared,
    )
    # The first contested request behind a doubtful one (or of all), when the next doubtful one is far.
    first = ~F.coalesce(F.col("__after_sure"), F.lit(False))
    apart = ~F.coalesce(F.col("__doubt") - F.col("__before") < width, F.lit(False))
    starts = F.when(first & apart, 1).otherwise(0)
    episodes = staged(
        running(doubtful, [user], ["__t", tie], sums={"__episode": starts}, **shared), "episodes"
    ).select(*[col(c) for c in df.columns], "__t", "__episode", sure.alias("__sure"))
    sorted_rows = episodes.repartition(col(user), F.col("__episode")).sortWithinPartitions(
        col(user), "__episode", "__t", col(tie)
    )
    schema = T.StructType([*episodes.schema.fields, T.StructField("admitted", T.BooleanType())])
    replayed = sorted_rows.mapInArrow(_replay(user, limit, width), schema)
    return calm.unionAll(replayed.select(*[col(c) for c in df.columns], "admitted"))


def _replay(user: str, limit: int, width: int):
    """Walk sorted requests; the state is the admitted times of the current episode's last window.

    Works on Arrow batches and only appends a column, so the user's own columns pass unchanged.
    """

    def walk(batches):
        from collections import deque

        import pyarrow as pa

        current, times = None, deque()
        for batch in batches:
            admitted = []
            for who, episode, now, sure in zip(
                batch.column(user).to_pylist(),
                batch.column("__episode").to_pylist(),
                batch.column("__t").to_pylist(),
                batch.column("__sure").to_pylist(),
            ):
                if (who, episode) != current:
                    current, times = (who, episode), deque()
                while times and times[0] <= now - width:
                    times.popleft()
                ok = sure or len(times) < limit
                if ok:
                    times.append(now)
                admitted.append(ok)
            yield batch.append_column("admitted", pa.array(admitted, pa.bool_()))

    return walk
