"""Request rates on a stream: windowed counts, and exact admission with per-user state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep.operators.rate import MICROS, micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rate_windows(
    stream: DataFrame,
    user: str,
    ts: str,
    window: str = "60 seconds",
    slide: str = "10 seconds",
    lateness: str = "10 minutes",
) -> DataFrame:
    """Requests per user and sliding window; a window is final once the watermark has passed its end.

    Requests are counted once, in panes as long as the slide, and windows are sums of finished panes; so a
    request is one row of state and of shuffle, not one for each window it lies in.  A request older than
    the watermark (the latest time less ``lateness``) is in no window.  Times without a zone are UTC,
    whatever the session zone.  ``window`` must be a multiple of ``slide``.
    """
    if pd.Timedelta(window) % pd.Timedelta(slide):
        raise ValueError(f"a window of {window} is not made of panes of {slide}")
    panes = (
        stream.select(F.col(user), F.timestamp_micros(micros(stream, ts)).alias("__ts"))
        .withWatermark("__ts", lateness)
        .groupBy(F.window("__ts", slide).alias("pane"), F.col(user))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return (
        panes.groupBy(F.window(F.window_time("pane"), window, slide).alias("w"), F.col(user))
        .agg(F.sum("n").alias("requests"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), user, "requests")
    )


def admit_stream(
    stream: DataFrame,
    user: str,
    ts: str,
    tie: str,
    limit: int,
    window_seconds: int,
    lateness: str | None = None,
) -> DataFrame:
    """``(user, tie, ts_us, admitted)`` per request, from the admitted times of each user's last window.

    Requests of one trigger are put in order, so a trigger's size bounds the memory of a busy user.  A
    request that arrives in a later trigger with an older time is judged against the state as it is.
    The state of a user holds at most ``limit`` times.  With ``lateness`` requests older than the
    watermark are dropped, and a user's state goes once a window has passed without an admitted one.
    """
    fields = {f.name: f.dataType for f in stream.schema.fields}
    schema = T.StructType(
        [
            T.StructField(user, fields[user]),
            T.StructField(tie, fields[tie]),
            T.StructField("ts_us", T.LongType()),
            T.StructField("admitted", T.BooleanType()),
        ]
    )
    slim = stream.select(user, tie, micros(stream, ts).alias("ts_us"))
    if lateness:
        slim = slim.withColumn("__ts", F.timestamp_micros("ts_us")).withWatermark("__ts", lateness)
    return slim.groupBy(user).transformWithStateInPandas(
        statefulProcessor=_processor(user, tie, limit, window_seconds * MICROS, bool(lateness))(),
        outputStructType=schema,
        outputMode="append",
        timeMode="eventTime" if lateness else "none",
    )


def _processor(user: str, tie: str, limit: int, width: int, timed: bool):
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Admission(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.times = handle.getListState("times", "t bigint")

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            batch = pd.concat(list(rows)).sort_values(["ts_us", tie])
            times = [t for (t,) in self.times.get()]
            flags = []
            for now in batch["ts_us"].tolist():
                times = [t for t in times if t > now - width]
                flags.append(len(times) < limit)
                if flags[-1]:
                    times.append(now)
            self._keep(times)
            yield pd.DataFrame({user: batch[user], tie: batch[tie], "ts_us": batch["ts_us"], "admitted": flags})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            passed = expiredTimerInfo.getExpiryTimeInMs() * 1000
            self._keep([t for (t,) in self.times.get() if t > passed - width])
            yield pd.DataFrame()

        def _keep(self, times) -> None:
            if timed:
                for due in list(self.handle.listTimers()):
                    self.handle.deleteTimer(due)
            if not times:
                self.times.clear()
                return
            self.times.put([(t,) for t in times])
            if timed:
                self.handle.registerTimer((max(times) + width) // 1000 + 1)

        def close(self) -> None:
            pass

    return Admission
