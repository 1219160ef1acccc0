"""The registry: dataset, log and usage tables, and the questions asked of them.

Tables are append-only (``commits.py``); an update is a further version of a row, and the latest version wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprep.operators.ordered import ROWS_PER_RANGE, running
from tableprep.sources.commits import append_run, read_runs

# The table schemas.
SCHEMAS = {
    "Dataset": "id string, createdAt timestamp, updatedAt timestamp, userId string, collaborationId string, "
    "rows bigint, columns int, status string, rawDataPath string, cleanedDataPath string, rawUrl string, "
    "cleanedUrl string, databaseName string, mode string",
    "CleaningReport": "id string, datasetId string, reasoning string, summary string, recommendations string, "
    "createdAt timestamp",
    "UserModeUsage": "id string, userId string, mode string, datasetId string, createdAt timestamp",
    "CleaningLog": "id string, datasetId string, column string, nullCount bigint, action string, reason string, "
    "createdAt timestamp",
    "OutlierLog": "id string, datasetId string, column string, outlierCount bigint, method string, action string, "
    "createdAt timestamp",
    "FeatureLog": "id string, datasetId string, action string, details string, createdAt timestamp",
    "GraphMetadata": "id string, datasetId string, type string, column string, filePath string, createdAt timestamp",
}
# The column that a table's rows are looked up by.
KEYS = {"Dataset": "id", "UserModeUsage": "userId"}
DEFAULT_KEY = "datasetId"
BROADCAST_KEYS = 100_000
# States, their progress texts, quotas per user and mode, queues.
STATUSES = ["uploaded", "processing", "completed", "failed"]
PROGRESS = {
    "uploaded": "Dataset uploaded successfully, queued for processing",
    "processing": "Processing dataset: cleaning, analysis, and feature engineering in progress",
    "completed": "Dataset processing completed successfully",
    "failed": "Dataset processing failed - check logs for details",
}
QUOTAS = {"smart": 3, "deep": 1}
QUEUES = {"deep": ("eda_deep", 1800)}
DEFAULT_QUEUE = ("eda_fast", 600)
RECENT = 100
MOSTLY_DONE = 0.9


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[table])


def append(df: DataFrame, table: str, root: str) -> None:
    """Append rows; missing ids and times are filled, columns the table does not have are ignored."""
    target = empty(df.sparkSession, table).schema
    defaults = {"id": F.expr("uuid()"), "createdAt": F.current_timestamp(), "updatedAt": F.current_timestamp()}
    out = []
    for f in target.fields:
        given = F.col(f.name) if f.name in df.columns else None
        default = defaults.get(f.name, F.lit(None))
        value = default if given is None else (F.coalesce(given, default) if f.name in defaults else given)
        out.append(value.cast(f.dataType).alias(f.name))
    append_run(df.select(*out), f"{root.rstrip('/')}/{table}", KEYS.get(table, DEFAULT_KEY))


def read(spark: SparkSession, table: str, root: str, key: str | None = None) -> DataFrame:
    """A table as of now; ``key`` reads the rows of one dataset (usage: of one user) from one bucket of the files."""
    rows = read_runs(spark, f"{root.rstrip('/')}/{table}", empty(spark, table).schema, key)
    return rows if key is None else rows.filter(F.col(KEYS.get(table, DEFAULT_KEY)) == key)


def latest(changes: DataFrame, key: str = "id", version: str = "updatedAt") -> DataFrame:
    """The newest version of each row; of equally new ones always the same.

    The rank filter is applied per task before the shuffle.
    """
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in changes.columns])
    order = Window.partitionBy(key).orderBy(F.desc(version), tie)
    return changes.withColumn("__rank", F.row_number().over(order)).filter("__rank = 1").drop("__rank")


def run_of(path: Column | str) -> Column:
    """The run that a cleaned dataset or a log row's id belongs to; empty for rows written without one."""
    return F.regexp_extract(path, "(?:^|/)run-([0-9a-f]+)[-/]", 1)


def current_logs(logs: DataFrame, datasets: DataFrame) -> DataFrame:
    """Log rows of each dataset's latest completed run; rows of failed or repeated runs are left out."""
    done = latest(datasets.filter(F.col("status") == "completed"))
    runs = done.select(F.col("id").alias("datasetId"), run_of("cleanedUrl").alias("__run"))
    return logs.withColumn("__run", run_of(F.col("id"))).join(runs, ["datasetId", "__run"]).drop("__run").select(*logs.columns)


def get(table: DataFrame, value: str, key: str = "id") -> DataFrame:
    """Rows with one key."""
    return table.filter(F.col(key) == value)


def get_all(table: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key occurs in the one column of ``wanted``.

    Few keys are sent to every task.  More are dealt with the table's rows, and a task holds its share of
    the keys; the rows themselves are neither sorted nor held.
    """
    keys = wanted.toDF(key)
    few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    return table.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), key, "left_semi")


def listing(
    datasets: DataFrame, collaboration: str | None = None, user: str | None = None, status: str | None = None
) -> DataFrame:
    """Datasets by any combination of filters; one left out does not restrict."""
    for name, value in (("collaborationId", collaboration), ("userId", user), ("status", status)):
        if value is not None:
            datasets = datasets.filter(F.col(name) == value)
    return datasets


def visible(datasets: DataFrame, user: str) -> DataFrame:
    """What a user may read: own datasets and every shared one."""
    return datasets.filter((F.col("userId") == user) | F.col("collaborationId").isNotNull())


def progress(status: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, text in PROGRESS.items():
        out = out.when(status == name, text)
    return out


def collaboration_graphs(datasets: DataFrame, graphs: DataFrame, collaboration: str | None = None) -> DataFrame:
    """``(dataset_id, type, column, url)`` of all charts of shared datasets, or of one collaboration's."""
    shared = listing(datasets, collaboration).filter(F.col("collaborationId").isNotNull())
    return graphs.join(shared.select(F.col("id").alias("datasetId")), "datasetId").select(
        F.col("datasetId").alias("dataset_id"),
        "type",
        "column",
        F.concat(F.lit("/dataset/"), "datasetId", F.lit("/graph/"), F.col("id")).alias("url"),
    )


def collaboration_cleaned(datasets: DataFrame, base_url: str, collaboration: str | None = None) -> DataFrame:
    """Completed datasets of a collaboration (or of all) with their download url."""
    done = listing(datasets, collaboration, status="completed").filter(F.col("collaborationId").isNotNull())
    return done.select(
        "id",
        "rows",
        "columns",
        "status",
        F.col("userId").alias("user_id"),
        F.col("collaborationId").alias("collaboration_id"),
        F.concat(F.lit(base_url.rstrip("/") + "/dataset/"), "id", F.lit("/cleaned")).alias("url"),
    )


def mode_usage(usage: DataFrame) -> DataFrame:
    return usage.groupBy("userId", "mode").agg(F.count(F.lit(1)).alias("uses"))


def quota_admission(usage: DataFrame, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``use_number`` (the user's n-th use of the mode) and ``admitted`` (within the mode's quota)."""
    numbered = running(
        usage, ["userId", "mode"], ["createdAt", "id"], sums={"use_number": F.lit(1)}, rows_per_range=rows_per_range
    )
    within = F.lit(True)
    for mode, quota in QUOTAS.items():
        within = F.when(F.col("mode") == mode, F.col("use_number") <= quota).otherwise(within)
    return numbered.withColumn("admitted", within)


def recent(datasets: DataFrame, n: int = RECENT) -> DataFrame:
    return datasets.orderBy(F.desc("createdAt"), F.desc("id")).limit(n)


def recent_status_counts(datasets: DataFrame, n: int = RECENT) -> DataFrame:
    """How many of the latest ``n`` datasets are in each state, states without any included."""
    known = datasets.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    counts = recent(datasets, n).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return known.join(counts, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def stuck_and_newest(datasets: DataFrame, n: int = RECENT) -> DataFrame:
    """Among the latest ``n``: the longest-untouched one in processing, the last completed one."""
    at = F.struct("updatedAt", "id")

    def in_state(state: str) -> Column:
        return F.col("status") == state

    return recent(datasets, n).agg(
        F.count_if(in_state("processing")).alias("processing"),
        F.min(F.when(in_state("processing"), at))["id"].alias("oldest_processing"),
        F.count_if(in_state("completed")).alias("completed"),
        F.max(F.when(in_state("completed"), at))["id"].alias("newest_completed"),
    )


def queue(mode: Column) -> Column:
    out = F.lit(DEFAULT_QUEUE[0])
    for name, (target, _) in QUEUES.items():
        out = F.when(mode == name, target).otherwise(out)
    return out


def time_limit(mode: Column) -> Column:
    out = F.lit(DEFAULT_QUEUE[1])
    for name, (_, seconds) in QUEUES.items():
        out = F.when(mode == name, seconds).otherwise(out)
    return out


def run_summary(runs: DataFrame, wall_seconds: float | Column) -> DataFrame:
    """One row about a batch run: uploads ``(success, elapsed_time, status)`` and how far processing got."""
    ok = F.count_if("success")
    done = F.count_if(F.col("success") & F.col("status").isin("completed", "failed"))
    wall = wall_seconds if isinstance(wall_seconds, Column) else F.lit(float(wall_seconds))
    return runs.agg(
        F.count(F.lit(1)).alias("datasets"),
        ok.alias("successful"),
        F.count_if(~F.col("success")).alias("failed"),
        F.avg("elapsed_time").alias("avg_elapsed"),
        F.try_divide(ok, wall).alias("throughput"),
        F.try_divide(done, ok).alias("processed_share"),
        F.coalesce(done >= ok * MOSTLY_DONE, F.lit(False)).alias("mostly_done"),
    )


def queue_stats(datasets: DataFrame, now: Column) -> DataFrame:
    """Per queue: jobs in each state, total, and age in seconds of the oldest one waiting."""
    waiting = F.col("status") == "uploaded"
    oldest = F.min(F.when(waiting, F.col("createdAt")))
    return (
        datasets.withColumn("queue_name", queue(F.col("mode")))
        .groupBy("queue_name")
        .agg(
            F.count_if(waiting).alias("queued"),
            F.count_if(F.col("status") == "processing").alias("started"),
            F.count_if(F.col("status") == "completed").alias("finished"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.count(F.lit(1)).alias("total"),
            (F.unix_seconds(now) - F.unix_seconds(oldest.cast("timestamp"))).alias("oldest_job_age"),
        )
    )
