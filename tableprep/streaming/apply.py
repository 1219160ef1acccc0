"""Fitted plans on streams, and intake of new datasets."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from tableprep.plans.prepare import prepare_dataset
from tableprep.session import exists, written
from tableprep.sources import registry


def file_stream(spark, folder: str, schema, name_filter: str | None = None, files_per_trigger: int | None = None):
    """A stream over the Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def apply_to_stream(stream: DataFrame, plan) -> DataFrame:
    """The plan as a stateless part of the stream; label codes are a stream-static join.

    Forward fill and row removal depend on other rows and are refused.
    """
    if not plan.stateless:
        raise ValueError("a plan with forward fill or row removal cannot run on a stream")
    return plan.apply(stream)


def write_stream(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append") -> StreamingQuery:
    """Write what has arrived so far to Parquet, exactly once, and stop."""
    return (
        stream.writeStream.format("parquet")
        .outputMode(output_mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def intake(
    stream: DataFrame, key: str, process: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Process every key once, however often it is delivered: known keys are left out by an anti join.

    ``process`` gets a plain batch, so it may profile, fit and write like any batch job.  Keys that are
    done stand in a ledger of their own beside the output (``<path>_keys``), written after the output;
    finding the new ones reads that slim column and never the output.
    """
    run = checkpoint.rstrip("/").rsplit("/", 1)[-1]
    ledger = f"{path}_keys"

    def handle(batch: DataFrame, batch_id: int) -> None:
        # Each batch owns one folder and rewrites it, so a repeated batch replaces its own output
        # and must not count it as processed before.
        spark, own = batch.sparkSession, f"{run}-{batch_id}"
        fresh = batch.dropDuplicates([key])
        if exists(spark, ledger):
            kept = StructType([batch.schema[key], StructField("batch", StringType())])
            known = spark.read.schema(kept).parquet(ledger)
            fresh = fresh.join(known.filter(F.col("batch") != own).select(key), key, "left_anti")
        fresh = written(fresh, "intake")
        if fresh.isEmpty():
            return
        process(fresh).write.mode("overwrite").parquet(f"{path}/batch={batch_id}-{run}")
        fresh.select(key).write.mode("overwrite").parquet(f"{ledger}/batch={own}")

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def intake_datasets(
    stream: DataFrame, root: str, prefix: str, checkpoint: str, attempts: int = 2, side_by_side: int = 4, **options
) -> StreamingQuery:
    """Prepare every registered dataset whose ``id`` arrives, each as a run of its own (``prepare_dataset``).

    A dataset that is completed is not prepared again, however often it is delivered.  One that fails is
    tried ``attempts`` times per delivery and left as ``failed`` in the registry; the others of its batch
    and the stream go on, and a later delivery tries it anew.  An id the registry does not know is left
    out.  A batch's ids come to the driver, so ``files_per_trigger`` of the stream bounds them; up to
    ``side_by_side`` runs share the cluster.
    """

    def one(spark, name: str) -> None:
        entry = registry.latest(registry.read(spark, "Dataset", root, name)).first()
        if entry is None or entry["status"] == "completed":
            return
        for _ in range(attempts):
            try:
                prepare_dataset(spark, root, name, prefix, **options)
                return
            except Exception:  # noqa: BLE001 - the run has recorded it; the other datasets go on
                continue

    def handle(batch: DataFrame, batch_id: int) -> None:
        names = sorted(r["id"] for r in batch.select("id").where("id IS NOT NULL").distinct().collect())
        with ThreadPoolExecutor(side_by_side) as pool:
            list(pool.map(lambda name: one(batch.sparkSession, name), names))

    return (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
