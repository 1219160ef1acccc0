"""Session helpers: a sensible local session and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar, copy_context
from typing import Any

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, name: str = "tableprep") -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for written intermediates.

    On a cluster it lies below ``spark.checkpoint.dir``, which every executor can reach.  Only a
    local-mode session without that setting falls back to the machine's temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="tableprep-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tableprep/{label}-{uuid.uuid4().hex}"


class ScratchRun:
    """Scratch folders made inside one open scope; scopes of one thread of work are nested."""

    def __init__(self, outer: ScratchRun | None):
        self.outer = outer
        self.paths: list[str] = []


_run: ContextVar[ScratchRun | None] = ContextVar("scratch_run", default=None)


@contextmanager
def scratch_scope(spark: SparkSession):
    """Delete what ``written`` makes inside the block when it ends, but for tables given to ``keep``.

    ``with scratch_scope(spark) as keep: ...; result = keep(written(table, "result"))``.  A kept table
    belongs to the scope around.  Scopes of other threads are apart; jobs given to ``together`` belong to
    the scope that it is called in.
    """
    run = ScratchRun(_run.get())
    token = _run.set(run)

    def keep(df):
        run.paths.remove(df.scratch)
        if run.outer is not None:
            run.outer.paths.append(df.scratch)
        return df

    try:
        yield keep
    finally:
        _run.reset(token)
        for path in run.paths:
            delete(spark, path)


def scoped_path(spark: SparkSession, label: str) -> str:
    """A fresh scratch folder that the open scope, if any, deletes when it ends."""
    path = scratch_path(spark, label)
    run = _run.get()
    if run is not None:
        run.paths.append(path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a file or folder on any storage that Spark can reach."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def written(df, label: str):
    """Cut lineage: write the table to shared storage and read it back.

    A lost executor then costs a file read, not a recomputation of everything before it, and later
    jobs all see the same rows in the same files.
    """
    path = scoped_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def together(*jobs: Callable[[], Any]) -> list[Any]:
    """Run independent Spark jobs side by side, so that one's last tasks do not hold up the next."""
    if len(jobs) < 2:
        return [job() for job in jobs]
    with ThreadPoolExecutor(min(8, len(jobs))) as pool:
        return [f.result() for f in [pool.submit(copy_context().run, job) for job in jobs]]
