"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_local_folders: dict[str, str] = {}


def scratch_path(spark: SparkSession, purpose: str) -> str:
    """A new path under ``spark.checkpoint.dir``.

    Only a local master may run without that setting; it then uses one temporary folder per application.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        base = _local_folders.setdefault(context.applicationId, "")
        if not base:
            base = _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="driftline-")
    if "://" not in base and not base.startswith("file:"):
        # a bare path is on the default filesystem: spelled out, file work in tasks finds it there too
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
        if not default.startswith("file:"):
            base = default.rstrip("/") + base
    return f"{base.rstrip('/')}/driftline/{spark.sparkContext.applicationId}/{purpose}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application; to be called once its results are stored elsewhere."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "any")).getParent()
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def written(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` as a written table: later reads see the same rows, and a lost executor recomputes nothing."""
    path = scratch_path(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, by: Column, tasks: int | None = None) -> DataFrame:
    """Rows dealt over a fixed number of tasks.

    For steps that do file work per row: such rows are small, and adaptive execution would otherwise merge them into one
    partition and with them all the work into one task.
    """
    return df.repartition(tasks or _tasks(df.sparkSession), by)


def spread_in_order(df: DataFrame, by: str) -> DataFrame:
    """As :func:`spread`, but each task gets the rows of one range of ``by``, a path.

    For steps that make, rename or delete files: a disk lets one task at a time change a directory, so tasks that all
    work in all directories wait for each other, the longer the more files there are.
    """
    return df.repartitionByRange(_tasks(df.sparkSession), by)


def _tasks(spark: SparkSession) -> int:
    tasks = spark.sparkContext.defaultParallelism
    if not spark.sparkContext.master.startswith("local"):
        # a cluster may still be growing, so its present cores are no measure
        tasks = max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return tasks
