"""Session settings used by the bench and the tests."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # copies write files, so a second attempt of a running task is never wanted
    "spark.speculation": "false",
    "spark.ui.enabled": "false",
    # do not record the Python call site of every column expression
    "spark.sql.dataFrameQueryContext.enabled": "false",
}


def local_session(cores: int | str = "*", app: str = "driftline", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in {**SETTINGS, "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", **more}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
