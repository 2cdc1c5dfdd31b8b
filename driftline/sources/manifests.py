"""Stored manifests and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def manifest_totals(manifest: DataFrame) -> DataFrame:
    """Paths, directories and bytes; directories add no bytes."""
    return manifest.agg(
        F.count("*").alias("paths"),
        F.coalesce(F.sum(F.col("is_dir").cast("bigint")), F.lit(0)).alias("dirs"),
        F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("length"))), F.lit(0)).alias("bytes"),
    )


def write_manifest(manifest: DataFrame, path: str, keep_as: str | None = None) -> DataFrame:
    """Write a manifest sorted by path and return its totals.

    ``keep_as`` names a second place for the copy that the next run of the policy merges with.
    """
    ordered = manifest.repartitionByRange("rel_path").sortWithinPartitions("rel_path")
    ordered.write.mode("overwrite").parquet(path)
    stored = manifest.sparkSession.read.schema(manifest.schema).parquet(path)
    if keep_as:
        stored.write.mode("overwrite").parquet(keep_as)
    return manifest_totals(stored)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
