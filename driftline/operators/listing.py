"""Listings of directories, databases and tables with their zones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import paths
from driftline.operators.ancestors import ancestor_join, exact_zone


def list_directory(manifest: DataFrame, path: str, zones: DataFrame, snapshot_dirs: DataFrame,
                   name_filter: str = "", cap: int = -1, cluster: str | None = None) -> DataFrame:
    """One level below ``path``: (path, name, is_dir, length, encryption_key, snapshottable, total).

    ``cap`` limits the rows in name order, -1 is no limit. ``total`` counts all entries before the filter. The zone of an
    entry is its shallowest containing zone. ``cluster`` is the one that is listed: of zones and snapshottable directories with
    a ``cluster`` only its own count.
    """
    if cluster is not None:
        zones, snapshot_dirs = (t.where(F.col("cluster") == cluster) if "cluster" in t.columns else t for t in (zones, snapshot_dirs))
    level = manifest.where(paths.parent(F.col("path")) == F.lit(path.rstrip("/") or "/"))
    total = level.count()
    named = level.withColumn("name", paths.name(F.col("path"))).where(F.col("name").contains(name_filter))
    kept = named if cap == -1 else named.orderBy("name").limit(cap)
    zoned = ancestor_join(kept, zones.select("path", "key_name"), unique=True)
    marked = exact_zone(zoned, snapshot_dirs)
    return marked.select("path", "name", "is_dir", "length", F.col("zone_key_name").alias("encryption_key"),
                         F.col("in_zone").alias("snapshottable"), F.lit(total).cast("bigint").alias("total"))


def catalog_databases(spark: SparkSession) -> DataFrame:
    """Databases of the session catalog: (name, location)."""
    rows = [(d.name, d.locationUri) for d in spark.catalog.listDatabases()]
    return spark.createDataFrame(rows, "name string, location string")


def catalog_tables(spark: SparkSession, database: str) -> DataFrame:
    rows = [(database, t.name) for t in spark.catalog.listTables(database) if not t.isTemporary]
    return spark.createDataFrame(rows, "database string, name string")


def list_databases(databases: DataFrame, zones: DataFrame) -> DataFrame:
    """(name, location, encryption_key) of (name, location) rows."""
    located = databases.withColumn("__place", paths.uri_path(F.col("location")))
    zoned = ancestor_join(located, zones.select("path", "key_name"), "__place")
    return zoned.select("name", "location", F.col("zone_key_name").alias("encryption_key"))


def list_tables(tables: DataFrame, database: str) -> DataFrame:
    return tables.where(F.col("database") == database).select("database", "name")
