"""Cluster pairs and properties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pairs_of(pair: DataFrame) -> DataFrame:
    """Both directions of each pair: (name, version, peer, peer_version, status)."""
    there = pair.select(F.col("cluster").alias("name"), "version", F.col("paired_cluster").alias("peer"),
                        F.col("paired_version").alias("peer_version"), "status")
    back = pair.select(F.col("paired_cluster").alias("name"), F.col("paired_version").alias("version"),
                       F.col("cluster").alias("peer"), F.col("version").alias("peer_version"), "status")
    return there.unionByName(back).distinct()


def pair_status(pair: DataFrame, wanted: DataFrame) -> DataFrame:
    """Status of each wanted unordered pair (name, peer); a pair that does not exist has problem ``not_paired``."""
    known = pairs_of(pair).groupBy("name", "peer").agg(F.max_by("status", F.struct("version", "peer_version"))
                                                       .alias("status"))
    found = wanted.select("name", "peer").distinct().join(known, ["name", "peer"], "left")
    return found.withColumn("problem", F.when(F.col("status").isNull(), "not_paired"))


def fold_properties(entity: DataFrame, prop: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``properties``, a map of the entity's (property, value) rows; null without any.

    Rows are first reduced to one per property, so repeated rows of one entity never meet in one task.
    """
    own = prop.where("property is not null").groupBy(*keys, "property").agg(F.max("value").alias("value"))
    maps = own.groupBy(*keys).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("property", "value")))).alias("properties"))
    return entity.join(maps, keys, "left")


def diff_properties(stored: DataFrame, incoming: DataFrame, keys: list[str], detect_deleted: bool) -> DataFrame:
    """(keys, action, old_value, value, changed) with action update, insert, delete or keep.

    A key that exists is an update even if its value is the same; ``changed`` tells. A stored key that is not in the
    incoming set of its owner is a delete for clusters (``detect_deleted``) and kept for policies.
    """
    old = stored.select(*keys, F.col("value").alias("old_value"), F.lit(True).alias("__old"))
    new = incoming.select(*keys, "value", F.lit(True).alias("__new"))
    both = old.join(new, keys, "full_outer")
    absent = "delete" if detect_deleted else "keep"
    action = (F.when(F.col("__old") & F.col("__new"), "update").when(F.col("__new"), "insert").otherwise(absent))
    changed = F.col("__new").isNotNull() & ~F.col("old_value").eqNullSafe(F.col("value"))
    return both.select(*keys, action.alias("action"), "old_value", "value", changed.alias("changed"))


def validate_pairs(pair: DataFrame, flags: DataFrame) -> DataFrame:
    """Compatibility of the two ends of each pair: one row per broken rule with its severity.

    ``flags`` is (name, version, hdfs, ha, hive, acl_service, kerberos, nameservice). A Kerberos mismatch and a nameservice
    both highly available ends share are errors; the other rules only warn.
    """
    names = ["hdfs", "ha", "hive", "acl_service", "kerberos", "nameservice"]
    left = flags.select(F.col("name").alias("cluster"), "version", *[F.col(c).alias(f"l_{c}") for c in names])
    right = flags.select(F.col("name").alias("paired_cluster"), F.col("version").alias("paired_version"),
                         *[F.col(c).alias(f"r_{c}") for c in names])
    both = pair.join(left, ["cluster", "version"]).join(right, ["paired_cluster", "paired_version"])
    ha_l, ha_r = F.col("l_hdfs") & F.col("l_ha"), F.col("r_hdfs") & F.col("r_ha")
    rules = [
        ("hdfs", "warn", F.col("l_hdfs") != F.col("r_hdfs")),
        ("ha", "warn", ha_l != ha_r),
        ("hive", "warn", F.col("l_hive") != F.col("r_hive")),
        ("acl_service", "warn", F.col("l_acl_service") != F.col("r_acl_service")),
        ("kerberos", "error", F.col("l_kerberos") != F.col("r_kerberos")),
        ("same_nameservice", "error", ha_l & ha_r & (F.col("l_nameservice") == F.col("r_nameservice"))),
    ]
    broken = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("severity")))
        for rule, level, test in rules]))
    return both.select("cluster", "version", "paired_cluster", "paired_version", F.explode(broken).alias("b")).select(
        "cluster", "version", "paired_cluster", "paired_version", "b.rule", "b.severity")
