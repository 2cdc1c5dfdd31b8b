"""Identifiers of policies and runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Position of each field in a packed policy id.
ID_FIELDS = {
    "source_data_center": 1, "source_cluster": 2, "target_data_center": 3, "target_cluster": 4,
    "policy_name": 5, "server_index": 6, "server_start": 7, "counter": 8,
}


def _cluster_parts(cluster: Column) -> Column:
    """``dc$name`` becomes ``dc/name/``; a plain name fills both parts; a blank one gives nothing."""
    pair = F.split(cluster, "\\$", 2)
    center = F.element_at(pair, 1)
    plain = F.element_at(pair, -1)
    return (F.when(cluster.isNull() | (F.trim(cluster) == ""), F.lit(""))
            .otherwise(F.concat(center, F.lit("/"), plain, F.lit("/"))))


def policy_id(source_cluster: Column, target_cluster: Column, policy: Column,
              server_index: Column, server_start: Column, counter: Column) -> Column:
    tail = F.concat_ws("/", policy, server_index.cast("string"), server_start.cast("string"),
                       F.lpad(counter.cast("string"), 9, "0"))
    return F.concat(F.lit("/"), _cluster_parts(source_cluster), _cluster_parts(target_cluster), tail)


def policy_id_field(packed: Column, field: str) -> Column:
    return F.get(F.split(packed, "/"), ID_FIELDS[field])


def run_id(policy: Column, number: Column) -> Column:
    return F.concat(policy, F.lit("@"), number.cast("string"))


def run_policy(run: Column) -> Column:
    return F.substring_index(run, "@", 1)


def run_number(run: Column) -> Column:
    return F.substring_index(run, "@", -1).cast("int")
