"""Access policies, entity rules, and events."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftline.operators import documents
from driftline.sources import events
from driftline.sources.access_policies import SCHEMA, read_access_policies, write_access_policies

ENTITY = "guid string, type string, top_level boolean, attributes map<string,string>, classifications array<string>"


def policies(spark, paths):
    rows = [(name, {"path": (values, False, True)} if values is not None else {"database": (["db"], False, False)})
            for name, values in paths.items()]
    small = spark.createDataFrame(rows, "name string, resources map<string,struct<values:array<string>,isExcludes:boolean,isRecursive:boolean>>")
    return spark.createDataFrame([], SCHEMA).unionByName(small, allowMissingColumns=True)


def paths_of(df):
    return {r["name"]: r["resources"]["path"]["values"] for r in df.where(F.col("resources")["path"].isNotNull()).collect()}


def test_access_policies(spark):
    df = policies(spark, {"one": ["/a"], "two": ["/a/x", "/b"], "none": None, "near": ["/ab"]})
    assert sorted(r["name"] for r in documents.single_resource(df, "FS").collect()) == ["near", "one"]
    assert [r["name"] for r in documents.single_resource(df, "HIVE").collect()] == ["none"]
    # a plain prefix, so /ab moves along with /a
    assert paths_of(documents.rehome_policies(df, ("/a/", "/t//"), "FS")) == {"one": ["/t"], "two": ["/t/x", "/b"], "near": ["/tb"]}
    assert paths_of(documents.rehome_policies(df, ("/a", "/a/"), "FS")) == paths_of(df)


def test_round_trip(spark, tmp_path):
    df = documents.add_deny_policies(policies(spark, {"one": ["/a"]}), spark.createDataFrame(
        [("svc", None, "/a/", "/t"), (None, "c", "/b", "/u"), ("", "c", "/b", "/u")],
        "service string, source_cluster string, source_dataset string, target_dataset string"), "FS", datetime(2020, 1, 2))
    place = write_access_policies(df, str(tmp_path), "FS")
    back = read_access_policies(spark, place)
    assert back.schema == df.schema and back.count() == 2
    deny = back.where("denyPolicyItems is not null").first()
    assert deny["name"] == "source_replication deny policy for /t" and deny["resources"]["path"]["values"] == ["/a", "/dummy"]
    assert deny["denyPolicyItems"][0]["groups"] == ["public"] and deny["denyExceptions"][0]["users"] == ["replication"]


def test_entity_rules(spark):
    rules = documents.build_rules("HIVE", "cl-Src", "clTgt", "stocks", "stocks_dw", "hdfs://a:1", "hdfs://b:2")
    assert rules[3] == {"conditions": {"hive_db.name": "EQUALS: stocks"}, "actions": {"hive_db.name": "SET: stocks_dw"}}
    df = spark.createDataFrame([
        ("1", "hive_db", True, {"name": "stocks", "clusterName": "cl-Src", "location": "HDFS://A:1/apps", "replicatedTo": "z"}, None),
        ("2", "hive_storagedesc", False, {"location": "hdfs://a:1/x"}, ["pii"]), ("3", "hive_table", True, {"name": "stocks"}, ["pii"])], ENTITY)
    found = {r["guid"]: (r["attributes"], r["classifications"]) for r in documents.apply_entity_transforms(df, rules).collect()}
    assert found == {
        "1": ({"name": "stocks_dw", "clusterName": "clTgt", "location": "hdfs://b:2/apps"}, ["cl_Src_replicated"]),
        "2": ({"location": "hdfs://b:2/x"}, ["pii"]), "3": ({"name": "stocks"}, ["pii", "cl_Src_replicated"])}


def test_path_rule(spark):
    rules = documents.build_rules("FS", "c", "c", "/tmp/hr", "/tmp/hr_dw")
    assert rules[-1]["actions"] == {"hdfs_path.name": "REPLACE_PREFIX: = :/tmp/hr/=/tmp/hr_dw/"}
    df = spark.createDataFrame([("1", "hdfs_path", False, {"name": "/TMP/hr/f"}, None), ("2", "hdfs_path", False, {"name": "/tmp/hrx"}, None)], ENTITY)
    found = {r["guid"]: r["attributes"]["name"] for r in documents.apply_entity_transforms(df, rules).collect()}
    assert found == {"1": "/tmp/hr_dw/f", "2": "/tmp/hrx"}
    assert documents.rules_table(spark, rules).count() == len(rules)
    with pytest.raises(ValueError):
        documents.apply_entity_transforms(df, [{"conditions": {"hdfs_path.name": "LIKE: x"}, "actions": {}}])


def test_events(spark, tmp_path):
    rows = [(1, "policy", 2), (2, "policy", 8), (3, "system", 0), (4, "cluster", 5), (5, "policyinstance", 13), (6, "policy", 99)]
    df = spark.createDataFrame(rows, "id int, entity_type string, event_code int")
    refused = events.append_events(df, str(tmp_path / "store"), str(tmp_path / "refused"))
    assert sorted(r["id"] for r in refused.collect()) == [2, 6]
    events.append_events(df.limit(0), str(tmp_path / "store"))
    stored = {r["id"]: r["severity"] for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert stored == {1: "info", 3: "info", 4: "info", 5: "error"}
