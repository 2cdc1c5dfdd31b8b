"""Store queries, histories and changes on small inputs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.functions import texts
from driftline.operators import changes, clusters, filters, history, store
from driftline.operators.pointers import reached

T0 = datetime(2020, 1, 1)
RUN = "policy_id string, id string, status string, start_time timestamp_ntz, end_time timestamp_ntz, retirement_time timestamp_ntz"


def runs(spark, statuses):
    """One policy per entry, its statuses oldest first."""
    rows = [(p, f"{p}@{i}", s, T0 + timedelta(days=i), T0 + timedelta(days=i, hours=1), None)
            for p, many in statuses.items() for i, s in enumerate(many)]
    return spark.createDataFrame(rows, RUN)


def test_final_status(spark):
    cases = {
        "a": (["FAILED", "SUCCESS"], "SUCCEEDED"), "b": (["SUCCESS", "FAILED_ADMIN"], "SUSPENDEDFORINTERVENTION"),
        "c": (["FAILED_ADMIN", "SKIPPED"], "SUSPENDEDFORINTERVENTION"), "d": (["SUCCESS", "KILLED"], "FAILED"),
        "e": (["SUCCESS", "SKIPPED"], "SUCCEEDEDWITHSKIPPED"), "f": (["FAILED", "SKIPPED"], "FAILEDWITHSKIPPED"),
        "g": (["SKIPPED", "SKIPPED"], "FAILED"), "h": (["SUCCESS", "RUNNING"], "FAILED"), "i": (["KILLED", "SKIPPED"], "FAILEDWITHSKIPPED")}
    found = history.final_status(runs(spark, {k: v[0] for k, v in cases.items()}))
    assert {r["policy_id"]: r["final_status"] for r in found.collect()} == {k: v[1] for k, v in cases.items()}


def test_rerunnable(spark):
    found = history.rerunnable(runs(spark, {"a": ["FAILED", "SKIPPED"], "b": ["FAILED", "SUCCESS"]}).withColumn("current_offset", F.lit(1)))
    assert [r["id"] for r in found.collect()] == ["a@0"]


def test_recent_runs(spark):
    df = runs(spark, {"a": ["SUCCESS"] * 15})
    assert [r["id"] for r in history.recent_runs(df).first()["runs"]] == ["a@14", "a@13", "a@12"]
    assert len(history.recent_runs(df, 50).first()["runs"]) == 15
    with pytest.raises(ValueError):
        history.recent_runs(df, 50, most=10)


def test_filters(spark):
    df = spark.createDataFrame([("a", "FS"), ("b", "HIVE"), ("c", "FS")], "name string, type string")
    fields = filters.by_columns({"name": "name", "type": "type"})

    def names(text):
        return [r["name"] for r in filters.filtered(df, text, fields).collect()]

    assert names("name:a|b,type:FS") == ["a"] and names("name:a,name:c") == ["a", "c"]
    assert names("type:") == names(None) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        names("owner:x")
    assert filters.last_values("status:A,status:B|C", ["status"]) == {"status": "B|C"}
    for bad in ("status", "owner:x"):
        with pytest.raises(ValueError):
            filters.last_values(bad, ["status"])


def test_run_order_is_by_run_columns_only(spark):
    df = runs(spark, {"a": ["SUCCESS"]})
    policy = spark.createDataFrame([("a", "n", "FS", None)], "id string, name string, type string, retirement_time timestamp_ntz")
    with pytest.raises(ValueError):
        store.list_instances(policy, df, None, "name")
    assert store.list_instances(policy, df, "name:n").count() == 1
    with pytest.raises(ValueError):
        store.events_filtered(df.withColumn("event_time", F.col("start_time")), policy, {"host": "x"})


def test_duplicate_active(spark):
    df = spark.createDataFrame([("a", None), ("a", None), ("b", None), ("c", T0)], "name string, retirement_time timestamp_ntz")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "name string")
    found = store.duplicate_active(df, ["name"], wanted)
    assert {r["name"]: r["active_rows"] for r in found.collect()} == {"a": 2, "c": 0}


def test_policy_view_fields(spark):
    df = spark.createDataFrame([("1", "n", "FS", "x , y", "RUNNING")], "id string, name string, type string, tags string, status string")
    row = store.policy_view(df, ["tags"]).first()
    assert row.asDict() == {"id": "1", "name": "n", "type": "FS", "tags": ["x", "y"]}
    with pytest.raises(ValueError):
        store.policy_view(df, ["secrets"])


def test_fold_and_diff_properties(spark):
    prop = spark.createDataFrame([("1", "k", "a"), ("1", "l", "b"), ("2", None, "c")], "id string, property string, value string")
    ids = spark.createDataFrame([("1",), ("2",)], "id string")
    assert {r["id"]: r["properties"] for r in clusters.fold_properties(ids, prop, ["id"]).collect()} == {"1": {"k": "a", "l": "b"}, "2": None}
    new = spark.createDataFrame([("1", "k", "a"), ("1", "m", "z")], "id string, property string, value string")
    found = clusters.diff_properties(prop.where("property is not null"), new, ["id", "property"], True)
    assert {r["property"]: (r["action"], r["changed"]) for r in found.collect()} == {
        "k": ("update", False), "l": ("delete", False), "m": ("insert", True)}


@pytest.mark.parametrize("retired, expected", [((0,), (0, 0, 0)), ((0, 1), (1, 5, 25))])
def test_retention(spark, retired, expected):
    """As many policies with five runs of five jobs each; the retired ones go with all they have."""
    count = len(retired) + expected[0]
    gone = T0 - timedelta(days=2)
    policy = spark.createDataFrame([(str(p), gone if p in retired else None) for p in range(count)], "id string, retirement_time timestamp_ntz")
    instance = spark.createDataFrame([(f"{p}@{r}", str(p), p * 10 + r, None) for p in range(count) for r in range(5)],
                                     "id string, policy_id string, order_key int, retirement_time timestamp_ntz")
    job = spark.createDataFrame([(p * 10 + r, j) for p in range(count) for r in range(5) for j in range(5)], "order_key int, job_offset int")
    prop = spark.createDataFrame([(str(p), "k", "v") for p in range(count)], "owner_id string, property string, value string")
    kept = changes.retention_purge(policy, prop, instance, job, T0, 1)
    assert tuple(kept[t].count() for t in ("policy", "policy_instance", "instance_job")) == expected
    assert kept["property"].count() == expected[0]


def test_update_of_one_row(spark):
    table = spark.createDataFrame([(1, "old", 1), (2, "old", 1)], "id int, message string, run_count int")
    updates = spark.createDataFrame([(1, "y" * 4001)], "id int, message string")
    rows = {r["id"]: r for r in changes.apply_updates(table, updates, ["id"], increment=["run_count"]).collect()}
    assert rows[1]["message"] == "y" * 4001 and rows[1]["run_count"] == 2
    assert (rows[2]["message"], rows[2]["run_count"]) == ("old", 1)
    with pytest.raises(ValueError):
        changes.apply_updates(table, table.withColumn("x", F.lit(1)), ["id"])


def test_incremental_export_keeps_its_id(spark):
    df = spark.createDataFrame([(1,), (5,)], "change_id long")
    rows, newest = changes.incremental_export(df, 5)
    assert rows.isEmpty() and newest == 5
    assert changes.incremental_export(df, 0)[0].count() == 2 and changes.incremental_export(df, 2)[1] == 5


def greedy(rows):
    """The rule, one run after the other."""
    want, busy = {}, {}
    for policy, run, start, end in sorted(rows, key=lambda r: (r[2], r[1])):
        until, who = busy.get(policy, (None, None))
        if who is not None and (until is None or start < until):
            want[run] = who
        else:
            want[run], busy[policy] = None, (end, run)
    return want


@pytest.mark.parametrize("seed, open_share", [(1, 0.0), (2, 0.01), (3, 0.3)])
def test_mark_overlaps(spark, seed, open_share):
    """Against the plain rule; one policy has a third of all runs and its history is cut across partitions."""
    rng, rows = random.Random(seed), []
    for i in range(900):
        policy = "hot" if i % 3 == 0 else f"p{rng.randint(0, 60)}"
        start = T0 + timedelta(minutes=rng.randint(0, 4000))
        end = None if rng.random() < open_share else start + timedelta(minutes=rng.choice([0, 1, 5, 60, 400]))
        rows.append((policy, f"r{i:04d}", start, end))
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        df = spark.createDataFrame(rows, "policy_id string, id string, start_time timestamp_ntz, end_time timestamp_ntz")
        found = {r["id"]: r["blocked_by"] for r in changes.mark_overlaps(df).collect()}
    finally:
        spark.conf.set(name, "true")
    assert found == greedy(rows)


def test_one_island_of_overlapping_runs(spark):
    """A policy whose runs overlap without a gap, with a chain of some hundred runs that run; a run given twice; one
    without a start; ends before starts."""
    rng, at, rows = random.Random(9), 0, []
    for i in range(1500):
        at += rng.randint(0, 2)
        rows.append(("hot", f"r{i:04d}", T0 + timedelta(minutes=at), T0 + timedelta(minutes=at + rng.randint(-1, 9))))
    schema = "policy_id string, id string, start_time timestamp_ntz, end_time timestamp_ntz"
    more = [rows[700], ("hot", "none", None, T0 + timedelta(days=9)), ("hot", "never", None, None)]
    found = changes.mark_overlaps(spark.createDataFrame(rows + more, schema)).collect()
    assert len(found) == len(rows) + 3
    assert {r["id"]: r["blocked_by"] for r in found if r["id"] != "r0700"} == {
        **{k: v for k, v in greedy(rows).items() if k != "r0700"}, "none": None, "never": None}
    assert "MapInPandas" not in changes.mark_overlaps(spark.createDataFrame(rows, schema))._jdf.queryExecution().toString()
    assert changes.mark_overlaps(spark.createDataFrame([], schema)).collect() == []


def test_pointer_doubling(spark):
    links = [(n, n + 1) for n in range(100) if n not in (40, 70)] + [(200, 201)]
    heads = spark.createDataFrame([(0,), (41,), (300,)], "node long")
    found = [r[0] for r in reached(heads, spark.createDataFrame(links, "node long, next long")).collect()]
    assert sorted(found) == [*range(41), *range(41, 71), 300]


def test_next_retry(spark):
    failed = spark.createDataFrame([("a", 1, T0, "x"), ("a", 2, T0, "y"), ("a", 3, T0, "z")], "policy_id string, run_count int, end_time timestamp_ntz, id string")
    policy = spark.createDataFrame([("a", 3, 60)], "id string, retry_attempts int, retry_delay int")
    found = {r["run_count"]: r["retry_at"] for r in changes.next_retry(failed, policy).collect()}
    assert found == {1: T0 + timedelta(seconds=60), 2: T0 + timedelta(seconds=120), 3: None}


def test_updates_are_folded_to_one_per_key(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "id long, v string, n int")
    updates = spark.createDataFrame([(1, "x", 1), (1, None, 3), (1, "y", 2), (1, "y", 2)], "id long, v string, at int")
    done = changes.apply_updates(table, updates, ["id"], increment=["n"], order="at")
    assert sorted(map(tuple, done.collect())) == [(1, "y", 1), (2, "b", 0)]
    same = changes.apply_updates(table, updates.where("v = 'y' OR v IS NULL").drop("at"), ["id"])
    assert sorted(map(tuple, same.collect())) == [(1, "y", 0), (2, "b", 0)]
    with pytest.raises(Exception, match="contradict"):
        changes.apply_updates(table, updates.drop("at"), ["id"]).collect()


def test_messages_are_kept_whole(spark):
    table = spark.createDataFrame([(1, "")], "id long, message string")
    done = changes.apply_updates(table, spark.createDataFrame([(1, "x" * 9000)], "id long, message string"), ["id"])
    assert len(done.first()["message"]) == 9000
    assert done.select(texts.short_message(F.col("message"))).first()[0] == "x" * 3899 + " ..."
    assert done.select(texts.short_message(F.substring("message", 1, 4000))).first()[0] == "x" * 4000
