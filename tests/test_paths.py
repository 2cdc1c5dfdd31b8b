"""Path expressions, ancestor joins and dataset conflicts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftline.functions import paths
from driftline.operators.ancestors import ancestor_join, containing, dataset_conflicts
from driftline.operators.ordered import cuts_of, range_of

EXISTING = ["/user/A/1/2", "/user/A/1/2_1", "/user/B", "/dataset1", "s3://user/A/", "s3://user/"]
CONFLICT = ["/", "/user", "/user/A", "/user/B", "/user/A/1/2/3", "/user/A/1/2", "s3://user/A/", "s3://user/", "s3://user"]
FREE = ["/user/A/1/2_3", "/user/C", "/home/A", "/dataset", "/dataset12"]


def column(spark, values, name="dataset"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_dataset_conflicts(spark):
    found = dataset_conflicts(column(spark, CONFLICT + FREE), column(spark, EXISTING))
    assert {r["dataset"]: r["conflict"] for r in found.collect()} == {**dict.fromkeys(CONFLICT, True), **dict.fromkeys(FREE, False)}


def test_cloud_schemes_do_not_mix(spark):
    found = dataset_conflicts(column(spark, ["gs://user/A", "S3://user/A/x", "hdfs://nn:8020/user/B/x"]), column(spark, EXISTING))
    assert {r["dataset"]: r["conflict"] for r in found.collect()} == {
        "gs://user/A": False, "S3://user/A/x": True, "hdfs://nn:8020/user/B/x": True}


def test_database_conflicts(spark):
    found = dataset_conflicts(column(spark, ["sales", "marketing"]), column(spark, ["sales", "sales_marketing", "sales_marketing"]), "HIVE")
    assert {r["dataset"]: r["conflict"] for r in found.collect()} == {"sales": True, "marketing": False}


def test_path_expressions(spark):
    df = column(spark, ["/", "//", "/a", "/a/", "/a/b//", "b/c"], "p")
    p = F.col("p")
    rows = df.select(paths.strip_slash(p), paths.parent(p), paths.name(p), paths.depth(p), paths.prefixes(p),
                     paths.prefixes(p, False)).collect()
    assert [tuple(r) for r in rows] == [
        ("/", None, "", 0, ["/"], []), ("/", None, "", 0, ["/"], []), ("/a", "/", "a", 1, ["/", "/a"], ["/"]),
        ("/a", "/", "a", 1, ["/", "/a"], ["/"]), ("/a/b", "/a", "b", 2, ["/", "/a", "/a/b"], ["/", "/a"]),
        ("b/c", "b", "c", 2, ["b", "b/c"], ["b"])]


def test_containing_against_brute_force(spark):
    rng = random.Random(5)
    every = ["/" + "/".join(rng.choice("ab") + str(rng.randint(0, 2)) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    zones, entries = sorted(set(every[:60])), sorted(set(every[60:]))
    for pick, choose in (("shallowest", min), ("deepest", max)):
        for include_self in (True, False):
            found = containing(column(spark, entries, "p"), column(spark, zones, "z"), "p", "z", pick, include_self, "left")
            want = {}
            for p in entries:
                hits = [z for z in zones if p.startswith(z + "/") or (include_self and p == z)]
                want[p] = choose(hits, key=len) if hits else None
            assert {r["p"]: r["z"] for r in found.collect()} == want


@pytest.mark.parametrize("pick", ["shallowest", "deepest"])
def test_containing_by_group_and_by_row(spark, pick):
    """Names that sort before and after a slash, the root, trailing slashes, groups, rows that may not be their own zone."""
    rng = random.Random(pick)
    names = ["a", "a-", "a!", "a b", "a\x01", "ab", "A", "é"]
    every = ["/" + "/".join(rng.choice(names) for _ in range(rng.randint(0, 4))) for _ in range(1200)] + ["x/a", "x", ""]
    zones = sorted({(p.rstrip("/") + rng.choice(["", "/", "///"]), rng.choice(["c1", "c2", "c 1", None])) for p in every[:150]}, key=repr)
    rows = [(n, p, rng.choice(["c1", "c2", "c 1", "c3", None]), rng.random() < 0.5) for n, p in enumerate([*every[150:], None])]
    df = spark.createDataFrame(rows, "id int, p string, c string, own boolean")
    held = spark.createDataFrame([(p, c) for p, c in zones], "z string, k string")
    found = containing(df, held, "p", "z", pick, F.col("own"), "left", ("c", "k")).collect()
    assert len(found) == len(rows)
    choose = min if pick == "shallowest" else max
    for r in found:
        p = None if r["p"] is None else r["p"].rstrip("/")
        hits = {z.rstrip("/") for z, k in zones if k is not None and k == r["c"] and p is not None
                and (p.startswith(z.rstrip("/") + "/") or (r["own"] and p == z.rstrip("/")))}
        assert (r["z"] and r["z"].rstrip("/")) == (choose(hits, key=len) if hits else None)
        assert (r["k"] is None) == (r["z"] is None)
    inner = containing(df, held, "p", "z", pick, F.col("own"), "inner", ("c", "k")).collect()
    assert sorted(map(repr, inner)) == sorted(repr(r) for r in found if r["z"] is not None)


def test_one_exchange_of_each_side(spark):
    """The large side is shuffled once, and no path of it is repeated for its prefixes."""
    df = spark.range(5000).select(F.concat(F.lit("/d"), F.col("id") % 50, F.lit("/f"), "id").alias("p"))
    found = containing(df, spark.createDataFrame([("/d1",), ("/d2/f2",)], "z string"), "p", "z")
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan[plan.index("Window [last(__event"):].split("+- Union", 1)[0] if "Window [last(__event" in plan else plan
    assert final.count("Exchange hashpartitioning(__range") == 1 and "Generate" not in plan
    assert found.count() == 101


def test_cuts(spark):
    df = spark.createDataFrame([(f"{n:05d}",) for n in range(3000)], "o string")
    cuts = cuts_of(df, 16)
    assert 8 <= len(cuts) <= 16
    parts = df.select(range_of(F.col("o"), cuts).alias("r"), "o").collect()
    assert all(r["r"] == sum(c <= r["o"] for c in cuts) for r in parts)
    assert max(Counter(r["r"] for r in parts).values()) < 600


def test_ancestor_join_keeps_repeated_rows(spark):
    df = spark.createDataFrame([(1, "/a/b"), (2, "/a/b"), (3, "/c"), (4, None)], "id int, path string")
    zones = spark.createDataFrame([("/", "root"), ("/a/", "k")], "path string, key string")
    deep = ancestor_join(df, zones, pick="deepest")
    assert {r["id"]: r["zone_key"] for r in deep.collect()} == {1: "k", 2: "k", 3: "root", 4: None}
    assert {r["id"]: r["zone_key"] for r in ancestor_join(df, zones).collect()} == {1: "root", 2: "root", 3: "root", 4: None}
