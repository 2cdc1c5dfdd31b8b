"""Running folds, splits and pages, also with a hot key."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import ordering
from driftline.operators.joins import hot_join


def hot_rows(n=3000):
    """A third of all rows share one key."""
    rng = random.Random(1)
    return [(("hot" if i % 3 == 0 else f"k{rng.randint(0, 400)}"), i, rng.randint(0, 50)) for i in range(n)]


@pytest.fixture
def many_partitions(spark):
    """Keep small partitions apart, so that keys really are cut across them."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield spark
    spark.conf.set(name, old)


@pytest.mark.parametrize("how, inclusive", [("sum", True), ("sum", False), ("max", True), ("max", False), ("min", True)])
def test_running(many_partitions, how, inclusive):
    rows = hot_rows()
    df = many_partitions.createDataFrame(rows, "k string, i int, v int")
    found = ordering.running(df, ["k"], ["i"], {"r": (how, F.col("v"))}, inclusive)
    want, state = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        before = state.get(k)
        after = v if before is None else {"sum": before + v, "max": max(before, v), "min": min(before, v)}[how]
        state[k] = after
        want[i] = after if inclusive else (before if how != "sum" else before or 0)
    assert {r["i"]: r["r"] for r in found.collect()} == want
    placed = ordering.placed(df, ["k"], ["i"])
    assert placed.where("k = 'hot'").select("__part").distinct().count() > 1


def test_numbered_without_keys(many_partitions):
    df = many_partitions.range(5000).select((F.col("id") * 7919 % 5000).alias("id"))
    found = ordering.numbered(df, [], ["id"], "n")
    assert found.where("n <> id + 1").count() == 0 and found.count() == 5000


def test_latest_per_key_limits_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(), "k string, i int, v int")
    found = ordering.latest_per_key(df, ["k"], [F.desc("i")])
    plan = found._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert found.where("k = 'hot'").first()["i"] == 2997


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_hot_join(spark, how):
    fact = spark.createDataFrame(hot_rows(), "k string, i int, v int")
    dim = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k1", "c")], "k string, w string")
    plain = sorted(map(tuple, fact.join(dim, "k", how).collect()), key=str)
    assert sorted(map(tuple, hot_join(fact, dim, ["k"], how).collect()), key=str) == plain


def test_hot_join_never_broadcasts(spark):
    """The repeated side grows with the input: broadcast, every task would hold all of it."""
    fact, dim = spark.range(100).selectExpr("id % 7 AS k", "id"), spark.range(7).selectExpr("id AS k", "id * 2 AS v")
    joined = hot_join(fact, dim, ["k"], spread=F.col("id"))
    assert joined.count() == 100
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_hot_join_refuses_full(spark):
    df = spark.range(3)
    with pytest.raises(ValueError):
        hot_join(df, df, ["id"], "full_outer")


def test_balance_by_bytes(many_partitions):
    rng = random.Random(3)
    rows = [(f"/f{i:05d}", rng.randint(0, 1000)) for i in range(4000)]
    total = sum(n for _, n in rows)
    df = many_partitions.createDataFrame(rows, "rel_path string, length long")
    parts = ordering.balance_by_bytes(df, 10).groupBy("part").agg(
        F.sum("length").alias("bytes"), F.min("rel_path").alias("a"), F.max("rel_path").alias("b")).orderBy("part").collect()
    assert sum(p["bytes"] for p in parts) == total and len(parts) == 10
    # contiguous, and neighbours differ by less than a tenth of the mean, the last part aside
    assert all(x["b"] < y["a"] for x, y in zip(parts, parts[1:]))
    assert all(abs(x["bytes"] - y["bytes"]) < 0.1 * total / 10 for x, y in zip(parts[:-1], parts[1:-1]))


def test_balance_of_empty_files(spark):
    df = spark.createDataFrame([("/a", 0), ("/b", 0)], "rel_path string, length long")
    assert [r["part"] for r in ordering.balance_by_bytes(df, 4).collect()] == [0, 0]


@pytest.mark.parametrize("sort", ["ASC", "DESC"])
def test_pages_by_cursor_are_those_by_offset(spark, tmp_path, sort):
    rng = random.Random(sort)
    rows = [(n, rng.choice([None, None, 1, 2, 3, 7]), rng.choice([None, "a", "b"])) for n in range(60)]
    spark.createDataFrame(rows, "id long, g long, t string").write.parquet(str(tmp_path / "rows"))
    df, tie, at = spark.read.parquet(str(tmp_path / "rows")), ["t", "id"], None
    for k in range(0, 63, 9):
        by_offset = ordering.page(df, "g", sort, k, 9, tie).collect()
        rows = ordering.page_after(df, "g", at, sort, 9, tie)
        assert rows.collect() == by_offset
        at = ordering.cursor(rows, "g", tie, sort) if by_offset else at
    plan = ordering.page_after(df, "g", (3, "a", 5), sort, 9, tie)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Or(GreaterThan(g,3)" in plan.replace("LessThan", "GreaterThan")
    with pytest.raises(ValueError, match="cursor"):
        ordering.page_after(df, "g", (3, "a"), sort, 9, tie)


def test_pages_do_not_overlap(spark):
    df = spark.range(50).select("id", (F.col("id") % 3).alias("g"))
    seen = [r["id"] for k in range(0, 50, 7) for r in ordering.page(df, "g", "ASC", k, 7, ["id"]).collect()]
    assert sorted(seen) == list(range(50))
    assert ordering.page_size(None) == 10 and ordering.page_size(5000) == 5000 and ordering.page_size(-1) == 10
    with pytest.raises(ValueError):
        ordering.page(df, "g", n=5000, cap=1000)
    with pytest.raises(ValueError):
        ordering.page(df, "g", "up")
    with pytest.raises(ValueError):
        ordering.page(df, "h", allowed=["g"])
