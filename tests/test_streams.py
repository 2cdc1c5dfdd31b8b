"""Streams: replayed input changes nothing, later input is merged."""

import json
import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftline.plans.copying import DEFAULT_EXCLUDE
from driftline.streaming import streams
from driftline.streaming.batch_table import BatchTable

T0 = datetime(2024, 1, 1)
PROGRESS = "run_id string, seq long, job_id string, percent double"


def add(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_events_once(spark, tmp_path):
    schema = "id long, event_time timestamp, event_code int, entity_type string"
    source, sink, mark, bad = (str(tmp_path / n) for n in ("in", "out", "mark", "bad"))
    rows = [(i, T0 + timedelta(seconds=i), 2, "policy") for i in range(5)]

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        streams.stream_events(stream, sink, mark, bad).awaitTermination()
        return (sorted(r["id"] for r in streams.event_table(spark, sink).collect()),
                sorted(str(r["id"]) for r in spark.read.parquet(bad).collect()))

    add(spark, source, rows + rows[:2], schema)
    assert run() == (list(range(5)), [])
    # the same rows again in another file, one new, one illegal and one without an id
    add(spark, source, rows + [(9, T0 + timedelta(seconds=9), 11, "policyinstance"), (10, T0, 8, "policy"), (None, T0, 2, "policy")], schema)
    assert run() == ([0, 1, 2, 3, 4, 9], ["10", "None"]) == run()
    # events that come hours and days late, one of them for the second time
    # one of them under another day than it had
    add(spark, source, [(4, T0 + timedelta(days=3), 2, "policy"), (20, T0 - timedelta(hours=4), 2, "policy"), (21, T0 - timedelta(days=40), 2, "policy"), (3, T0 + timedelta(seconds=3), 2, "policy")], schema)
    assert run() == ([0, 1, 2, 3, 4, 9, 20, 21], ["10", "None"])


def test_many_batches_of_events(spark, tmp_path):
    """Fifty batches, each with ids of earlier ones under other days: what is read for a batch does not grow, and neither
    does the number of folders."""
    schema = "id long, event_time timestamp, event_code int, entity_type string"
    source, sink, mark, bad = (str(tmp_path / n) for n in ("in", "out", "mark", "bad"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        expected = {}
        for n in range(50):
            rows = [(n * 10 + i, T0 + timedelta(days=n, seconds=i), 2, "policy") for i in range(10)]
            rows += [(max(n - 7, 0) * 10 + i, T0 + timedelta(days=n + 100), 3, "policy") for i in range(3)]
            add(spark, source, rows, schema)
            for i, at, code, _ in sorted(rows):
                expected.setdefault(i, (at, code))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        running = streams.stream_events(stream, sink, mark, bad)
        running.awaitTermination()
        batches = [p for p in running.queries[0].recentProgress if p["numInputRows"]]
        assert len(batches) == 50 and {p["numInputRows"] for p in batches} == {13}
        assert {p["stateOperators"][0]["numRowsUpdated"] for p in batches} <= {10, 13}
        found = [(r["id"], (r["event_time"], r["event_code"])) for r in streams.event_table(spark, sink).collect()]
        assert len(found) == len(expected) and dict(found) == expected
        assert len(list((tmp_path / "out" / "data").iterdir())) < 40
        # another sink behind the same state stays empty of ids that are known, so nothing of the old one was read
        add(spark, source, [(0, T0, 2, "policy"), (777, T0, 2, "policy")], schema)
        streams.stream_events(stream, str(tmp_path / "other"), mark, bad).awaitTermination()
        assert [r["id"] for r in streams.event_table(spark, str(tmp_path / "other")).collect()] == [777]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_a_batch_that_runs_again_gives_the_same_rows(spark, tmp_path):
    """The last batch is taken back from the log of done batches, so the next start runs it once more."""
    schema = "id long, event_time timestamp, event_code int, entity_type string"
    source, mark, bad = (str(tmp_path / n) for n in ("in", "mark", "bad"))

    def run(sink):
        streams.stream_events(spark.readStream.schema(schema).parquet(source), sink, mark, bad).awaitTermination()
        return sorted(tuple(r) for r in streams.event_table(spark, sink).collect())

    add(spark, source, [(1, T0, 2, "policy")], schema)
    run(str(tmp_path / "first"))
    add(spark, source, [(i, T0 + timedelta(days=j), 2 + j % 2, "policy") for i in range(1, 20) for j in (3, 1, 2)], schema)
    once = run(str(tmp_path / "second"))
    assert len(once) == 18 and {r[1:3] for r in once} == {(T0 + timedelta(days=1), 3)}
    (tmp_path / "mark" / "events" / "commits" / "1").unlink()
    (tmp_path / "mark" / "events" / "commits" / ".1.crc").unlink(missing_ok=True)
    assert run(str(tmp_path / "third")) == once


def test_batch_table(spark, tmp_path):
    """Merged level by level, right between any two states, for a reader of an earlier state as well."""
    table = BatchTable(spark, str(tmp_path / "t"), lambda rows: rows.groupBy("k").agg(F.max("v").alias("v")), fan=3, grace=6)
    expected, sizes = {}, []
    for n in range(30):
        rows = [(n % 4, n), (9, 100 - n)]
        before = table.read() if n else None
        table.append(spark.createDataFrame(rows, "k long, v long").coalesce(1), n)
        if n:  # the reader from before the batch still finds its files
            assert dict(before.collect()) == expected
        for k, v in rows:
            expected[k] = max(v, expected.get(k, v))
        assert dict(table.read().collect()) == expected
        sizes.append(len(table.state()["folders"]))
    assert max(sizes) <= 8
    assert len(list((tmp_path / "t" / "data").iterdir())) <= 20
    table.append(spark.createDataFrame([(1, 10**6)], "k long, v long"), 29)  # a batch that runs again
    assert dict(table.read().collect()) == expected
    with pytest.raises(RuntimeError, match="another writer"):
        table._publish(table.state())


def test_progress_equals_its_batch_twin(spark, tmp_path):
    source, sink, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def run():
        stream = streams.stream_progress(spark.readStream.schema(PROGRESS).parquet(source))

        def keep(batch, number):
            batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

        (stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", mark)
         .trigger(availableNow=True).start().awaitTermination())
        found = sorted(tuple(r) for r in streams.top_progress(spark.read.parquet(sink)).collect())
        assert found == sorted(tuple(r) for r in streams.latest_progress(spark.read.schema(PROGRESS).parquet(source)).collect())
        return found

    add(spark, source, [("a", 1, "J1", 10.0), ("a", 2, "j1", 40.0), ("b", 3, "k", 5.0)], PROGRESS)
    assert run() == [("a", 2, "j1", 40.0), ("b", 3, "k", 5.0)]
    # a lower figure of the same job changes nothing; a new job starts below
    add(spark, source, [("a", 4, "j1", 30.0), ("b", 5, "k2", 1.0)], PROGRESS)
    assert run() == [("a", 2, "j1", 40.0), ("b", 5, "k2", 1.0)]
    add(spark, source, [("a", 6, "j1", 40.0), ("b", 7, "k2", 100.0), ("b", 2, "k", 90.0)], PROGRESS)
    assert run() == [("a", 6, "j1", 40.0), ("b", 7, "k2", 100.0)]
    # long after: a late row of the finished job, a late higher figure, and the old job that goes on after all
    add(spark, source, [("b", 6, "k2", 20.0), ("a", 5, "j1", 60.0)], PROGRESS)
    assert run() == [("a", 5, "j1", 60.0), ("b", 7, "k2", 100.0)]
    add(spark, source, [("b", 9, "K", 10.0)], PROGRESS)
    assert run() == [("a", 5, "j1", 60.0), ("b", 2, "k", 90.0)]


def test_new_files(spark, tmp_path):
    root, sink, mark = tmp_path / "root", str(tmp_path / "out"), str(tmp_path / "mark")
    (root / "d").mkdir(parents=True)
    (root / "d" / "one").write_text("1")
    (root / "d" / "two._COPYING_").write_text("2")

    def run():
        found = streams.stream_new_files(spark, str(root), DEFAULT_EXCLUDE)
        (found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", mark)
         .trigger(availableNow=True).start().awaitTermination())
        return sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(sink).collect())

    assert run() == ["one"]
    (root / "three").write_text("333")
    assert run() == ["one", "three"]


def test_new_files_share_tasks(spark, tmp_path):
    """The driver hears from every task: files come by the batch, and many in a task."""
    root, sink, mark = tmp_path / "root", str(tmp_path / "out"), str(tmp_path / "mark")
    root.mkdir()
    for n in range(300):
        (root / f"f{n}").write_text("x")
    found = streams.stream_new_files(spark, str(root), DEFAULT_EXCLUDE)
    tasks, before = [], spark.conf.get("spark.sql.files.openCostInBytes")
    (found.writeStream.foreachBatch(lambda batch, n: tasks.append(batch.rdd.getNumPartitions()))
     .option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination())
    assert sum(tasks) <= 2 * spark.sparkContext.defaultParallelism and spark.conf.get("spark.sql.files.openCostInBytes") == before


def test_new_files_of_several_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 4)
    root, sink, mark = tmp_path / "root", str(tmp_path / "out"), str(tmp_path / "mark")
    root.mkdir()
    for n in range(10):
        (root / f"f{n}").write_text("x" * (n + 1))
    sizes = []
    found = streams.stream_new_files(spark, str(root), DEFAULT_EXCLUDE)
    (found.writeStream.foreachBatch(lambda batch, n: sizes.append(sorted(r["length"] for r in batch.collect())))
     .option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination())
    assert len(sizes) == 3 and sorted(sum(sizes, [])) == list(range(1, 11))


def test_new_files_are_those_a_file_source_finds(spark, tmp_path):
    names = ["a", "d/b", "d/_c", "d/._COPYING_", "d/e._COPYING_", "_h/f", "_k=1/g", ".i/j", "d/_metadata", "with space/ä", "d/.l", "_metadata_m/n"]
    for number, name in enumerate(names):
        (tmp_path / "root" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "root" / name).write_text("x" * number)
        os.utime(tmp_path / "root" / name, ns=(0, (1_700_000_000 - number) * 10**9 + 123_456_789))
    expected = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "root"))
    expected = sorted(map(tuple, expected.select("path", "length", "modificationTime").collect()))
    assert len(expected) == 4
    for turn, root in enumerate((str(tmp_path / "root"), f"file://{tmp_path}/root/", f"{tmp_path}/ro*")):
        rows = []
        found = streams.stream_new_files(spark, root, "^$")
        (found.writeStream.foreachBatch(lambda batch, n: rows.extend(batch.collect()))
         .option("checkpointLocation", str(tmp_path / f"mark{turn}")).trigger(availableNow=True).start().awaitTermination())
        assert sorted(map(tuple, rows)) == expected
    with pytest.raises(FileNotFoundError):
        streams.stream_new_files(spark, str(tmp_path / "none"), "^$")


def test_new_files_are_no_file_of_the_source(spark, tmp_path, monkeypatch):
    """The driver keeps a record of every file of a source: there is one for a batch of paths, the oldest paths first."""
    monkeypatch.setattr(streams, "FILES_PER_BATCH", 5)
    mark, seen = tmp_path / "mark", []
    (tmp_path / "root").mkdir()
    for n in range(12):
        (tmp_path / "root" / f"f{n}").write_text("x" * (n + 1))
        os.utime(tmp_path / "root" / f"f{n}", ns=(0, (1_700_000_000 - n) * 10**9))

    def run():
        (streams.stream_new_files(spark, str(tmp_path / "root"), "^$").writeStream
         .foreachBatch(lambda batch, n: seen.append({r["length"] for r in batch.collect()}))
         .option("checkpointLocation", str(mark)).trigger(availableNow=True).start().awaitTermination())
        logs = [log for log in (mark / "sources/0").iterdir() if log.name[0] != "."]
        return [json.loads(line)["path"] for log in logs for line in log.read_text().splitlines() if line[0] == "{"]

    known = run()
    assert seen == [{12, 11, 10, 9, 8}, {7, 6, 5, 4, 3}, {2, 1}] and len(known) == 3
    # the shared folder may be emptied between two starts
    for path in known:
        os.remove(path.removeprefix("file://"))
    (tmp_path / "root" / "late").write_text("x" * 99)
    run()
    assert [s for s in seen[3:] if s] == [{99}]


def test_new_files_that_come_while_the_query_runs(spark, tmp_path):
    root, sink = tmp_path / "root", str(tmp_path / "out")
    root.mkdir()
    key = "spark.sql.streaming.noDataProgressEventInterval"
    spark.conf.set(key, "500")
    try:
        found = streams.stream_new_files(spark, str(root), DEFAULT_EXCLUDE)
    finally:
        spark.conf.unset(key)
    query = (found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "mark"))
             .trigger(processingTime="200 milliseconds").start())
    try:
        for name in ("one", "two"):
            (root / name).write_text(name)
            until = datetime.now() + timedelta(seconds=60)
            names = []
            while datetime.now() < until and name not in names:
                query.processAllAvailable()
                if os.path.exists(f"{sink}/_spark_metadata/0"):
                    names = sorted(r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(sink).collect())
            assert names == ["one", "two"][:len(names)] and name in names
    finally:
        query.stop()


def test_last_status(spark, tmp_path):
    schema = "policy_id string, id string, status string, end_time timestamp_ntz"
    source, table, mark = (str(tmp_path / n) for n in ("in", "table", "mark"))

    def run():
        stream = spark.readStream.schema(schema).parquet(source)
        streams.stream_last_status(stream, table, mark).awaitTermination()
        return {r["policy_id"]: r["last_status"] for r in streams.last_status_table(spark, table).collect()}

    add(spark, source, [("p", "1", "FAILED", T0), ("p", "2", "SUCCESS", T0 + timedelta(1)), ("q", "3", "RUNNING", None)], schema)
    assert run() == {"p": "SUCCESS"}
    # an older run that arrives late does not win
    add(spark, source, [("p", "0", "KILLED", T0 - timedelta(1)), ("q", "3", "FAILED", T0)], schema)
    assert run() == {"p": "SUCCESS", "q": "FAILED"} == run()


def test_newest_status_takes_repeated_rows(spark):
    schema = "policy_id string, id string, last_status string, end_time timestamp_ntz"
    rows = spark.createDataFrame([("p", "2", "SUCCESS", T0), ("p", "3", "FAILED", T0 + timedelta(1)), ("q", "1", "KILLED", T0)], schema)
    once = streams.newest_status(rows)
    both = streams.newest_status(once.unionByName(rows).unionByName(once))
    assert sorted(once.collect()) == sorted(both.collect())
    assert [r["last_status"] for r in both.orderBy("policy_id").collect()] == ["FAILED", "KILLED"]
