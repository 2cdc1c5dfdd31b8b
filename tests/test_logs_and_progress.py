"""Log records and search, query-log progress, tracking text."""

import gzip
import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftline.operators import logs, progress
from driftline.sources import log_index
from driftline.sources import logs as log_files

DAY = "2017-04-24"


def entry(time, policy, text, trace=()):
    return "\n".join([f"{DAY} {time},269 ERROR - [worker POLICYNAME[{policy}] POLICYID[id-{policy}]] ~ {text}", *trace])


@pytest.fixture
def folder(tmp_path):
    """Five files: hours 05 to 08 and the current one; one is compressed."""
    (tmp_path / f"app-h1.log.{DAY}-05").write_text(entry("05:28:57", "fspolicy", "five") + "\n")
    with gzip.open(tmp_path / f"app-h1.log.{DAY}-06.gz", "wt") as out:
        out.write(entry("06:28:57", "fspolicy", "six") + "\n" + entry("06:40:00", "other", "six b") + "\n")
    (tmp_path / f"app-h1.log.{DAY}-07").write_text(
        "left over from an earlier file\n" + entry("07:28:57", "fspolicy", "seven", ["java.io.IOException: x", "\tat a.b(C)", "\tat d.e(F)"]) + "\n")
    (tmp_path / f"app-h1.log.{DAY}-08").write_text(entry("08:28:57", "fspolicy", "eight") + "\n")
    lines = [entry(f"10:0{i}:00", "fspolicy" if i != 2 else "id1", f"now {i}") for i in range(4)]
    (tmp_path / "app-h1.log").write_text("\n".join(lines) + "\n")
    (tmp_path / f"different.log.{DAY}-07").write_text(entry("07:30:00", "fspolicy", "not ours") + "\n")
    return str(tmp_path)


NOW = datetime(2017, 4, 24, 10, 30)


def search(spark, folder, wanted, start, end, n):
    low, high = log_files.time_range(start, end, NOW)
    lines = log_files.read_logs(spark, folder, low, high, NOW, "app-")
    records = logs.assemble_log_records(lines, log_files.LINE_ORDER)
    return [r["text"] for r in logs.search_logs(records, wanted, low, high, n).collect()]


def by_index(spark, folder, index, wanted, start, end, block_bytes=200):
    found = log_index.list_logs(spark, folder, "app-")
    log_index.update_index(found, index, block_bytes)
    return log_index.search_index(found, index, wanted, start, end)


@pytest.mark.parametrize("block_bytes", [60, 500, 1 << 20])
def test_index_against_brute_force(spark, tmp_path, block_bytes):
    """Plain and packed files, several line ends, lines before the first record, records longer than a block, marks within
    marks, keys in later lines only, files without records."""
    rng = random.Random(block_bytes)
    for n in range(6):
        lines = ["left over", "2017-04-24 no record"] if n % 2 else []
        for i in range(rng.randint(0, 60)):
            value = rng.choice(["a", "b", "a]b", "é", "POLICYID[c]", "x" * 90])
            lines.append(f"{DAY} {rng.randint(0, 23):02d}:00:{i % 60:02d},{i:03d} INFO POLICYNAME[{value}] POLICYID[{i}" + rng.choice(["]", "]", ""]))
            lines += [f"  at POLICYID[late{i}]"] * rng.choice([0, 0, 1, 30])
        text = rng.choice(["\n", "\r\n", "\r"]).join(lines) + rng.choice(["", "\n"])
        name = f"app-{n}.log" + (".gz" if n % 3 == 0 else "")
        with (gzip.open if n % 3 == 0 else open)(tmp_path / name, "wb") as out:
            out.write(text.encode())
    (tmp_path / "app-empty.log").write_text("")
    (tmp_path / "other.log").write_text(entry("07:30:00", "a", "not ours"))
    lines = spark.read.text(str(tmp_path)).where(F.col("_metadata.file_name").startswith("app-")).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("nth"),
        F.col("value").alias("line"))
    records = logs.assemble_log_records(lines, log_files.LINE_ORDER)
    index = str(tmp_path / "index" / "logs")
    for wanted in ({"policyname": "a"}, {"POLICYID": "7", "policyname": "a]b"}, {"policyid": "c"}, {"policyname": "nobody"}, {"policyid": "late3"}, {"policyname": "é"}):
        for start, end in ((datetime(2017, 4, 24), datetime(2017, 4, 25)), (datetime(2017, 4, 24, 9), datetime(2017, 4, 24, 17))):
            whole = logs.matching_records(records, wanted, start, end).collect()
            found = by_index(spark, str(tmp_path), index, wanted, start, end, block_bytes).collect()
            assert sorted(map(repr, found)) == sorted(map(repr, whole))


def test_index_opens_few_blocks_and_follows_the_files(spark, tmp_path):
    for n in range(8):
        (tmp_path / f"app-{n}.log").write_text("\n".join(entry(f"{n:02d}:00:00", f"p{n}-{i}", "x" * 50) for i in range(200)))
    index, day = str(tmp_path / "index" / "logs"), (datetime(2017, 4, 24), datetime(2017, 4, 25))
    found = log_index.list_logs(spark, str(tmp_path), "app-")
    assert log_index.update_index(found, index, 2000) == 8 and log_index.update_index(found, index, 2000) == 0
    blocks = log_index.blocks_to_open(found, index, {"policyname": "p3-77"}, *day)
    assert spark.read.parquet(index).count() > 80 and 1 <= blocks.count() <= 3
    assert blocks.agg(F.sum("size")).first()[0] < 10_000
    assert [r["time"] for r in log_index.search_index(found, index, {"policyname": "p3-77"}, *day, 5).collect()] == [f"{DAY} 03:00:00,269"]
    assert log_index.blocks_to_open(found, index, {"policyname": "p3-77"}, datetime(2017, 4, 24, 5), day[1]).isEmpty()
    # a file that has grown is indexed again, and its old rows count no more
    with open(tmp_path / "app-3.log", "a") as out:
        out.write("\n" + entry("03:30:00", "p3-77", "more"))
    found = log_index.list_logs(spark, str(tmp_path), "app-")
    assert log_index.update_index(found, index, 2000) == 1
    assert log_index.search_index(found, index, {"policyname": "p3-77"}, *day).count() == 2
    with pytest.raises(ValueError, match="cannot search"):
        log_index.blocks_to_open(found, index, {"host": "x"}, *day)


def test_newest_of_the_current_file(spark, folder):
    found = search(spark, folder, {"policyname": "fspolicy"}, datetime(2017, 4, 24), None, 2)
    assert [t.split("~ ")[1] for t in found] == ["now 3", "now 1"]


def test_any_key_matches(spark, folder):
    found = search(spark, folder, {"policyname": "nobody", "POLICYID": "id-id1"}, datetime(2017, 4, 24), None, 5)
    assert [t.split("~ ")[1] for t in found] == ["now 2"]


def test_ranges(spark, folder):
    found = search(spark, folder, {"policyname": "fspolicy"}, datetime(2017, 4, 24, 7, 30, 57), datetime(2017, 4, 24, 8, 54, 20), 5)
    assert [t.split("~ ")[1] for t in found] == ["eight"]
    found = search(spark, folder, {"policyname": "fspolicy"}, datetime(2017, 4, 24), datetime(2017, 4, 24, 8, 20), 4)
    assert [t.split("~ ")[1].split("\n")[0] for t in found] == ["seven", "six", "five"]
    # the trace belongs to its record
    assert found[0].endswith("\tat d.e(F)") and found[0].count("\n") == 3


def test_end_second_is_cut_before_its_milliseconds(spark, folder):
    end = datetime(2017, 4, 24, 8, 28, 57)
    assert search(spark, folder, {"policyname": "fspolicy"}, datetime(2017, 4, 24, 8), end, 5) == []


def test_files_are_pruned_by_name(spark, folder):
    lines = log_files.read_logs(spark, folder, datetime(2017, 4, 24, 5, 10), datetime(2017, 4, 24, 5, 50), NOW, "app-")
    assert [r["line"].split("~ ")[1] for r in lines.collect()] == ["five"]
    lines = log_files.read_logs(spark, folder, datetime(2017, 4, 24, 5, 10), datetime(2017, 4, 24, 6, 30), NOW, "app-")
    assert {r["name"] for r in lines.collect()} == {f"app-h1.log.{DAY}-05", f"app-h1.log.{DAY}-06.gz"}
    # whether only these were opened: the scan's own count of files
    scan = lines._jdf.queryExecution().executedPlan().toString()
    assert "file_name" in scan


def test_time_range_defaults():
    now = datetime(2017, 4, 24, 10)
    assert log_files.time_range(None, None, now) == (datetime(2017, 4, 24, 9), now)
    assert log_files.time_range(None, None, now, 600) == (datetime(2017, 4, 24, 9, 50), now)
    # a start that is not before the end gives the hour before the end
    assert log_files.time_range(now, now, now) == (datetime(2017, 4, 24, 9), now)


def test_unknown_search_key():
    with pytest.raises(ValueError):
        logs.mentions(F.col("message"), {"policyname": "x", "host": "y"})
    with pytest.raises(ValueError):
        logs.mentions(F.col("message"), {})


def line(event, **fields):
    return f"INFO  : REPL::{event}: {json.dumps(fields)}"


def test_splits_do_not_grow_with_the_log():
    from driftline.catalog.files import SPLITS, split_bytes

    assert split_bytes(1000) == 4096
    assert all(size / split_bytes(size) <= SPLITS for size in (10**7, 10**9, 10**12))


def percent(spark, exports, imports=(), runs=None):
    rows = [("r", "EXPORT", i, t) for i, t in enumerate(exports)] + [("r", "IMPORT", i, t) for i, t in enumerate(imports)]
    log = spark.createDataFrame(rows, "run_id string, action string, seq int, line string")
    state = progress.hive_run_progress(log)
    flags = None if runs is None else spark.createDataFrame([("r", *runs)], "run_id string, dataset_bootstrap boolean, database_bootstrap boolean")
    shown = {r["action"]: (r["kind"], r["total"], r["completed"]) for r in state.collect()}
    return shown, progress.hive_progress_percent(state, flags).first()["percent"]


TABLES = [line("START", dbName="d", dumpType="BOOTSTRAP", estimatedNumTables=4, estimatedNumFunctions=0),
          *[line("TABLE_DUMP", dbName="d", tableName=f"t{i}", tablesDumpProgress=f"{i}/4") for i in range(1, 5)],
          line("FUNCTION_DUMP", dbName="d", functionName="f", functionsDumpProgress="1/1"),
          line("END", dbName="d", dumpType="BOOTSTRAP", actualNumTables=4, dumpDir="/x", lastReplId="9")]
LOADED = [line("START", dbName="d", loadType="BOOTSTRAP", numTables=4), line("TABLE_LOAD", tableName="t", tablesLoadProgress="4/4"),
          line("END", dbName="d", loadType="BOOTSTRAP", numTables=4)]
CHANGES = [line("START", dbName="d", dumpType="INCREMENTAL", estimatedNumEvents=10),
           *[line("EVENT_DUMP", eventId=i, eventsDumpProgress=f"{i}/10") for i in range(1, 11)],
           line("END", dbName="d", dumpType="INCREMENTAL", actualNumEvents=10)]


def test_bootstrap(spark):
    assert percent(spark, TABLES) == ({"EXPORT": ("BOOTSTRAP", 4, 4)}, 10.0)
    assert percent(spark, TABLES, LOADED)[1] == 100.0


def test_incremental(spark):
    loading = [line("START", dbName="d", loadType="INCREMENTAL", numEvents=10), line("EVENT_LOAD", eventsLoadProgress="9/10")]
    assert percent(spark, CHANGES, loading)[1] == 91.0
    done = [*loading, line("EVENT_LOAD", eventsLoadProgress="10/10"), line("END", dbName="d", loadType="INCREMENTAL", numEvents=10)]
    assert percent(spark, CHANGES, done)[1] == 100.0


def test_log_that_breaks_off(spark):
    shown, found = percent(spark, TABLES[:4])
    assert shown["EXPORT"] == ("BOOTSTRAP", 4, 3) and found == 7.5
    # a table may be called END: the event type decides
    odd = [TABLES[0], line("TABLE_DUMP", tableName="the_END", tablesDumpProgress="1/4")]
    assert percent(spark, odd)[0]["EXPORT"] == ("BOOTSTRAP", 4, 1)
    assert percent(spark, TABLES[:1])[0]["EXPORT"] == ("BOOTSTRAP", 4, 0)
    # lines without numbers change nothing
    assert percent(spark, TABLES[:1] + TABLES[5:6])[0]["EXPORT"] == ("BOOTSTRAP", 4, 0)


def test_phases_of_a_bootstrap(spark):
    assert percent(spark, TABLES, LOADED, (True, True))[1] == 90.0
    assert percent(spark, CHANGES, (), (True, False))[1] == 91.0
    assert percent(spark, [], LOADED[:1])[1] == 10.0
    # nothing to do counts as done
    empty = [line("START", dumpType="INCREMENTAL", estimatedNumEvents=0)]
    assert percent(spark, empty)[1] == 10.0


def test_tracking(spark):
    one = '{"jobId":"j1","jobType":"MAIN","progress":{"total":3,"unit":"maptasks","jobProgress":12.5}}'
    rows = [("a", None), ("b", " "), ("c", one), ("d", f"[{one}]"), ("e", '{"jobId":'), ("f", "{}")]
    df = spark.createDataFrame(rows, "id string, tracking_info string")
    assert {(r["id"], r["job_id"], r["total"], r["jobProgress"]) for r in progress.decode_tracking(df).collect()} == {
        ("c", "j1", 3, 12.5), ("d", "j1", 3, 12.5)}
    assert {r["id"] for r in progress.tracking_rejects(df).collect()} == {"e", "f"}
    new = one.replace("j1", "j2").replace("MAIN", "RECOVERY")
    updates = spark.createDataFrame([(i, "RECOVERY", new) for i in "acd"], "id string, job_type string, metric string")
    once = progress.tracking_update(df, updates)
    again = progress.tracking_update(once, updates.withColumn("metric", F.regexp_replace("metric", "j2", "j3")))
    found = {}
    for r in progress.decode_tracking(again).orderBy("id", "nth").collect():
        found.setdefault(r["id"], []).append(r["job_id"])
    # a recovery alone stands first; a second one takes the place of the second element
    assert found == {"a": ["j2", "j3"], "c": ["j1", "j3"], "d": ["j1", "j3"]}
    main = updates.select("id", F.lit("MAIN").alias("job_type"), F.lit(one.replace("j1", "m")).alias("metric"))
    assert {r["job_id"] for r in progress.decode_tracking(progress.tracking_update(again, main)).where("id <> 'x'").collect()} == {"m"}


def test_copy_progress(spark):
    tasks = spark.createDataFrame([("j", "SUCCEEDED", 100, 200, 1.0), ("j", "RUNNING", 150, 260, 0.5), ("k", "SUCCEEDED", 0, 10, 1.0),
                                   ("k", "FAILED", 0, 30, 0.2), ("k", "KILLED", 5, 20, 0.1)],
                                  "job_id string, state string, start_ms long, end_ms long, progress double")
    results = spark.createDataFrame([("k", "OVERWRITE", 5), ("k", "MKDIR", 0), ("k", "APPEND", 2), ("k", "SKIP", 0)],
                                    "job_id string, action string, bytes long")
    found = {r["job_id"]: r for r in progress.copy_progress(tasks, results).collect()}
    j, k = found["j"], found["k"]
    assert (j["progress"], j["total"], j["completed"], j["time_taken"], j["files_copied"]) == (75.0, 2, 1, 160, 0)
    assert (k["progress"], k["completed"], k["failed"], k["killed"], k["time_taken"]) == (100.0, 3, 1, 1, 30)
    assert (k["files_copied"], k["dirs_copied"], k["bytes_copied"]) == (2, 1, 7)


def test_search_values_are_no_patterns(spark):
    rows = spark.createDataFrame([("POLICYNAME[a.b]",), ("POLICYNAME[a-b]",), ("POLICYNAME[p(1]",)], "message string")
    assert [r[0] for r in rows.where(logs.mentions(F.col("message"), {"policyname": "a.b"})).collect()] == ["POLICYNAME[a.b]"]
    assert rows.where(logs.mentions(F.col("message"), {"policyname": "p(1"})).count() == 1


def test_long_records_come_in_parts(spark):
    lines = [("f", n, entry("05:00:00", "p", "start") if n in (2, 9) else f"line {n}") for n in range(12)]
    records = logs.assemble_log_records(spark.createDataFrame(lines, "file string, nth int, line string"), ["nth"], part_lines=3)
    rows = sorted((r["record"], r["part"], r["first"] is not None, r["text"].count("\n") + 1) for r in records.collect())
    assert rows == [(1, 0, True, 3), (1, 1, False, 3), (1, 2, False, 1), (2, 0, True, 3)]
