"""Logs, progress and tracking."""

from datetime import datetime

from pyspark.sql import functions as F

from driftline.catalog.registry import query
from driftline.operators import logs, progress

RECORDS = r"""
WITH marked AS (SELECT line_no, line, CASE WHEN regexp_matches(line, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}\s+\w+\s+') THEN 1 ELSE 0 END AS starts FROM log_line),
counted AS (SELECT *, CAST(sum(starts) OVER (ORDER BY line_no) AS BIGINT) AS record FROM marked),
records AS (SELECT record, max(CASE WHEN starts = 1 THEN line END) AS first, string_agg(line, chr(10) ORDER BY line_no) AS text FROM counted WHERE record > 0 GROUP BY record),
parsed AS (SELECT record, left(first, 23) AS time, regexp_extract(first, '^.{23}\s+(\w+)\s+(.*)$', 1) AS level, regexp_extract(first, '^.{23}\s+(\w+)\s+(.*)$', 2) AS message, text FROM records)
"""
FROM, TO = datetime(2024, 1, 3, 6, 0, 0), datetime(2024, 1, 9, 12, 30, 0)
FOUND = r"""SELECT record, time, level, text FROM parsed WHERE time >= '2024-01-03 06:00:00' AND time <= '2024-01-09 12:30:00' AND regexp_matches(message, 'POLICYNAME\[p7\]|POLICYID\[11\]')"""


def records(d):
    return logs.assemble_log_records(d.log_line, ["line_no"])


@query("assemble_log_records", "log_line", RECORDS + "SELECT record, time, level, message, text FROM parsed")
def assemble_log_records(d):
    return records(d).select("record", "time", "level", "message", "text")


@query("matching_log_records", "log_line", RECORDS + FOUND)
def matching_log_records(d):
    return logs.matching_records(records(d), {"policyname": "p7", "policyid": "11"}, FROM, TO).select("record", "time", "level", "text")


@query("search_logs", "log_line", RECORDS + FOUND + " ORDER BY time DESC, record DESC LIMIT 12")
def search_logs(d):
    return logs.search_logs(records(d), {"policyname": "p7", "policyid": "11"}, FROM, TO, 12).select("record", "time", "level", "text")


# Tasks of copy jobs: one per order, one job per customer; files copied: one per order line.
@query("copy_progress", "", """
WITH tasks AS (SELECT o_custkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'FAILED' ELSE 'KILLED' END ELSE CASE WHEN o_custkey % 3 = 0 THEN 'SUCCEEDED' ELSE 'RUNNING' END END AS state,
  o_orderkey AS start_ms, o_orderkey + 500 AS end_ms, CAST(o_orderkey % 64 AS DOUBLE) / 64 AS part FROM orders),
results AS (SELECT o_custkey AS job_id, CASE l_returnflag WHEN 'A' THEN 'OVERWRITE' WHEN 'R' THEN 'SKIP' ELSE 'MKDIR' END AS action, CAST(l_quantity AS BIGINT) AS bytes FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
a AS (SELECT job_id, count(*) AS total, CAST(sum(CASE WHEN state = 'SUCCEEDED' THEN 1 ELSE 0 END) AS BIGINT) AS succeeded, CAST(sum(CASE WHEN state = 'FAILED' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
 CAST(sum(CASE WHEN state = 'KILLED' THEN 1 ELSE 0 END) AS BIGINT) AS killed, bool_and(state <> 'RUNNING') AS complete, avg(part) AS mean, max(end_ms) - min(start_ms) AS time_taken FROM tasks GROUP BY job_id),
b AS (SELECT job_id, CAST(sum(CASE WHEN action = 'OVERWRITE' THEN 1 ELSE 0 END) AS BIGINT) AS files_copied, CAST(sum(CASE WHEN action = 'MKDIR' THEN 1 ELSE 0 END) AS BIGINT) AS dirs_copied,
 CAST(sum(CASE WHEN action = 'OVERWRITE' THEN bytes ELSE 0 END) AS BIGINT) AS bytes_copied FROM results GROUP BY job_id)
SELECT a.job_id, time_taken, complete, round(CASE WHEN complete THEN CAST(100.0 AS DOUBLE) ELSE mean * 100 END, 2) AS progress, total, CASE WHEN complete THEN total ELSE succeeded END AS completed, failed, killed,
 coalesce(files_copied, 0) AS files_copied, coalesce(dirs_copied, 0) AS dirs_copied, coalesce(bytes_copied, 0) AS bytes_copied FROM a LEFT JOIN b ON b.job_id = a.job_id""")
def copy_progress(d):
    orders = d.table("orders")
    state = (F.when(F.col("o_orderstatus") == "F", "SUCCEEDED")
             .when(F.col("o_orderstatus") == "P", F.when(F.col("o_orderkey") % 2 == 0, "FAILED").otherwise("KILLED"))
             .otherwise(F.when(F.col("o_custkey") % 3 == 0, "SUCCEEDED").otherwise("RUNNING")))
    tasks = orders.select(F.col("o_custkey").alias("job_id"), state.alias("state"), F.col("o_orderkey").alias("start_ms"),
                          (F.col("o_orderkey") + 500).alias("end_ms"), ((F.col("o_orderkey") % 64) / 64.0).alias("progress"))
    flag = F.col("l_returnflag")
    results = d.table("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("job_id"),
        F.when(flag == "A", "OVERWRITE").when(flag == "R", "SKIP").otherwise("MKDIR").alias("action"),
        F.col("l_quantity").cast("bigint").alias("bytes"))
    done = progress.copy_progress(tasks, results)
    open_jobs = tasks.groupBy("job_id").agg(F.min((F.col("state") != "RUNNING").cast("int")).alias("c"))
    return done.join(open_jobs, "job_id").select(
        "job_id", "time_taken", (F.col("c") == 1).alias("complete"), "progress", "total",
        "completed", "failed", "killed", "files_copied", "dirs_copied", "bytes_copied")


# A query log per customer: START, one line per order, END for two of three customers; every fifth has an import as well.
LOG_CTE = """
WITH numbered AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
steps AS (SELECT CAST(o_custkey AS VARCHAR) AS run_id, 'EXPORT' AS action, CASE WHEN o_custkey % 2 = 0 THEN 'BOOTSTRAP' ELSE 'INCREMENTAL' END AS kind, k, n,
  CASE WHEN o_custkey % 3 < 2 THEN n ELSE n - 1 END AS seen, o_custkey % 3 < 2 AS ended, o_custkey % 4 < 3 AS started FROM numbered
 UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'IMPORT', CASE WHEN o_custkey % 2 = 0 THEN 'BOOTSTRAP' ELSE 'INCREMENTAL' END, k, n, CASE WHEN o_custkey % 10 = 0 THEN n ELSE n // 2 END, o_custkey % 10 = 0, true FROM numbered WHERE o_custkey % 5 = 0),
runs AS (SELECT run_id, action, any_value(kind) AS kind, any_value(n) AS n, any_value(seen) AS seen, any_value(ended) AS ended, any_value(started) AS started FROM steps GROUP BY run_id, action),
present AS (SELECT * FROM runs WHERE started OR ended OR seen > 0),
state AS (SELECT run_id, action, CASE WHEN started OR ended THEN kind END AS kind, n AS total,
  CASE WHEN ended THEN n ELSE greatest(seen, 0) END AS completed FROM present)
"""


def query_log(d):
    """Log lines of all runs, made from the orders of each customer."""
    w_run = F.col("o_custkey")
    counts = d.table("orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    bootstrap = w_run % 2 == 0
    kind = F.when(bootstrap, "BOOTSTRAP").otherwise("INCREMENTAL")

    def lines(runs, action, seen, started, ended, start_keys, step_events, step_keys, end_keys):
        word = F.when(bootstrap, step_events[0]).otherwise(step_events[1])
        key = F.when(bootstrap, step_keys[0]).otherwise(step_keys[1])
        type_key = "dumpType" if action == "EXPORT" else "loadType"

        def json(keys, value):
            field = F.when(bootstrap, keys[0]).otherwise(keys[1])
            return F.concat(F.lit('{"dbName":"db","%s":"' % type_key), kind, F.lit('","'), field, F.lit('":'), value.cast("string"), F.lit("}"))

        first = runs.where(started).select("o_custkey", F.lit(0).cast("bigint").alias("seq"), F.concat(
            F.lit("INFO  : REPL::START: "), json(start_keys, F.col("n"))).alias("line"))
        steps = runs.select("o_custkey", "n", F.explode(F.when(seen > 0, F.sequence(F.lit(1).cast("bigint"), seen))).alias("seq")).select(
            "o_custkey", "seq", F.concat(F.lit("INFO  : REPL::"), word, F.lit(': {"tableName":"t..END..","'), key, F.lit('":"'),
                                         F.col("seq").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit('"}')).alias("line"))
        last = runs.where(ended).select("o_custkey", (F.col("n") + 1).alias("seq"), F.concat(
            F.lit("INFO  : REPL::END: "), json(end_keys, F.col("n"))).alias("line"))
        return first.unionByName(steps).unionByName(last).select(
            F.col("o_custkey").cast("string").alias("run_id"), F.lit(action).alias("action"), "seq", "line")

    n = F.col("n")
    export = lines(counts, "EXPORT", F.when(w_run % 3 < 2, n).otherwise(n - 1), w_run % 4 < 3, w_run % 3 < 2,
                   ("estimatedNumTables", "estimatedNumEvents"), ("TABLE_DUMP", "EVENT_DUMP"),
                   ("tablesDumpProgress", "eventsDumpProgress"), ("actualNumTables", "actualNumEvents"))
    load = lines(counts.where(w_run % 5 == 0), "IMPORT", F.when(w_run % 10 == 0, n).otherwise(F.floor(n / 2)), F.lit(True),
                 w_run % 10 == 0, ("numTables", "numEvents"), ("TABLE_LOAD", "EVENT_LOAD"),
                 ("tablesLoadProgress", "eventsLoadProgress"), ("numTables", "numEvents"))
    return export.unionByName(load)


@query("parse_query_log", "", LOG_CTE + """
SELECT run_id, action, CAST(count(*) AS BIGINT) AS lines, CAST(sum(total) AS BIGINT) AS total, CAST(sum(completed) AS BIGINT) AS completed FROM (
 SELECT run_id, action, n AS total, CAST(0 AS BIGINT) AS completed FROM runs WHERE started
 UNION ALL SELECT run_id, action, n, k FROM steps WHERE k <= seen
 UNION ALL SELECT run_id, action, n, n FROM runs WHERE ended) GROUP BY run_id, action""")
def parse_query_log(d):
    parsed = progress.parse_query_log(query_log(d))
    return parsed.groupBy("run_id", "action").agg(
        F.count("event").alias("lines"), F.sum("total").alias("total"), F.coalesce(F.sum("completed"), F.lit(0)).alias("completed"))


@query("hive_run_progress", "", LOG_CTE + "SELECT run_id, action, kind, total, completed FROM state")
def hive_run_progress(d):
    return progress.hive_run_progress(query_log(d))


PERCENT = LOG_CTE + """
, wide AS (SELECT run_id, max(total) FILTER (action = 'EXPORT') AS et, max(completed) FILTER (action = 'EXPORT') AS ec, max(total) FILTER (action = 'IMPORT') AS it, max(completed) FILTER (action = 'IMPORT') AS ic FROM state GROUP BY run_id),
raw AS (SELECT run_id, CASE WHEN et IS NULL THEN 10.0 WHEN et = 0 THEN 10.0 ELSE least(10.0, ec / et * 10.0) END + CASE WHEN it IS NULL THEN 0.0 WHEN it = 0 THEN 90.0 ELSE least(90.0, ic / it * 90.0) END AS p FROM wide)
"""


@query("hive_progress_percent", "", PERCENT + "SELECT run_id, CAST(round(CAST(p AS DOUBLE), 2) AS DOUBLE) AS percent FROM raw")
def hive_progress_percent(d):
    return progress.hive_progress_percent(progress.hive_run_progress(query_log(d)))


@query("hive_progress_bootstrap", "", PERCENT + """
, ids AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS run_id, c_custkey % 6 < 4 AS ds, c_custkey % 6 < 2 AS db FROM customer)
SELECT i.run_id, CAST(round(CAST(CASE WHEN p IS NULL AND db THEN 90.0 WHEN p IS NULL THEN 100.0 WHEN ds AND db THEN p * 0.9 WHEN ds THEN 90.0 + p * 0.1 ELSE p END AS DOUBLE), 2) AS DOUBLE) AS percent FROM ids i LEFT JOIN raw r ON r.run_id = i.run_id""")
def hive_progress_bootstrap(d):
    n = F.col("c_custkey")
    runs = d.table("customer").select(n.cast("string").alias("run_id"), (n % 6 < 4).alias("dataset_bootstrap"),
                                      (n % 6 < 2).alias("database_bootstrap"))
    return progress.hive_progress_percent(progress.hive_run_progress(query_log(d)), runs)


@query("transfer_stats", "transfer", "SELECT plugin, direction, CAST(sum(bytes) AS BIGINT) AS bytes FROM transfer GROUP BY ALL")
def transfer_stats(d):
    return progress.transfer_stats(d.transfer)


# Tracking text of each run: nothing, one object, an array of two, or broken text.
TRACKED = """
WITH tracked AS (SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderkey % 10 AS m, CAST(floor(o_totalprice) AS BIGINT) AS total, o_orderkey % 100 AS pct FROM orders),
decoded AS (SELECT id, 0 AS nth, 'job' || id AS job_id, 'MAIN' AS job_type, total, pct FROM tracked WHERE m BETWEEN 2 AND 8
 UNION ALL SELECT id, 1, 'rec' || id, 'RECOVERY', total, pct FROM tracked WHERE m BETWEEN 6 AND 8)
"""


def metric(job, kind, total, percent):
    return F.concat(F.lit('{"jobId":"'), job, F.lit('","jobType":"' + kind + '","progress":{"total":'), total.cast("string"),
                    F.lit(',"jobProgress":'), percent.cast("string"), F.lit("}}"))


def tracked(d):
    key = F.col("o_orderkey").cast("string")
    total, percent = F.col("o_totalprice").cast("bigint"), F.col("o_orderkey") % 100
    main = metric(F.concat(F.lit("job"), key), "MAIN", total, percent)
    both = F.concat(F.lit("["), main, F.lit(","), metric(F.concat(F.lit("rec"), key), "RECOVERY", total, percent), F.lit("]"))
    m = F.col("o_orderkey") % 10
    text = F.when(m == 0, "").when(m == 1, " ").when(m < 6, main).when(m < 9, both).otherwise('{"jobId":')
    return d.table("orders").select(key.alias("id"), text.alias("tracking_info"))


@query("decode_tracking", "", TRACKED + "SELECT id, CAST(nth AS INT) AS nth, job_id, job_type, total, CAST(pct AS DOUBLE) AS job_progress FROM decoded")
def decode_tracking(d):
    rows = progress.decode_tracking(tracked(d))
    return rows.select("id", "nth", "job_id", "job_type", "total", F.col("jobProgress").alias("job_progress"))


@query("tracking_rejects", "", TRACKED + "SELECT id, '{\"jobId\":' AS tracking_info FROM tracked WHERE m = 9")
def tracking_rejects(d):
    return progress.tracking_rejects(tracked(d))


@query("tracking_update", "", TRACKED + """
, changed AS (SELECT t.id, m, CASE WHEN CAST(t.id AS INT) % 4 = 1 THEN 'MAIN' WHEN CAST(t.id AS INT) % 4 = 2 THEN 'BOTH' WHEN CAST(t.id AS INT) % 4 = 3 THEN 'RECOVERY' END AS kind FROM tracked t)
SELECT d.id, CAST(d.nth AS INT) AS nth, d.job_id, d.job_type FROM decoded d JOIN changed c ON c.id = d.id AND (c.kind IS NULL OR (c.kind = 'RECOVERY' AND d.nth = 0))
UNION ALL SELECT id, CASE WHEN kind = 'RECOVERY' AND m BETWEEN 2 AND 8 THEN 1 ELSE 0 END, 'new' || id, kind FROM changed WHERE kind IN ('MAIN', 'RECOVERY')
UNION ALL SELECT id, 0, 'new' || id, 'MAIN' FROM changed WHERE kind = 'BOTH' UNION ALL SELECT id, 1, 'rec' || id, 'RECOVERY' FROM changed WHERE kind = 'BOTH'""")
def tracking_update(d):
    rows = tracked(d)
    n = F.col("id").cast("int") % 4
    name = F.concat(F.lit("new"), "id")
    updates = rows.where(n.isin(1, 2, 3)).select(
        "id", F.when(n == 3, "RECOVERY").otherwise("MAIN").alias("job_type"),
        F.when(n == 3, metric(name, "RECOVERY", F.lit(1), F.lit(5))).otherwise(metric(name, "MAIN", F.lit(1), F.lit(5))).alias("metric"))
    second = rows.where(n == 2).select("id", F.lit("RECOVERY").alias("job_type"),
                                       metric(F.concat(F.lit("rec"), "id"), "RECOVERY", F.lit(1), F.lit(5)).alias("metric"))
    # every update comes twice, and some runs have one of each kind
    updates = updates.unionByName(second).unionByName(updates)
    return progress.decode_tracking(progress.tracking_update(rows, updates)).select("id", "nth", "job_id", "job_type")
