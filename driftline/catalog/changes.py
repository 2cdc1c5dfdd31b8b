"""Changes to the store: versions, loads, purges, updates, overlaps and retries."""

from datetime import datetime

from pyspark.sql import functions as F

from driftline.catalog.registry import NOW, query
from driftline.functions.times import moment
from driftline.operators import changes, clusters
from driftline.sources import events
from driftline.sources.scratch import scratch_path


@query("next_versions", "policy_version policy", """
WITH fresh AS (SELECT CASE WHEN CAST(id AS INT) % 2 = 0 THEN name ELSE 'group' || CAST(CAST(id AS INT) % 7 AS VARCHAR) END AS name, id FROM policy UNION ALL SELECT name, id || 'b' FROM policy WHERE CAST(id AS INT) % 6 = 0 UNION ALL SELECT 'new' || id, id || 'c' FROM policy WHERE CAST(id AS INT) % 5 = 0),
counted AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS nth FROM fresh),
latest AS (SELECT name, max(version) AS v, arg_max(status NOT IN ('SUCCEEDED', 'FAILED') AND retirement_time IS NULL, version) AS busy FROM policy_version GROUP BY name)
SELECT c.name, c.id, coalesce(busy, false) OR nth > 1 AS conflict, CASE WHEN NOT (coalesce(busy, false) OR nth > 1) THEN CAST(coalesce(v, 0) + nth AS INT) END AS version
FROM counted c LEFT JOIN latest l ON l.name = c.name""")
def next_versions(d):
    n = F.col("id").cast("int")
    rows = d.policy.select("name", "id")
    group = F.concat(F.lit("group"), (n % 7).cast("string"))
    new = (rows.withColumn("name", F.when(n % 2 == 0, F.col("name")).otherwise(group))
           .unionByName(rows.where(n % 6 == 0).withColumn("id", F.concat("id", F.lit("b"))))
           .unionByName(rows.where(n % 5 == 0).select(F.concat(F.lit("new"), "id").alias("name"),
                                                      F.concat("id", F.lit("c")).alias("id"))))
    return changes.next_versions(new, d.policy_version, ["id"])


@query("incremental_export", "change", "SELECT change_id, key, op, (SELECT max(change_id) FROM change) AS new_id FROM change WHERE change_id > 400")
def incremental_export(d):
    rows, newest = changes.incremental_export(d.change, 400)
    return rows.select("change_id", "key", "op", F.lit(newest).cast("bigint").alias("new_id"))


@query("incremental_export_bootstrap", "change", "SELECT change_id, (SELECT max(change_id) FROM change) AS new_id FROM change")
def incremental_export_bootstrap(d):
    rows, newest = changes.incremental_export(d.change, 0)
    return rows.select("change_id", F.lit(newest).cast("bigint").alias("new_id"))


LOADED = """
WITH base AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE -c_custkey END AS key, 'base' AS kind, c_acctbal AS amount FROM customer),
last AS (SELECT key, max(change_id) AS id FROM change WHERE change_id > 300 GROUP BY key),
final AS (SELECT c.key, c.op, c.kind, c.amount FROM change c JOIN last l ON l.key = c.key AND l.id = c.change_id)
SELECT coalesce(f.key, b.key) AS key, CASE WHEN f.key IS NOT NULL THEN f.kind ELSE b.kind END AS kind, CASE WHEN f.key IS NOT NULL THEN f.amount ELSE b.amount END AS amount
FROM base b FULL JOIN final f ON f.key = b.key WHERE f.key IS NULL OR f.op <> 'DELETE'"""


def base(d):
    # odd customers go by another key: changes of theirs find no row
    return d.table("customer").select(
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).otherwise(-F.col("c_custkey")).alias("key"),
        F.lit("base").alias("kind"), F.col("c_acctbal").alias("amount"))


@query("incremental_load", "change", LOADED)
def incremental_load(d):
    return changes.incremental_load(base(d), d.change, ["key"], 300)


@query("incremental_load_twice", "change", LOADED)
def incremental_load_twice(d):
    newest = d.change.agg(F.max("change_id")).first()[0]
    once = changes.incremental_load(base(d), d.change, ["key"], 300)
    return changes.incremental_load(once, d.change, ["key"], newest)


@query("retention_purge", "policy policy_instance property job_step", """
WITH old AS (SELECT id FROM policy WHERE retirement_time < TIMESTAMP '2001-07-03 00:00:00'),
runs AS (SELECT order_key FROM policy_instance WHERE policy_id IN (SELECT id FROM old))
SELECT 'policy' AS kept, count(*) AS rows FROM policy WHERE id NOT IN (SELECT id FROM old)
UNION ALL SELECT 'property', count(*) FROM property WHERE owner_id NOT IN (SELECT id FROM old)
UNION ALL SELECT 'policy_instance', count(*) FROM policy_instance WHERE policy_id NOT IN (SELECT id FROM old)
UNION ALL SELECT 'instance_job', count(*) FROM job_step WHERE order_key NOT IN (SELECT order_key FROM runs)""")
def retention_purge(d):
    kept = changes.retention_purge(d.policy, d.property, d.policy_instance, d.job_step, NOW, 60)
    counts = [rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("kept"), "rows") for name, rows in kept.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


@query("purge_rows", "policy_instance", """
SELECT id FROM policy_instance WHERE retirement_time IS NULL OR retirement_time >= TIMESTAMP '2001-01-01 00:00:00'""")
def purge_rows(d):
    return changes.purge_rows(d.policy_instance, datetime(2001, 1, 1)).select("id")


DELETED = """
WITH hit AS (SELECT id FROM policy WHERE retirement_time IS NULL AND name LIKE '%3'),
runs AS (SELECT order_key FROM policy_instance WHERE policy_id IN (SELECT id FROM hit) AND retirement_time IS NULL)
"""


def deleted(d):
    jobs = d.job_step.withColumn("retirement_time", F.lit(None).cast("timestamp_ntz")).withColumn("status", F.col("status"))
    return changes.soft_delete(d.policy, d.policy_instance, jobs, d.policy.where("name like '%3'"), NOW)


@query("soft_delete_policies", "policy policy_instance", DELETED + """
SELECT id, CASE WHEN id IN (SELECT id FROM hit) THEN 'DELETED' ELSE status END AS status, CASE WHEN id IN (SELECT id FROM hit) THEN TIMESTAMP '2001-09-01 00:00:00' ELSE retirement_time END AS retirement_time FROM policy""")
def soft_delete_policies(d):
    return deleted(d)["policy"].select("id", "status", "retirement_time")


@query("soft_delete_runs", "policy policy_instance", DELETED + """
SELECT id, status, CASE WHEN order_key IN (SELECT order_key FROM runs) THEN TIMESTAMP '2001-09-01 00:00:00' ELSE retirement_time END AS retirement_time FROM policy_instance""")
def soft_delete_runs(d):
    return deleted(d)["policy_instance"].select("id", "status", "retirement_time")


@query("soft_delete_jobs", "policy policy_instance job_step", DELETED + """
SELECT order_key, status, CASE WHEN order_key IN (SELECT order_key FROM runs) THEN TIMESTAMP '2001-09-01 00:00:00' END AS retirement_time FROM job_step""")
def soft_delete_jobs(d):
    return deleted(d)["instance_job"].select("order_key", "status", "retirement_time")


@query("retire_clusters", "cluster", """
SELECT name, version, CASE WHEN name IN ('cl1', 'cl4') AND retirement_time IS NULL THEN TIMESTAMP '2001-09-01 00:00:00' ELSE retirement_time END AS retirement_time FROM cluster""")
def retire_clusters(d):
    rows = d.cluster
    return changes.retire(rows, rows.where("name in ('cl1', 'cl4')"), ["name"], NOW).select("name", "version", "retirement_time")


@query("update_pair_status", "cluster_pair", "SELECT cluster, paired_cluster, CASE WHEN cluster = 'cl0' THEN 'UNPAIRED' ELSE status END AS status FROM cluster_pair")
def update_pair_status(d):
    keys = ["cluster", "version", "paired_cluster", "paired_version"]
    pairs = d.cluster_pair
    updates = pairs.where("cluster = 'cl0'").select(*keys, F.lit("UNPAIRED").alias("status"))
    return changes.apply_updates(pairs, updates, keys).select("cluster", "paired_cluster", "status")


@query("complete_runs", "policy_instance", """
SELECT id, CASE WHEN order_key % 4 = 1 AND status = 'RUNNING' THEN 'FAILED' ELSE status END AS status,
 CASE WHEN order_key % 4 = 1 AND status = 'RUNNING' THEN TIMESTAMP '2001-09-01 00:00:00' ELSE end_time END AS end_time,
 CASE WHEN order_key % 4 = 1 AND status = 'RUNNING' THEN 4100 ELSE 0 END AS message_length FROM policy_instance""")
def complete_runs(d):
    runs = d.policy_instance.withColumn("message", F.lit(""))
    updates = runs.where("status = 'RUNNING' and order_key % 4 = 1").select(
        "id", F.lit("FAILED").alias("status"), moment(NOW).alias("end_time"),
        F.repeat(F.lit("x"), F.lit(4100)).alias("message"), F.lit(2).alias("nth"))
    # an earlier update of the same runs, of which nothing is left
    earlier = updates.withColumns({"status": F.lit("KILLED"), "message": F.lit("y"), "nth": F.lit(1)})
    done = changes.apply_updates(runs, updates.unionByName(earlier), ["id"], order="nth")
    return done.select("id", "status", "end_time", F.length("message").alias("message_length"))


@query("mark_open_jobs", "job_step policy_instance", """
SELECT j.order_key, CASE WHEN j.status = 'SUBMITTED' AND i.status = 'KILLED' THEN 'KILLED' ELSE j.status END AS status, count(*) AS jobs
FROM job_step j LEFT JOIN policy_instance i ON i.order_key = j.order_key GROUP BY ALL""")
def mark_open_jobs(d):
    killed = d.policy_instance.where("status = 'KILLED'").select("order_key", "status")
    done = changes.apply_updates(d.job_step, killed, ["order_key"], only=F.col("status") == "SUBMITTED", hot=True)
    return done.groupBy("order_key", "status").agg(F.count("*").alias("jobs"))


@query("rerun", "policy_instance", """
SELECT id, CASE WHEN status = 'KILLED' THEN 'RUNNING' ELSE status END AS status, CASE WHEN status <> 'KILLED' THEN end_time END AS end_time,
 CAST(run_count + CASE WHEN status = 'KILLED' THEN 1 ELSE 0 END AS INT) AS run_count FROM policy_instance""")
def rerun(d):
    done = changes.rerun(d.policy_instance, d.policy_instance.where("status = 'KILLED'"))
    return done.select("id", "status", "end_time", "run_count")


@query("recover_interrupted", "policy policy_instance", """
WITH owners AS (SELECT id, CASE WHEN retirement_time IS NOT NULL THEN 'DELETED' ELSE status END AS status, retirement_time FROM policy)
SELECT i.id, CASE WHEN i.status <> 'RUNNING' THEN i.status WHEN o.status = 'DELETED' THEN 'DELETED' ELSE 'KILLED' END AS status,
 CASE WHEN i.status <> 'RUNNING' THEN i.end_time ELSE TIMESTAMP '2001-09-01 00:00:00' END AS end_time,
 CASE WHEN i.status <> 'RUNNING' THEN i.retirement_time WHEN o.status = 'DELETED' THEN o.retirement_time ELSE TIMESTAMP '2001-09-01 00:00:00' END AS retirement_time
FROM policy_instance i JOIN owners o ON o.id = i.policy_id""")
def recover_interrupted(d):
    owners = d.policy.withColumn("status", F.when(F.col("retirement_time").isNotNull(), "DELETED").otherwise(F.col("status")))
    done = changes.recover_interrupted(owners, d.policy_instance, d.policy_instance.where("status = 'RUNNING'"), NOW)
    return done.select("id", "status", "end_time", "retirement_time")


OVERLAPS = """
WITH RECURSIVE runs AS (SELECT policy_id, id, start_time, end_time, row_number() OVER (PARTITION BY policy_id ORDER BY start_time, id) AS rn FROM history),
walk AS (
 SELECT policy_id, rn, id, CAST(NULL AS VARCHAR) AS blocked_by, id AS runner, coalesce(end_time, TIMESTAMP '9999-01-01 00:00:00') AS busy FROM runs WHERE rn = 1
 UNION ALL SELECT r.policy_id, r.rn, r.id, CASE WHEN r.start_time < w.busy THEN w.runner END, CASE WHEN r.start_time < w.busy THEN w.runner ELSE r.id END,
  CASE WHEN r.start_time < w.busy THEN w.busy ELSE coalesce(r.end_time, TIMESTAMP '9999-01-01 00:00:00') END
 FROM walk w JOIN runs r ON r.policy_id = w.policy_id AND r.rn = w.rn + 1)
SELECT policy_id, id, blocked_by, CASE WHEN blocked_by IS NULL THEN 'RUN' ELSE 'SKIPPED' END AS overlap_status FROM walk"""


@query("mark_overlaps", "policy_instance", OVERLAPS.replace("history", "policy_instance"))
def mark_overlaps(d):
    return changes.mark_overlaps(d.policy_instance).drop("start_time", "end_time")


@query("mark_overlaps_dense", "policy_instance", OVERLAPS.replace("FROM history", """FROM (SELECT policy_id, id, start_time,
 CASE WHEN order_key % 50 > 0 THEN start_time + INTERVAL 1 DAY * CAST(5 + order_key % 300 AS INT) END AS end_time FROM policy_instance)"""))
def mark_overlaps_dense(d):
    long_runs = d.policy_instance.withColumn("end_time", F.when(
        F.col("order_key") % 50 > 0, F.col("start_time") + F.make_dt_interval((5 + F.col("order_key") % 300).cast("int"))))
    return changes.mark_overlaps(long_runs).drop("start_time", "end_time")


@query("next_retry", "policy_instance policy", """
SELECT i.id, CASE WHEN i.run_count < 2 + CAST(p.id AS INT) % 2 THEN i.end_time + INTERVAL 1 SECOND * CAST((CASE WHEN i.run_count = 0 THEN 0 WHEN i.run_count = 1 THEN 1 WHEN i.run_count = 2 THEN 2 ELSE 4 END)
 * (CASE WHEN CAST(p.id AS INT) % 5 = 0 THEN 30 ELSE 10 * (CAST(p.id AS INT) % 5) END) AS INT) END AS retry_at FROM policy_instance i JOIN policy p ON p.id = i.policy_id WHERE i.status = 'FAILED'""")
def next_retry(d):
    n = F.col("id").cast("int")
    rules = d.policy.select("id", (2 + n % 2).alias("retry_attempts"), (10 * (n % 5)).alias("retry_delay"))
    return changes.next_retry(d.policy_instance.where("status = 'FAILED'"), rules).select("id", "retry_at")


@query("apply_entity_changes", "policy", """
SELECT id, name, CASE WHEN retirement_time IS NULL AND CAST(id AS INT) % 3 = 0 AND CAST(id AS INT) % 2 = 0 THEN 'note' ELSE tags END AS tags,
 CASE WHEN retirement_time IS NULL AND CAST(id AS INT) % 3 = 0 THEN 999 ELSE frequency END AS frequency, CASE WHEN retirement_time IS NULL AND CAST(id AS INT) % 3 = 0 THEN 2 ELSE 1 END AS change_id FROM policy""")
def apply_entity_changes(d):
    rows = d.policy.withColumn("change_id", F.lit(1))
    edits = rows.where("cast(id as int) % 3 = 0").select(
        "id", F.when(F.col("id").cast("int") % 2 == 0, "note").alias("tags"), F.lit(999).alias("frequency"))
    return changes.apply_entity_changes(rows, edits, "id").select("id", "name", "tags", "frequency", "change_id")


@query("apply_property_changes", "property property_edit", "SELECT owner_id, property, value FROM property_edit")
def apply_property_changes(d):
    keys = ["owner_id", "property"]
    return changes.apply_property_changes(d.property, clusters.diff_properties(d.property, d.property_edit, keys, True), keys)


LEGAL = "(entity_type = 'policy' AND event_code IN (2, 3, 6, 7, 9, 10)) OR (entity_type = 'policyinstance' AND event_code IN (3, 8, 11, 12, 13))"
MIXED = "WITH mixed AS (SELECT id, CASE WHEN id % 10 = 0 THEN 'policy' ELSE entity_type END AS entity_type, event_code FROM event)\n"


def mixed(d):
    return d.event.withColumn("entity_type", F.when(F.col("id") % 10 == 0, "policy").otherwise(F.col("entity_type")))


@query("append_events", "event", MIXED + f"SELECT id, entity_type, event_code, CASE WHEN event_code = 11 THEN 'error' ELSE 'info' END AS severity FROM mixed WHERE {LEGAL}")
def append_events(d):
    place = scratch_path(d.spark, "events")
    events.append_events(mixed(d), place)
    return d.spark.read.parquet(place).select("id", "entity_type", "event_code", "severity")


@query("rejected_events", "event", MIXED + f"SELECT id, entity_type, event_code FROM mixed WHERE NOT ({LEGAL})")
def rejected_events(d):
    return events.append_events(mixed(d), scratch_path(d.spark, "events")).select("id", "entity_type", "event_code")
