"""List, history and validation queries over the replication store."""

from datetime import datetime

from pyspark.sql import functions as F

from driftline.catalog.registry import NOW, query
from driftline.functions.times import moment
from driftline.operators import clusters, history, ordering, store

DAY = datetime(2024, 1, 2)


@query("list_policies", "policy", """
SELECT * FROM policy WHERE retirement_time IS NULL AND status IN ('RUNNING', 'FAILED') AND type = 'FS' ORDER BY frequency DESC NULLS LAST, id OFFSET 5 LIMIT 10""")
def list_policies(d):
    return store.list_policies(d.policy, "status:RUNNING|FAILED,type:FS,name:", "frequency", "DESC", 5, 10)


@query("policies_filtered", "policy", """
SELECT id, name, source_cluster FROM policy WHERE retirement_time IS NULL AND source_cluster IN ('cl1', 'cl3') AND status = 'SUBMITTED'""")
def policies_filtered(d):
    return store.policies_filtered(d.policy, "sourceCluster:cl1|cl3,status:SUBMITTED").select("id", "name", "source_cluster")


RUNS = """
SELECT i.id, i.policy_id, p.name AS policy_name, p.type AS policy_type, i.status, i.start_time, i.end_time FROM policy_instance i JOIN policy p ON p.id = i.policy_id
"""


@query("list_instances", "policy policy_instance", RUNS + """
WHERE p.retirement_time IS NULL AND i.retirement_time IS NULL AND p.type = 'FS' AND i.status = 'FAILED' AND i.start_time >= TIMESTAMP '1995-01-01 00:00:00'
 AND i.end_time <= TIMESTAMP '1999-12-31 00:00:00' ORDER BY i.start_time DESC NULLS LAST, i.id LIMIT 20""")
def list_instances(d):
    found = store.list_instances(d.policy, d.policy_instance,
                                 "type:FS,status:SUCCESS,startTime:1995-01-01T00:00:00,endTime:1999-12-31T00:00:00,status:FAILED",
                                 "startTime", "DESC", 0, 20)
    return found.select("id", "policy_id", "policy_name", "policy_type", "status", "start_time", "end_time")


@query("list_instances_archived", "policy policy_instance", RUNS + """
WHERE p.retirement_time IS NOT NULL AND i.retirement_time IS NOT NULL ORDER BY i.end_time ASC NULLS FIRST, i.id OFFSET 10 LIMIT 25""")
def list_instances_archived(d):
    found = store.list_instances(d.policy, d.policy_instance, None, "endTime", "ASC", 10, 25, retired=True)
    return found.select("id", "policy_id", "policy_name", "policy_type", "status", "start_time", "end_time")


@query("list_instances_of_policy", "policy policy_instance", RUNS + """
WHERE p.retirement_time IS NULL AND i.retirement_time IS NULL AND p.name = 'Customer#000000005' ORDER BY i.status ASC NULLS FIRST, i.id LIMIT 10""")
def list_instances_of_policy(d):
    found = store.list_instances(d.policy, d.policy_instance, "name:other", "status", "ASC", policy_name="Customer#000000005")
    return found.select("id", "policy_id", "policy_name", "policy_type", "status", "start_time", "end_time")


@query("instances_total", "policy policy_instance", """
SELECT count(*) AS total FROM policy_instance i JOIN policy p ON p.id = i.policy_id WHERE p.retirement_time IS NULL AND i.retirement_time IS NULL AND i.status = 'KILLED'""")
def instances_total(d):
    return store.total_results(store.instances_filtered(d.policy, d.policy_instance, "status:KILLED"))


@query("list_clusters", "cluster cluster_pair property", """
WITH peers AS (SELECT name, version, string_agg(DISTINCT peer, ',' ORDER BY peer) AS peers FROM (
  SELECT cluster AS name, version, paired_cluster AS peer FROM cluster_pair UNION SELECT paired_cluster, paired_version, cluster FROM cluster_pair) GROUP BY ALL),
props AS (SELECT 'cl' || CAST(CAST(owner_id AS INT) % 5 AS STRING) AS name, CAST(5 AS INT) AS version, property, max(value) AS value FROM property GROUP BY ALL),
folded AS (SELECT name, version, string_agg(property || '=' || value, ',' ORDER BY property) AS props FROM props GROUP BY ALL)
SELECT c.name, c.version, c.description, p.peers, f.props FROM cluster c LEFT JOIN peers p ON p.name = c.name AND p.version = c.version
 LEFT JOIN folded f ON f.name = c.name AND f.version = c.version WHERE c.retirement_time IS NULL""")
def list_clusters(d):
    props = d.property.select(F.concat(F.lit("cl"), (F.col("owner_id").cast("int") % 5).cast("string")).alias("name"),
                              F.lit(5).alias("version"), "property", "value")
    found = store.list_clusters(d.cluster, "name", "ASC", 0, 10, d.cluster_pair, props)
    entries = F.transform(F.sort_array(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return found.select("name", "version", "description", F.array_join("peers", ",").alias("peers"),
                        F.array_join(entries, ",").alias("props"))


@query("list_credentials", "credential", """
SELECT * FROM credential WHERE provider IN ('AWS', 'GCS') AND auth_type = 'AWS_ACCESSKEY' ORDER BY creation_time DESC NULLS LAST, id LIMIT 15""")
def list_credentials(d):
    return store.list_credentials(d.credential, "provider:AWS|GCS,authType:AWS_ACCESSKEY", "creation_time", "DESC", 0, 15)


EVENT_COLUMNS = ["id", "policy_id", "instance_id", "entity_type", "event_code", "severity", "event_time", "message"]
EVENTS = "SELECT " + ", ".join(f"e.{c}" for c in EVENT_COLUMNS) + " FROM event e "


@query("events_by_policy_name", "event policy", EVENTS + """
WHERE e.policy_id IN (SELECT id FROM policy WHERE name = 'Customer#000000007') ORDER BY event_time DESC NULLS LAST, id LIMIT 50""")
def events_by_policy_name(d):
    return store.events_query(d.event, d.policy, {"policy_name": "Customer#000000007"}, n=50).select(*EVENT_COLUMNS)


@query("events_by_event_name", "event", EVENTS + "WHERE event_code = 11 ORDER BY severity ASC NULLS FIRST, id OFFSET 20 LIMIT 30")
def events_by_event_name(d):
    return store.events_query(d.event, d.policy, {"event_name": "failed"}, order_by="eventSeverity", sort="ASC",
                              offset=20, n=30).select(*EVENT_COLUMNS)


@query("events_by_entity_type", "event", EVENTS + """
WHERE entity_type = 'policy' AND event_time BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' ORDER BY event_time DESC NULLS LAST, id LIMIT 5000""")
def events_by_entity_type(d):
    return store.events_query(d.event, d.policy, {"entity_type": "policy"}, DAY, datetime(2024, 1, 20), n=5000).select(*EVENT_COLUMNS)


@query("events_by_instance", "event", EVENTS + "WHERE instance_id = '7@7' ORDER BY event_time DESC NULLS LAST, id LIMIT 100")
def events_by_instance(d):
    return store.events_query(d.event, d.policy, {"instance_id": "7@7"}, n=100).select(*EVENT_COLUMNS)


@query("events_by_run", "event policy", EVENTS + """
WHERE instance_id IN (SELECT id || '@11' FROM policy WHERE name = 'Customer#000000011' AND retirement_time IS NULL) ORDER BY event_time DESC NULLS LAST, id LIMIT 100""")
def events_by_run(d):
    return store.events_query(d.event, d.policy, {"policy_run": ("Customer#000000011", 11)}, n=100).select(*EVENT_COLUMNS)


@query("events_all", "event", EVENTS + """
WHERE event_time >= TIMESTAMP '2024-01-02 00:00:00' ORDER BY message DESC NULLS LAST, id LIMIT 10""")
def events_all(d):
    return store.events_query(d.event, d.policy, None, DAY, None, "eventMessage", "DESC").select(*EVENT_COLUMNS)


@query("events_total", "event policy", "SELECT count(*) AS total FROM event e WHERE e.policy_id IN (SELECT id FROM policy WHERE name LIKE 'Customer#%7')")
def events_total(d):
    sevens = d.policy.where("name like 'Customer#%7'").withColumn("name", F.lit("all"))
    return store.total_results(store.events_filtered(d.event, sevens, {"policy_name": "all"}))


RESULT = """
WITH result AS (SELECT e.id, CASE WHEN CAST(policy_id AS INT) % 10 > 0 THEN policy_id END AS policy_id, CASE WHEN CAST(policy_id AS INT) % 10 > 0 THEN instance_id END AS instance_id,
 CASE event_code WHEN 2 THEN 'submitted' WHEN 7 THEN 'scheduled' WHEN 8 THEN 'succeeded' WHEN 11 THEN 'failed' ELSE 'skipped' END AS event, entity_type AS event_type, severity,
 event_time AS timestamp, message, entity_type = 'policy' AND info = '{"syncEvent":true}' AS sync_event FROM event e)
"""


def shown(d):
    blanked = d.event.withColumn("policy_id", F.when(F.col("policy_id").cast("int") % 10 > 0, F.col("policy_id")).otherwise(" "))
    return store.events_result(blanked)


@query("events_result", "event", RESULT + "SELECT * FROM result")
def events_result(d):
    return shown(d)


@query("sync_event_count", "event", RESULT + "SELECT count(*) AS events, CAST(sum(CAST(sync_event AS INT)) AS BIGINT) AS sync_events FROM result")
def sync_event_count(d):
    return store.sync_event_count(shown(d))


@query("active_pair_policies", "policy", """
SELECT least(source_cluster, target_cluster) AS cluster_a, greatest(source_cluster, target_cluster) AS cluster_b, count(*) AS policies FROM policy
WHERE retirement_time IS NULL AND status IN ('RUNNING', 'SUBMITTED', 'SUSPENDED') GROUP BY ALL""")
def active_pair_policies(d):
    return store.active_pair_policies(d.policy)


@query("active_credential_policies", "policy property credential", """
SELECT c.id AS credential_id, count(*) AS policies FROM policy p JOIN property r ON r.owner_id = p.id JOIN credential c ON c.id = r.value
WHERE p.retirement_time IS NULL AND p.status IN ('RUNNING', 'SUBMITTED', 'SUSPENDED') GROUP BY c.id""")
def active_credential_policies(d):
    return store.active_credential_policies(d.policy, d.property, d.credential)


@query("same_source_target", "policy", """
SELECT a.id AS wanted_id, count(*) AS policies FROM policy a JOIN policy b ON a.source_dataset = b.source_dataset AND a.source_cluster = b.source_cluster AND a.target_cluster = b.target_cluster AND a.type = b.type
WHERE b.retirement_time IS NULL AND a.retirement_time IS NOT NULL GROUP BY a.id""")
def same_source_target(d):
    return store.same_source_target(d.policy, d.policy.where("retirement_time is not null").withColumnRenamed("id", "wanted_id"))


@query("policies_for_type", "policy", """
SELECT id, status FROM policy WHERE type = 'HIVE' AND retirement_time IS NULL AND status NOT IN ('SUCCEEDED', 'FAILED', 'SUCCEEDEDWITHSKIPPED', 'FAILEDWITHSKIPPED')""")
def policies_for_type(d):
    return store.policies_for_type(d.policy, "HIVE").select("id", "status")


@query("archived_policies", "policy_version", """
SELECT name, version FROM policy_version WHERE name = 'Customer#000000002' AND retirement_time IS NOT NULL""")
def archived_policies(d):
    rows = d.policy_version.withColumn("id", F.col("version").cast("string"))
    return store.archived_policies(rows, "Customer#000000002", "version").select("name", "version")


@query("rerunnable", "policy_instance", """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY start_time DESC, id) AS rn FROM policy_instance WHERE status <> 'SKIPPED')
SELECT policy_id, id, current_offset, status FROM ranked WHERE rn = 1 AND status IN ('FAILED', 'KILLED', 'FAILED_ADMIN')""")
def rerunnable(d):
    return history.rerunnable(d.policy_instance)


@query("interrupted_instances", "policy_instance", "SELECT id, policy_id, current_offset FROM policy_instance WHERE status = 'RUNNING' AND retirement_time IS NULL")
def interrupted(d):
    return history.interrupted(d.policy_instance)


@query("policy_view", "policy policy_instance property", """
WITH runs AS (SELECT policy_id, string_agg(id, ',' ORDER BY rn) AS runs FROM (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY start_time DESC, id) AS rn FROM policy_instance) WHERE rn <= 3 GROUP BY policy_id),
report AS (SELECT policy_id, max(CASE WHEN status = 'SUCCESS' THEN end_time END) AS last_succeeded, max(CASE WHEN status IN ('FAILED', 'KILLED') THEN end_time END) AS last_failed
 FROM policy_instance WHERE status <> 'RUNNING' GROUP BY policy_id),
props AS (SELECT owner_id, string_agg(property || '=' || value, ',' ORDER BY property) AS props FROM property GROUP BY owner_id)
SELECT p.id, p.name, p.status, p.source_cluster, p.target_cluster, replace(p.tags, ', ', '|') AS tags, r.runs, t.last_succeeded, t.last_failed, s.props
FROM policy p LEFT JOIN runs r ON r.policy_id = p.id LEFT JOIN report t ON t.policy_id = p.id LEFT JOIN props s ON s.owner_id = p.id""")
def policy_view(d):
    seen = store.policy_view(d.policy, ["status", "clusters", "tags", "instances", "report", "customProperties"],
                             d.policy_instance, d.property)
    entries = F.transform(F.sort_array(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return seen.select("id", "name", "status", "source_cluster", "target_cluster", F.array_join("tags", "|").alias("tags"),
                       F.array_join(F.transform("runs", lambda r: r["id"]), ",").alias("runs"), "last_succeeded", "last_failed",
                       F.array_join(entries, ",").alias("props"))


@query("active_entities", "policy_version", "SELECT name, version, status FROM policy_version WHERE retirement_time IS NULL AND name LIKE '%5'")
def active_entities(d):
    rows = d.policy_version
    return store.active_entities(rows, ["name"], rows.where("name like '%5'")).select("name", "version", "status")


@query("duplicate_active", "policy", """
SELECT source_dataset, count(*) AS active_rows FROM policy WHERE retirement_time IS NULL GROUP BY source_dataset HAVING count(*) > 1""")
def duplicate_active(d):
    return store.duplicate_active(d.policy, ["source_dataset"])


@query("policies_to_schedule", "policy policy_instance", """
SELECT id, name FROM policy p WHERE retirement_time IS NULL AND status = 'SUBMITTED' AND target_cluster = 'cl2' AND NOT EXISTS (SELECT 1 FROM policy_instance i WHERE i.policy_id = p.id AND i.status = 'KILLED')""")
def policies_to_schedule(d):
    scheduled = d.policy_instance.where("status = 'KILLED'").select(F.col("policy_id").alias("id"))
    return store.policies_to_schedule(d.policy, scheduled, "cl2").select("id", "name")


SUBMITTED = """
WITH submitted AS (SELECT 'n' || id AS id, CASE WHEN CAST(id AS INT) % 11 <> 0 THEN 'new' || id END AS name, type,
 CASE WHEN CAST(id AS INT) % 5 <> 1 THEN source_cluster END AS source_cluster, CASE WHEN CAST(id AS INT) % 7 <> 1 THEN target_cluster END AS target_cluster,
 CASE WHEN CAST(id AS INT) % 9 = 0 THEN 's3://bucket' || source_dataset ELSE source_dataset END AS source_dataset,
 CASE WHEN type = 'HIVE' THEN CASE WHEN CAST(id AS INT) % 2 = 0 THEN 'db_' || id ELSE 'db-' || id END WHEN CAST(id AS INT) % 8 = 0 THEN 's3://copy' || target_dataset
  WHEN CAST(id AS INT) % 3 = 1 THEN '/new' || target_dataset ELSE target_dataset || '/sub' END AS target_dataset,
 frequency - 60 AS frequency, TIMESTAMP '2001-09-01 00:00:00' + INTERVAL 1 DAY * CAST(CAST(id AS INT) % 6 - 2 AS INT) AS start_time,
 CASE WHEN CAST(id AS INT) % 4 > 0 THEN TIMESTAMP '2001-09-01 00:00:00' + INTERVAL 1 DAY * CAST(CAST(id AS INT) % 4 - 2 AS INT) END AS end_time,
 CASE WHEN CAST(id AS INT) % 10 < 2 THEN 'cred1' END AS cloud_credential FROM policy)
"""


def submitted(d):
    n = F.col("id").cast("int")

    def days(number):
        return moment(NOW) + F.make_dt_interval(number.cast("int"))

    return d.policy.select(
        F.concat(F.lit("n"), "id").alias("id"), F.when(n % 11 != 0, F.concat(F.lit("new"), "id")).alias("name"), "type",
        F.when(n % 5 != 1, F.col("source_cluster")).alias("source_cluster"),
        F.when(n % 7 != 1, F.col("target_cluster")).alias("target_cluster"),
        F.when(n % 9 == 0, F.concat(F.lit("s3://bucket"), "source_dataset")).otherwise(F.col("source_dataset")).alias("source_dataset"),
        F.when(F.col("type") == "HIVE", F.when(n % 2 == 0, F.concat(F.lit("db_"), "id")).otherwise(F.concat(F.lit("db-"), "id")))
        .when(n % 8 == 0, F.concat(F.lit("s3://copy"), "target_dataset"))
        .when(n % 3 == 1, F.concat(F.lit("/new"), "target_dataset"))
        .otherwise(F.concat("target_dataset", F.lit("/sub"))).alias("target_dataset"),
        (F.col("frequency") - 60).alias("frequency"), days(n % 6 - 2).alias("start_time"),
        F.when(n % 4 > 0, days(n % 4 - 2)).alias("end_time"),
        F.when(n % 10 < 2, F.lit("cred1")).alias("cloud_credential"))


@query("validate_policies", "policy zones", SUBMITTED + """
, held AS (SELECT * FROM policy WHERE retirement_time IS NULL AND status NOT IN ('SUCCEEDED', 'FAILED'))
, zoned AS (SELECT s.id, starts_with(source_dataset, 's3:') AS cs, starts_with(target_dataset, 's3:') AS ct,
  EXISTS (SELECT 1 FROM zones z WHERE starts_with(s.source_dataset || '/', z.path)) AS sk, EXISTS (SELECT 1 FROM zones z WHERE starts_with(s.target_dataset || '/', z.path)) AS tk FROM submitted s)
SELECT id, 'missing_name' AS rule FROM submitted WHERE name IS NULL
UNION ALL SELECT id, 'missing_credential' FROM submitted WHERE (starts_with(source_dataset, 's3:') OR starts_with(target_dataset, 's3:')) AND cloud_credential IS NULL
UNION ALL SELECT id, 'cloud_to_cloud' FROM submitted WHERE starts_with(source_dataset, 's3:') AND starts_with(target_dataset, 's3:')
UNION ALL SELECT id, 'one_cluster_with_cloud' FROM submitted WHERE type = 'FS' AND cloud_credential IS NOT NULL AND (source_cluster IS NULL) = (target_cluster IS NULL)
UNION ALL SELECT id, 'missing_source_cluster' FROM submitted WHERE type = 'FS' AND cloud_credential IS NULL AND source_cluster IS NULL
UNION ALL SELECT id, 'missing_target_cluster' FROM submitted WHERE type = 'FS' AND cloud_credential IS NULL AND target_cluster IS NULL
UNION ALL SELECT id, 'frequency_too_low' FROM submitted WHERE frequency < 60
UNION ALL SELECT id, 'end_before_start' FROM submitted WHERE end_time < start_time
UNION ALL SELECT id, 'start_in_past' FROM submitted WHERE start_time < TIMESTAMP '2001-08-31 23:59:00'
UNION ALL SELECT id, 'end_in_past' FROM submitted WHERE end_time < TIMESTAMP '2001-09-01 00:00:00'
UNION ALL SELECT id, 'bad_target_name' FROM submitted WHERE type = 'HIVE' AND contains(target_dataset, '-')
UNION ALL SELECT id, 'target_in_replication' FROM submitted s WHERE type = 'FS' AND NOT starts_with(target_dataset, 's3:') AND EXISTS (SELECT 1 FROM held h WHERE h.type = 'FS'
  AND (starts_with(s.target_dataset || '/', h.target_dataset || '/') OR starts_with(h.target_dataset || '/', s.target_dataset || '/')))
UNION ALL SELECT id, 'source_on_same_target' FROM submitted s WHERE EXISTS (SELECT 1 FROM policy p WHERE p.retirement_time IS NULL AND p.type = s.type AND p.source_dataset = s.source_dataset
  AND p.source_cluster = s.source_cluster AND p.target_cluster = s.target_cluster)
UNION ALL SELECT id, 'target_not_encrypted' FROM zoned WHERE NOT cs AND sk AND (ct OR NOT tk)""")
def validate_policies(d):
    return store.validate_policies(submitted(d), d.policy, NOW, d.zones)


@query("encryption_compat", "policy zones", """
WITH p AS (SELECT id, source_dataset, CASE WHEN CAST(id AS INT) % 3 = 0 THEN source_dataset || '/copy' WHEN CAST(id AS INT) % 4 = 1 THEN 's3://b' || target_dataset ELSE target_dataset END AS target_dataset,
 CASE WHEN CAST(id AS INT) % 2 = 0 THEN 'AWS_SSEKMS' END AS cloud_encryption, CAST(id AS INT) % 10 = 3 AS enable_snapshot,
 CASE WHEN contains(source_dataset, 'machinery') THEN '/plain' ELSE '' END || source_dataset AS src FROM policy),
z AS (SELECT id, starts_with(target_dataset, 's3:') AS ct, cloud_encryption, enable_snapshot, (SELECT min_by(key_name, length(path)) FROM zones WHERE starts_with(src || '/', path)) AS source_key,
 (SELECT min_by(key_name, length(path)) FROM zones WHERE starts_with(target_dataset || '/', path)) AS target_key FROM p),
t AS (SELECT *, source_key IS NOT NULL AS s_on, CASE WHEN ct THEN cloud_encryption IS NOT NULL ELSE target_key IS NOT NULL END AS t_on FROM z)
SELECT id, source_key, target_key, s_on OR t_on AS encrypt, CASE WHEN s_on AND enable_snapshot THEN 'encrypted_source_snapshottable' WHEN s_on AND NOT t_on THEN 'target_not_encrypted' END AS problem FROM t""")
def encryption_compat(d):
    n = F.col("id").cast("int")
    rows = d.policy.select(
        "id",
        F.concat(F.when(F.col("source_dataset").contains("machinery"), "/plain").otherwise(""), "source_dataset").alias("source_dataset"),
        F.when(n % 3 == 0, F.concat("source_dataset", F.lit("/copy"))).when(n % 4 == 1, F.concat(F.lit("s3://b"), "target_dataset"))
        .otherwise(F.col("target_dataset")).alias("target_dataset"),
        F.when(n % 2 == 0, "AWS_SSEKMS").alias("cloud_encryption"), (n % 10 == 3).alias("enable_snapshot"))
    return store.encryption_compat(rows, d.zones)


@query("cluster_rules", "policy cluster cluster_pair", """
WITH c AS (SELECT name, arg_max(local, version) AS local, arg_max(hdfs, version) AS hdfs FROM cluster WHERE retirement_time IS NULL GROUP BY name),
pr AS (SELECT cluster AS a, paired_cluster AS b FROM cluster_pair WHERE status = 'PAIRED' UNION SELECT paired_cluster, cluster FROM cluster_pair WHERE status = 'PAIRED'),
n AS (SELECT id, type, CASE WHEN CAST(id AS INT) % 11 = 0 THEN 'nowhere' WHEN CAST(id AS INT) % 11 = 1 THEN NULL ELSE source_cluster END AS s, CASE WHEN CAST(id AS INT) % 13 = 0 THEN 'nowhere' ELSE target_cluster END AS t FROM policy),
j AS (SELECT n.*, x.name IS NOT NULL AS sk, y.name IS NOT NULL AS tk, x.local AS sl, y.local AS tl, x.hdfs AS sh, y.hdfs AS th, EXISTS (SELECT 1 FROM pr WHERE a = s AND b = t) AS paired
 FROM n LEFT JOIN c x ON x.name = s LEFT JOIN c y ON y.name = t)
SELECT id, 'unknown_source_cluster' AS rule FROM j WHERE s IS NOT NULL AND NOT sk UNION ALL SELECT id, 'unknown_target_cluster' FROM j WHERE NOT tk
UNION ALL SELECT id, 'source_without_hdfs' FROM j WHERE type = 'FS' AND NOT sh UNION ALL SELECT id, 'target_without_hdfs' FROM j WHERE type = 'FS' AND NOT th
UNION ALL SELECT id, 'clusters_not_paired' FROM j WHERE sk AND tk AND s <> t AND NOT paired
UNION ALL SELECT id, 'no_local_cluster' FROM j WHERE NOT coalesce(sl, false) AND NOT coalesce(tl, false)""")
def cluster_rules(d):
    n = F.col("id").cast("int")
    source = F.when(n % 11 == 0, "nowhere").when(n % 11 != 1, F.col("source_cluster"))
    target = F.when(n % 13 == 0, "nowhere").otherwise(F.col("target_cluster"))
    new = d.policy.select("id", "type", source.alias("source_cluster"), target.alias("target_cluster"))
    return store.cluster_rules(new, d.cluster, d.cluster_pair)


@query("encryption_of_clusters", "policy zones", """
WITH z AS (SELECT path, cluster, key_name || '-' || cluster AS key_name FROM zones, (VALUES ('cl0'), ('cl2'), ('cl3')) AS c(cluster)),
p AS (SELECT id, source_dataset, CASE WHEN CAST(id AS INT) % 3 = 0 THEN source_dataset || '/copy' WHEN CAST(id AS INT) % 4 = 1 THEN 's3://b' || source_dataset ELSE target_dataset END AS target_dataset, source_cluster, target_cluster FROM policy),
k AS (SELECT id, starts_with(target_dataset, 's3:') AS cloud, (SELECT min_by(key_name, length(path)) FROM z WHERE cluster = source_cluster AND starts_with(source_dataset || '/', path)) AS source_key,
 (SELECT min_by(key_name, length(path)) FROM z WHERE cluster = target_cluster AND starts_with(target_dataset || '/', path)) AS target_key FROM p)
SELECT id, source_key, target_key, source_key IS NOT NULL OR (NOT cloud AND target_key IS NOT NULL) AS encrypt,
 CASE WHEN source_key IS NOT NULL AND (cloud OR target_key IS NULL) THEN 'target_not_encrypted' END AS problem FROM k""")
def encryption_of_clusters(d):
    """Zones of one path on three of five clusters, each with a key of its own."""
    zones = d.zones.withColumn("cluster", F.explode(F.array(F.lit("cl0"), F.lit("cl2"), F.lit("cl3"))))
    zones = zones.withColumn("key_name", F.concat("key_name", F.lit("-"), "cluster"))
    n = F.col("id").cast("int")
    target = (F.when(n % 3 == 0, F.concat("source_dataset", F.lit("/copy")))
              .when(n % 4 == 1, F.concat(F.lit("s3://b"), "source_dataset")).otherwise(F.col("target_dataset")))
    rows = d.policy.select("id", "source_dataset", target.alias("target_dataset"), "source_cluster", "target_cluster")
    return store.encryption_compat(rows, zones)


@query("dataset_in_use", "policy", """
WITH asked AS (SELECT source_dataset AS dataset, min(name) AS except_name FROM policy GROUP BY source_dataset),
fs AS (SELECT id, name, source_dataset AS dataset FROM policy WHERE type = 'FS' AND retirement_time IS NULL AND status NOT IN ('SUCCEEDED', 'FAILED')
 UNION SELECT id, name, target_dataset FROM policy WHERE type = 'FS' AND retirement_time IS NULL AND status NOT IN ('SUCCEEDED', 'FAILED'))
SELECT f.dataset, a.except_name, count(*) AS policies FROM fs f JOIN asked a ON a.dataset = f.dataset AND f.name <> a.except_name GROUP BY ALL""")
def dataset_in_use(d):
    asked = d.policy.groupBy(F.col("source_dataset").alias("dataset")).agg(F.min("name").alias("except_name"))
    return store.dataset_in_use(d.policy, asked)


# ---- clusters


@query("pairs_of", "cluster_pair", """
SELECT cluster AS name, version, paired_cluster AS peer, paired_version AS peer_version, status FROM cluster_pair
UNION SELECT paired_cluster, paired_version, cluster, version, status FROM cluster_pair""")
def pairs_of(d):
    return clusters.pairs_of(d.cluster_pair)


@query("pair_status", "cluster_pair policy", """
WITH wanted AS (SELECT DISTINCT source_cluster AS name, target_cluster AS peer FROM policy),
known AS (SELECT cluster AS name, paired_cluster AS peer, status FROM cluster_pair UNION SELECT paired_cluster, cluster, status FROM cluster_pair)
SELECT w.name, w.peer, k.status, CASE WHEN k.status IS NULL THEN 'not_paired' END AS problem FROM wanted w LEFT JOIN known k ON k.name = w.name AND k.peer = w.peer""")
def pair_status(d):
    wanted = d.policy.select(F.col("source_cluster").alias("name"), F.col("target_cluster").alias("peer"))
    return clusters.pair_status(d.cluster_pair, wanted)


@query("fold_properties", "policy property", """
SELECT p.id, s.props FROM policy p LEFT JOIN (SELECT owner_id, string_agg(property || '=' || value, ',' ORDER BY property) AS props FROM property GROUP BY owner_id) s ON s.owner_id = p.id""")
def fold_properties(d):
    folded = clusters.fold_properties(d.policy.select("id"), d.property.withColumnRenamed("owner_id", "id"), ["id"])
    entries = F.transform(F.sort_array(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return folded.select("id", F.array_join(entries, ",").alias("props"))


PROP_DIFF = """
SELECT coalesce(o.owner_id, n.owner_id) AS owner_id, coalesce(o.property, n.property) AS property,
 CASE WHEN o.owner_id IS NOT NULL AND n.owner_id IS NOT NULL THEN 'update' WHEN n.owner_id IS NOT NULL THEN 'insert' ELSE 'ABSENT' END AS action,
 o.value AS old_value, n.value, n.owner_id IS NOT NULL AND o.value IS DISTINCT FROM n.value AS changed
FROM property o FULL JOIN property_edit n ON o.owner_id = n.owner_id AND o.property = n.property"""


@query("diff_properties", "property property_edit", PROP_DIFF.replace("ABSENT", "delete"))
def diff_properties(d):
    return clusters.diff_properties(d.property, d.property_edit, ["owner_id", "property"], True)


@query("diff_properties_policy", "property property_edit", PROP_DIFF.replace("ABSENT", "keep"))
def diff_properties_policy(d):
    return clusters.diff_properties(d.property, d.property_edit, ["owner_id", "property"], False)


@query("validate_pairs", "cluster cluster_pair", """
WITH j AS (SELECT p.cluster, p.version, p.paired_cluster, p.paired_version, a.hdfs AS h1, b.hdfs AS h2, a.hdfs AND a.ha AS x1, b.hdfs AND b.ha AS x2, a.hive AS v1, b.hive AS v2,
 a.acl_service AS r1, b.acl_service AS r2, a.kerberos AS k1, b.kerberos AS k2, a.nameservice AS n1, b.nameservice AS n2 FROM cluster_pair p JOIN cluster a ON a.name = p.cluster AND a.version = p.version
 JOIN cluster b ON b.name = p.paired_cluster AND b.version = p.paired_version)
SELECT cluster, version, paired_cluster, paired_version, rule, severity FROM (
 SELECT *, 'hdfs' AS rule, 'warn' AS severity FROM j WHERE h1 <> h2 UNION ALL SELECT *, 'ha', 'warn' FROM j WHERE x1 <> x2 UNION ALL SELECT *, 'hive', 'warn' FROM j WHERE v1 <> v2
 UNION ALL SELECT *, 'acl_service', 'warn' FROM j WHERE r1 <> r2 UNION ALL SELECT *, 'kerberos', 'error' FROM j WHERE k1 <> k2
 UNION ALL SELECT *, 'same_nameservice', 'error' FROM j WHERE x1 AND x2 AND n1 = n2)""")
def validate_pairs(d):
    return clusters.validate_pairs(d.cluster_pair, d.cluster)


# ---- history


@query("status_recent", "policy_instance", """
WITH latest AS (SELECT policy_id, status, max(start_time) AS start_time FROM policy_instance GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY policy_id ORDER BY start_time DESC, status) AS INT) AS rank FROM latest) SELECT * FROM ranked WHERE rank <= 2""")
def status_recent(d):
    return history.status_recent(d.policy_instance)


@query("policy_report", "policy_instance", """
SELECT policy_id, max(CASE WHEN status = 'SUCCESS' THEN end_time END) AS last_succeeded, max(CASE WHEN status IN ('FAILED', 'KILLED') THEN end_time END) AS last_failed,
 arg_max(status, (end_time, status = 'FAILED')) FILTER (status IN ('FAILED', 'KILLED')) AS last_failed_status FROM policy_instance WHERE status <> 'RUNNING' GROUP BY policy_id""")
def policy_report(d):
    return history.policy_report(d.policy_instance)


@query("final_status", "policy_instance", """
WITH latest AS (SELECT policy_id, status, max(start_time) AS start_time FROM policy_instance GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY start_time DESC, status) AS rn FROM latest),
two AS (SELECT policy_id, max(CASE WHEN rn = 1 THEN status END) AS a, max(CASE WHEN rn = 2 THEN status END) AS b FROM ranked GROUP BY policy_id)
SELECT policy_id, CASE WHEN a = 'SUCCESS' THEN 'SUCCEEDED' WHEN a = 'FAILED_ADMIN' OR (a = 'SKIPPED' AND b = 'FAILED_ADMIN') THEN 'SUSPENDEDFORINTERVENTION'
 WHEN a IN ('FAILED', 'KILLED') THEN 'FAILED' WHEN a = 'SKIPPED' AND b = 'SUCCESS' THEN 'SUCCEEDEDWITHSKIPPED' WHEN a = 'SKIPPED' AND b IN ('FAILED', 'KILLED') THEN 'FAILEDWITHSKIPPED'
 ELSE 'FAILED' END AS final_status FROM two""")
def final_status(d):
    return history.final_status(d.policy_instance)


@query("recent_runs", "policy_instance", """
WITH ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY policy_id ORDER BY start_time DESC, id) AS INT) AS rank FROM policy_instance)
SELECT policy_id, rank, id, status, start_time FROM ranked WHERE rank <= 3""")
def recent_runs(d):
    return history.recent_run_rows(d.policy_instance).select("policy_id", "rank", "id", "status", "start_time")


@query("last_failed", "policy_instance", """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY policy_id ORDER BY end_time DESC, id) AS rn FROM policy_instance WHERE status = 'FAILED')
SELECT policy_id, id, end_time FROM ranked WHERE rn = 1""")
def last_failed(d):
    return history.last_failed(d.policy_instance).select("policy_id", "id", "end_time")


@query("last_finished", "policy_instance", "SELECT policy_id, arg_max(status, (end_time, id)) AS last_status FROM policy_instance WHERE end_time IS NOT NULL GROUP BY policy_id")
def last_finished(d):
    return history.last_finished(d.policy_instance)


@query("latest_per_key", "policy_version", """
SELECT name, max(version) AS version, arg_max(status, version) AS status FROM policy_version GROUP BY name""")
def latest_per_key(d):
    return store.newest_version(d.policy_version, ["name"]).select("name", "version", "status")


@query("next_step", "job_step", "SELECT order_key, CAST(count(*) AS BIGINT) AS next_offset FROM job_step GROUP BY order_key")
def next_step(d):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    steps = ordering.numbered(d.job_step, ["order_key"], order, "nth").withColumn("job_offset", F.col("nth") - 1)
    return history.next_step(steps)


@query("page", "", "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 10")
def page(d):
    return ordering.page(d.table("supplier").select("s_suppkey", "s_name", "s_acctbal"), "s_acctbal", "desc", -4, 0, ["s_suppkey"])


@query("page_by_cursor", "", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC NULLS LAST, c_custkey LIMIT 25 OFFSET 50")
def page_by_cursor(d):
    """The third page of 25, each found by the cursor of the one before."""
    rows, at = d.table("customer").select("c_custkey", "c_nationkey", "c_acctbal"), None
    for _ in range(2):
        at = ordering.cursor(ordering.page_after(rows, "c_nationkey", at, "desc", 25, ["c_custkey"]), "c_nationkey", ["c_custkey"], "desc")
    return ordering.page_after(rows, "c_nationkey", at, "desc", 25, ["c_custkey"])
