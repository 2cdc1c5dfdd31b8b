"""Column expressions, checked on whole tables."""

from datetime import datetime

from pyspark.sql import functions as F

from driftline.catalog.registry import query
from driftline.functions import ids, paths, texts, times


@query("path_parts", "source_manifest", """
SELECT rel_path, regexp_extract(rel_path, '^(.*)/', 1) AS parent, regexp_extract(rel_path, '([^/]*)$', 1) AS name, 3 AS depth,
 '/|/' || split_part(rel_path, '/', 2) || '|/' || split_part(rel_path, '/', 2) || '/' || split_part(rel_path, '/', 3) || '|' || rel_path AS prefixes,
 rel_path || '/' AS slashed, starts_with(rel_path, '/src1/') AS inside FROM source_manifest""")
def path_parts(d):
    path = F.col("rel_path")
    return d.source_manifest.select(
        "rel_path", paths.parent(path).alias("parent"), paths.name(path).alias("name"), paths.depth(path).alias("depth"),
        F.array_join(paths.prefixes(path), "|").alias("prefixes"), paths.add_slash(path).alias("slashed"),
        paths.is_proper_ancestor(F.lit("/src1"), path).alias("inside"))


@query("page_urls", "", """
SELECT page_id, regexp_extract(url, '^([a-z]+):', 1) NOT IN ('file', 'hdfs') AS cloud, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages""")
def page_urls(d):
    url = F.col("url")
    return d.table("pages").select("page_id", paths.is_cloud(url).alias("cloud"), paths.uri_path(url).alias("path"))


@query("execution_type", "policy", """
WITH p AS (SELECT id, CAST(id AS INT) % 3 = 0 AS cloud, CAST(id AS INT) % 5 = 0 AS enc, CAST(id AS INT) % 2 = 0 AS snap, source_dataset FROM policy)
SELECT id, CASE WHEN cloud AND snap AND NOT enc THEN 'FS_HCFS_SNAPSHOT' WHEN snap AND NOT enc THEN 'FS_SNAPSHOT' WHEN cloud THEN 'FS_HCFS' ELSE 'FS' END AS execution_type,
 'hdfs://nn:8020' || source_dataset AS uri FROM p""")
def execution_type(d):
    n = F.col("id").cast("int")
    target = F.when(n % 3 == 0, F.concat(F.lit("s3a://b"), "target_dataset")).otherwise(F.concat(F.lit("hdfs://nn"), "target_dataset"))
    return d.policy.select("id", paths.execution_type(F.col("source_dataset"), target, n % 5 == 0, n % 2 == 0).alias("execution_type"),
                           paths.full_uri(F.lit("hdfs://nn:8020/"), F.col("source_dataset")).alias("uri"))


@query("policy_ids", "policy", """
WITH p AS (SELECT id, name, CASE WHEN CAST(id AS INT) % 2 = 0 THEN 'dc1/' || source_cluster ELSE source_cluster || '/' || source_cluster END AS s,
 CASE WHEN CAST(id AS INT) % 7 > 0 THEN '/' || target_cluster || '/' || target_cluster ELSE '' END AS t FROM policy)
SELECT id, '/' || s || t || '/' || name || '/1/1700000000/' || lpad(id, 9, '0') AS packed, split_part(s, '/', 1) AS center, split_part(s, '/', 2) AS cluster FROM p""")
def policy_ids(d):
    n = F.col("id").cast("int")
    packed = ids.policy_id(
        F.when(n % 2 == 0, F.concat(F.lit("dc1$"), "source_cluster")).otherwise(F.col("source_cluster")),
        F.when(n % 7 > 0, F.col("target_cluster")), F.col("name"), F.lit(1), F.lit(1700000000), n)
    return d.policy.select("id", packed.alias("packed"), ids.policy_id_field(packed, "source_data_center").alias("center"),
                           ids.policy_id_field(packed, "source_cluster").alias("cluster"))


@query("run_ids", "policy_instance", "SELECT policy_id || '@' || CAST(order_key AS VARCHAR) AS run, policy_id AS policy, CAST(order_key AS INT) AS number FROM policy_instance")
def run_ids(d):
    run = ids.run_id(F.col("policy_id"), F.col("order_key"))
    return d.policy_instance.select(run.alias("run"), ids.run_policy(run).alias("policy"), ids.run_number(run).alias("number"))


@query("byte_text", "", """
WITH b AS (SELECT l_orderkey * 7919 * (1 + l_linenumber) * l_linenumber AS size FROM lineitem)
SELECT size, CASE WHEN size < 1024 THEN printf('%.1fB', CAST(size AS DOUBLE)) WHEN size < 1048576 THEN printf('%.1fK', size / 1024.0::DOUBLE) WHEN size < 1073741824 THEN printf('%.1fM', size / 1048576.0::DOUBLE)
 WHEN size < 1099511627776 THEN printf('%.1fG', size / 1073741824.0::DOUBLE) ELSE printf('%.1fT', size / 1099511627776.0::DOUBLE) END AS text FROM b""")
def byte_text(d):
    line = F.col("l_linenumber")
    size = F.col("l_orderkey") * 7919 * (1 + line) * line
    return d.table("lineitem").select(size.alias("size"), texts.byte_text(size).alias("text"))


@query("age_expressions", "", """
SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN s_suppkey * 60000 WHEN 1 THEN s_suppkey * 3600000 WHEN 2 THEN s_suppkey * 86400000 WHEN 3 THEN s_suppkey * 31 * 86400000 WHEN 4 THEN s_suppkey * 366 * 86400000 END AS ms FROM supplier""")
def age_expressions(d):
    word = F.get(F.array(*map(F.lit, ["minutes", "hours", "days", "months", "years", "weeks"])), (F.col("s_suppkey") % 6).cast("int"))
    text = F.concat(word, F.lit("("), F.col("s_suppkey").cast("string"), F.lit(")"))
    return d.table("supplier").select("s_suppkey", times.age_ms(text).alias("ms"))


@query("date_anchors", "", """
SELECT event_id, date_trunc('day', ts) + INTERVAL 90 MINUTE AS today, date_trunc('day', ts) - INTERVAL 1 DAY + INTERVAL 2 HOUR AS yesterday, date_trunc('month', ts) + INTERVAL 3 DAY AS month,
 date_trunc('month', ts) - INTERVAL 1 MONTH AS last_month, date_trunc('day', ts) - INTERVAL 1 DAY * CAST((dayofweek(ts) - 3 + 7) % 7 AS INT) AS week,
 date_trunc('day', ts) - INTERVAL 1 DAY * CAST((dayofweek(ts) + 7) % 7 + 7 AS INT) + INTERVAL 5 MINUTE AS last_week, date_trunc('year', ts) + INTERVAL 2 MONTH + INTERVAL 4 DAY AS year,
 date_trunc('year', ts) - INTERVAL 1 YEAR AS last_year, ts + INTERVAL 61 MINUTE AS now FROM events""")
def date_anchors(d):
    ts = F.col("ts")
    return d.table("events").select(
        "event_id", times.today(ts, 1, 30).alias("today"), times.yesterday(ts, 2).alias("yesterday"),
        times.current_month(ts, 3).alias("month"), times.last_month(ts).alias("last_month"), times.current_week(ts, "WED").alias("week"),
        times.last_week(ts, "SUN", 0, 5).alias("last_week"), times.current_year(ts, 2, 4).alias("year"),
        times.last_year(ts).alias("last_year"), times.now_at(ts, 1, 1).alias("now"))


@query("iso_times", "", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS text, date_trunc('second', ts) AS parsed FROM events")
def iso_times(d):
    text = times.format_iso(F.col("ts"))
    return d.table("events").select("event_id", text.alias("text"), times.parse_iso(text).alias("parsed"))


@query("preserve_letters", "", """
SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 2 = 0 THEN 'REPLICATION' END, CASE WHEN p_partkey % 3 = 0 THEN 'USER' END, CASE WHEN p_partkey % 5 = 0 THEN 'GROUP' END, 'TIMES') AS attributes,
 CASE WHEN p_partkey % 2 = 0 THEN 'r' ELSE '' END || CASE WHEN p_partkey % 3 = 0 THEN 'u' ELSE '' END || CASE WHEN p_partkey % 5 = 0 THEN 'g' ELSE '' END || 't' AS letters FROM part""")
def preserve_letters(d):
    n = F.col("p_partkey")
    text = F.concat(F.lit("T"), F.when(n % 3 == 0, "u").otherwise(""), F.when(n % 2 == 0, "R").otherwise(""),
                    F.when(n % 5 == 0, "g").otherwise(""))
    found = texts.attributes_of(text)
    return d.table("part").select("p_partkey", F.array_join(found, ",").alias("attributes"), texts.letters_of(found).alias("letters"))


@query("entity_names", "", "SELECT c_custkey, lower(c_name) || '@' || 'cl-' || c_mktsegment AS qualified, 'my_cl_' || c_mktsegment || '_replicated' AS tag FROM customer")
def entity_names(d):
    cluster = F.concat(F.lit("cl-"), "c_mktsegment")
    return d.table("customer").select("c_custkey", paths.database_at_cluster(F.col("c_name"), cluster).alias("qualified"),
                                      paths.tag_name(F.concat(F.lit("my "), cluster)).alias("tag"))


@query("progress_pairs", "", "SELECT l_orderkey, CASE WHEN l_linenumber > 1 THEN CAST(l_linenumber AS BIGINT) ELSE 0 END AS done, CASE WHEN l_linenumber > 1 THEN l_partkey ELSE 0 END AS total FROM lineitem")
def progress_pairs(d):
    line = F.col("l_linenumber")
    done, total = texts.progress_pair(F.when(line > 1, F.concat(line.cast("string"), F.lit("/"), F.col("l_partkey").cast("string"))))
    return d.table("lineitem").select("l_orderkey", done.alias("done"), total.alias("total"))


@query("run_times", "policy", """
WITH p AS (SELECT id, frequency, TIMESTAMP '2001-01-01 00:00:00' + INTERVAL 1 MINUTE * CAST(CAST(id AS INT) % 30 AS INT) AS s, CASE WHEN CAST(id AS INT) % 4 = 0 THEN TIMESTAMP '2001-01-01 00:20:00' ELSE TIMESTAMP '2001-01-01 00:45:00' END AS e FROM policy)
SELECT id, unnest(generate_series(s, e, INTERVAL 1 SECOND * frequency)) AS run_time FROM p WHERE s <= e""")
def run_times(d):
    n = F.col("id").cast("int")
    start = times.moment(datetime(2001, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), n % 30)
    end = F.when(n % 4 == 0, times.moment(datetime(2001, 1, 1, 0, 20)))
    horizon = times.moment(datetime(2001, 1, 1, 0, 45))
    return d.policy.select("id", F.explode(times.run_times(start, end, F.col("frequency"), horizon)).alias("run_time"))


@query("last_run", "policy_instance policy", """
SELECT i.id, coalesce(i.end_time < TIMESTAMP '1998-06-01 00:00:00' + INTERVAL 1 SECOND * (p.frequency * 1000), false) AS last_run FROM policy_instance i JOIN policy p ON p.id = i.policy_id""")
def last_run(d):
    runs = d.policy_instance.join(d.policy.select(F.col("id").alias("policy_id"), "frequency"), "policy_id")
    now = times.moment(datetime(1998, 6, 1))
    return runs.select("id", times.is_last_run(F.col("end_time"), now, F.col("frequency") * 1000).alias("last_run"))
