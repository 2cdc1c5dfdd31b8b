"""Replication tables as views over the test tables.

Each view is one SQL text that Spark and DuckDB read alike, so that an operator and its oracle start from the same rows.
Words in braces are base tables; ``<time>`` is the log time text, which the engines format differently.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

VIEWS = {
    "policy": """
SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, CAST(1 AS INT) AS version,
 CASE WHEN c_custkey % 3 = 0 THEN 'HIVE' ELSE 'FS' END AS type,
 CASE c_custkey % 5 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'SUBMITTED' WHEN 2 THEN 'SUSPENDED' WHEN 3 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
 'cl' || CAST(c_nationkey % 5 AS STRING) AS source_cluster, 'cl' || CAST((c_nationkey + 1) % 5 AS STRING) AS target_cluster,
 '/data/' || lower(c_mktsegment) || '/' || CAST(c_custkey % 40 AS STRING) AS source_dataset,
 '/dr/' || lower(c_mktsegment) || '/' || CAST(c_custkey AS STRING) AS target_dataset,
 CAST(60 * (1 + c_custkey % 10) AS INT) AS frequency, 'tag' || CAST(c_custkey % 4 AS STRING) || ', ' || c_mktsegment AS tags,
 CASE WHEN c_custkey % 14 = 0 THEN TIMESTAMP '1999-01-01 00:00:00' WHEN c_custkey % 7 = 0 THEN TIMESTAMP '2001-08-01 00:00:00' END AS retirement_time
FROM {customer}""",
    "policy_instance": """
SELECT CAST(o_custkey AS STRING) || '@' || CAST(o_orderkey AS STRING) AS id, CAST(o_custkey AS STRING) AS policy_id, o_orderkey AS order_key,
 CASE WHEN o_orderstatus = 'F' THEN 'SUCCESS' WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 3 = 0 THEN 'KILLED' WHEN o_orderkey % 7 = 0 THEN 'FAILED_ADMIN' ELSE 'FAILED' END
  ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'SKIPPED' ELSE 'RUNNING' END END AS status,
 o_orderdate AS start_time,
 CASE WHEN o_orderstatus = 'O' AND o_orderkey % 2 = 1 THEN NULL WHEN o_orderkey % 3 = 0 THEN o_orderdate + INTERVAL 3 DAY WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 2 HOUR ELSE o_orderdate + INTERVAL 30 MINUTE END AS end_time,
 CAST(o_orderkey % 4 AS INT) AS run_count, CAST(o_orderkey % 3 AS INT) AS current_offset,
 CASE WHEN o_custkey % 14 = 0 THEN TIMESTAMP '1999-01-01 00:00:00' WHEN o_custkey % 7 = 0 THEN TIMESTAMP '2001-08-01 00:00:00' END AS retirement_time
FROM {orders}""",
    "job_step": """
SELECT l_orderkey AS order_key, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax,
 CASE l_returnflag WHEN 'A' THEN 'SUCCESS' WHEN 'R' THEN 'FAILED' ELSE 'SUBMITTED' END AS status, l_shipdate AS start_time
FROM {lineitem}""",
    "event": """
SELECT event_id AS id, CAST(user_id AS STRING) AS policy_id, CASE WHEN event_type IN ('click', 'signup') THEN NULL ELSE CAST(user_id AS STRING) || '@' || CAST(event_id % 20 AS STRING) END AS instance_id,
 CASE WHEN event_type IN ('click', 'signup') THEN 'policy' ELSE 'policyinstance' END AS entity_type,
 CAST(CASE event_type WHEN 'click' THEN 2 WHEN 'signup' THEN 7 WHEN 'purchase' THEN 8 WHEN 'error' THEN 11 ELSE 12 END AS INT) AS event_code,
 CASE event_type WHEN 'error' THEN 'error' ELSE 'info' END AS severity, ts AS event_time, event_type || ' ' || CAST(event_id AS STRING) AS message,
 CASE WHEN event_id % 3 = 0 THEN '{{"syncEvent":true}}' ELSE '{{"syncEvent":false}}' END AS info
FROM {events}""",
    "source_manifest": """
SELECT '/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS rel_path, doc_id AS file_id, false AS is_dir,
 CAST(length(text) AS BIGINT) AS length, CAST(CASE WHEN doc_id % 19 = 0 THEN 256 ELSE 128 END AS INT) AS block_size, md5(text) AS checksum,
 'u' || CAST(doc_id % 3 AS STRING) AS owner, 'rw-r--r--' AS permission
FROM {documents}""",
    "target_manifest": """
SELECT '/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS rel_path, doc_id AS file_id, doc_id % 31 = 1 AS is_dir,
 CAST(CASE WHEN doc_id % 13 = 0 THEN length(text) - length(text) % 10 - 1 WHEN doc_id % 7 = 0 THEN length(text) + 1 ELSE length(text) END AS BIGINT) AS length, CAST(128 AS INT) AS block_size,
 CASE WHEN doc_id % 13 = 0 THEN md5(substring(text, 1, CAST(length(text) - length(text) % 10 - 1 AS INT))) WHEN doc_id % 9 = 0 THEN md5('x' || text) WHEN doc_id % 17 = 0 THEN NULL ELSE md5(text) END AS checksum,
 'u' || CAST(doc_id % 4 AS STRING) AS owner, 'rw-r--r--' AS permission FROM {documents} WHERE doc_id % 5 <> 0
UNION ALL SELECT '/stale/' || lang || '/' || CAST(doc_id AS STRING) || '.txt', doc_id + 1000000, false, CAST(length(text) AS BIGINT), CAST(128 AS INT), md5(text), 'u0', 'rw-r--r--' FROM {documents} WHERE doc_id % 11 = 0""",
    "append_candidate": """
SELECT '/' || source || '/' || lang || '/' || CAST(doc_id AS STRING) || '.txt' AS rel_path, text AS content,
 CAST(length(text) - length(text) % 10 - 1 AS BIGINT) AS target_length
FROM {documents} WHERE doc_id % 5 <> 0 AND doc_id % 13 = 0""",
    "snapshot_old": """
SELECT DISTINCT CAST(-1 - CAST(substring(source, 4) AS INT) AS BIGINT) AS file_id, CAST(-1000 AS BIGINT) AS parent_id, source AS name, '/' || source AS path, true AS is_dir, CAST(NULL AS STRING) AS checksum FROM {documents}
UNION ALL SELECT doc_id, CAST(-1 - CAST(substring(source, 4) AS INT) AS BIGINT), CAST(doc_id AS STRING) || '.txt', '/' || source || '/' || CAST(doc_id AS STRING) || '.txt', false, md5(text) FROM {documents}""",
    "snapshot_new": """
SELECT DISTINCT CAST(-1 - CAST(substring(source, 4) AS INT) AS BIGINT) AS file_id, CAST(-1000 AS BIGINT) AS parent_id, CASE WHEN source = 'src3' THEN 'src3_moved' ELSE source END AS name, CASE WHEN source = 'src3' THEN '/src3_moved' ELSE '/' || source END AS path, true AS is_dir, CAST(NULL AS STRING) AS checksum FROM {documents}
UNION ALL SELECT doc_id, CASE WHEN doc_id % 14 = 3 THEN CAST(-1 AS BIGINT) ELSE CAST(-1 - CAST(substring(source, 4) AS INT) AS BIGINT) END, CAST(doc_id AS STRING) || '.txt',
 CASE WHEN doc_id % 14 = 3 THEN '/src0/' WHEN source = 'src3' THEN '/src3_moved/' ELSE '/' || source || '/' END || CAST(doc_id AS STRING) || '.txt', false, CASE WHEN doc_id % 10 = 1 THEN md5('m' || text) ELSE md5(text) END FROM {documents} WHERE doc_id % 6 <> 0
UNION ALL SELECT doc_id + 1000000, CAST(-2 AS BIGINT), 'new' || CAST(doc_id AS STRING) || '.txt', '/src1/new' || CAST(doc_id AS STRING) || '.txt', false, md5(text) FROM {documents} WHERE doc_id % 15 = 2""",
    "zones": """
SELECT '/data/' || lower(c_mktsegment) || '/' AS path, 'key' || CAST(min(c_custkey) % 3 AS STRING) AS key_name FROM {customer} GROUP BY c_mktsegment""",
    "log_line": """
SELECT event_id AS line_no, 'server.log' AS file, <time> || ' ' || CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END || ' - [POLICYNAME[p' || CAST(user_id AS STRING) || '] POLICYID[' || CAST(user_id AS STRING) || ']] ~ ' || event_type AS line FROM {events} WHERE event_type <> 'view'
UNION ALL SELECT event_id, 'server.log', '  at frame ' || CAST(event_id AS STRING) FROM {events} WHERE event_type = 'view'""",
    "property": """
SELECT CAST(user_id AS STRING) AS owner_id, 'k' || CAST(event_id % 6 AS STRING) AS property, CAST(max(event_id % 50) AS STRING) AS value
FROM {events} GROUP BY user_id, event_id % 6""",
    "property_edit": """
SELECT CAST(user_id AS STRING) AS owner_id, 'k' || CAST(2 + event_id % 6 AS STRING) AS property, CAST(max(event_id % 45) AS STRING) AS value
FROM {events} WHERE user_id % 3 <> 1 GROUP BY user_id, event_id % 6""",
    "cluster": """
SELECT 'cl' || CAST(n_nationkey % 5 AS STRING) AS name, CAST(1 + (n_nationkey - n_nationkey % 5) / 5 AS INT) AS version, n_name AS description, n_nationkey = 20 AS local,
 n_nationkey % 2 = 0 AS hdfs, n_nationkey % 3 = 0 AS ha, n_nationkey % 4 <> 1 AS hive, n_nationkey % 5 <> 2 AS acl_service, n_nationkey % 7 < 4 AS kerberos,
 'ns' || CAST(n_nationkey % 4 AS STRING) AS nameservice,
 CASE WHEN n_nationkey < 20 THEN TIMESTAMP '1999-06-01 00:00:00' END AS retirement_time
FROM {nation}""",
    "cluster_pair": """
SELECT 'cl' || CAST(a.n_nationkey AS STRING) AS cluster, CAST(5 AS INT) AS version, 'cl' || CAST(b.n_nationkey AS STRING) AS paired_cluster, CAST(5 AS INT) AS paired_version,
 CASE WHEN (a.n_nationkey + b.n_nationkey) % 3 = 0 THEN 'SUSPENDED' ELSE 'PAIRED' END AS status
FROM {nation} a JOIN {nation} b ON b.n_nationkey = (a.n_nationkey * 2 + 1) % 5 AND a.n_nationkey < 5 AND a.n_nationkey <> b.n_nationkey""",
    "credential": """
SELECT CAST(s_suppkey AS STRING) AS id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'AWS' WHEN 1 THEN 'WASB' ELSE 'GCS' END AS provider,
 CASE WHEN s_suppkey % 2 = 0 THEN 'AWS_ACCESSKEY' ELSE 'AWS_INSTANCEPROFILE' END AS auth_type, TIMESTAMP '2000-01-01 00:00:00' + INTERVAL 1 DAY * CAST(s_suppkey % 30 AS INT) AS creation_time
FROM {supplier}""",
    "snapshot": """
SELECT '/data/' || CAST(o_custkey AS STRING) AS dataset, 'sync-p' || CAST(o_custkey % 2 AS STRING) || '-' || CAST(o_orderkey AS STRING) AS name, o_orderdate AS mtime, o_orderkey AS order_key FROM {orders}""",
    "change": """
SELECT event_id AS change_id, user_id AS key, CASE WHEN event_type = 'error' THEN 'DELETE' ELSE 'UPSERT' END AS op, event_type AS kind, value AS amount FROM {events}""",
    "transfer": """
SELECT CASE event_id % 2 WHEN 0 THEN 'metadata' ELSE 'access' END AS plugin, CASE WHEN event_type IN ('click', 'view') THEN 'export' ELSE 'import' END AS direction,
 CAST(event_id % 1000 AS BIGINT) AS bytes FROM {events}""",
}

# Views that are built from other views; words in braces are views.
LAYERED = {
    "policy_version": """
SELECT name, CAST(1 AS INT) AS version, 'SUCCEEDED' AS status, TIMESTAMP '1998-01-01 00:00:00' AS retirement_time FROM {policy}
UNION ALL SELECT name, CAST(2 AS INT), 'SUCCEEDED', TIMESTAMP '1998-01-01 00:00:00' FROM {policy} WHERE CAST(id AS INT) % 3 >= 1
UNION ALL SELECT name, CAST(3 AS INT), status, retirement_time FROM {policy} WHERE CAST(id AS INT) % 3 = 2""",
}

_TIME = {
    "spark": "date_format(ts, 'yyyy-MM-dd HH:mm:ss,SSS')",
    "duckdb": "strftime(ts, '%Y-%m-%d %H:%M:%S,%g')",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _inputs(text: str, names) -> list[str]:
    return [n for n in names if "{" + n + "}" in text]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view as a DataFrame."""
    text = VIEWS.get(name) or LAYERED[name]
    text = text.replace("<time>", _TIME["spark"]).replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    inputs = {n: table(spark, sf_dir, n) for n in _inputs(text, TABLES)}
    inputs |= {n: view(spark, sf_dir, n) for n in _inputs(text, VIEWS)}
    return spark.sql(text, **inputs)


@cache
def _oracle_text(name: str) -> tuple[str, tuple[str, ...]]:
    text = (VIEWS.get(name) or LAYERED[name]).replace("<time>", _TIME["duckdb"])
    above = tuple(_inputs(text, VIEWS))
    for n in [*TABLES, *VIEWS]:
        text = text.replace("{" + n + "}", n)
    return text.replace("{{", "{").replace("}}", "}"), above


def with_views(names: str, query: str) -> str:
    """DuckDB text: the named views as common tables, then ``query``."""
    order: list[str] = []
    for name in names.split():
        for n in [*_oracle_text(name)[1], name]:
            if n not in order:
                order.append(n)
    head = ",\n".join(f"{n} AS MATERIALIZED ({_oracle_text(n)[0].strip()})" for n in order)
    query = query.strip()
    if query.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head},\n{query[len('WITH RECURSIVE'):].strip()}"
    if query.upper().startswith("WITH"):
        return f"WITH {head},\n{query[4:].strip()}"
    return f"WITH {head}\n{query}"
