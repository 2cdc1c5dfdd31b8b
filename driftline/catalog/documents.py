"""Access policies and metadata entities."""

from datetime import datetime

from pyspark.sql import functions as F

from driftline.catalog.registry import query
from driftline.operators import documents
from driftline.sources.access_policies import SCHEMA, read_access_policies, write_access_policies
from driftline.sources.scratch import scratch_path

AT = datetime(2024, 5, 6, 7, 8, 9)

# An access policy per part: its paths are the part's type, for every third part a second path.
HELD = """
WITH held AS (SELECT CAST(p_partkey AS VARCHAR) AS name, p_brand AS service, '/' || lower(p_type) || CASE WHEN p_partkey % 4 = 0 THEN 's' ELSE '' END || '/' || CAST(p_size AS VARCHAR) AS p1,
 CASE WHEN p_partkey % 3 = 0 THEN '/extra/' || CAST(p_partkey AS VARCHAR) END AS p2, p_partkey % 7 <> 0 AS has_path, CASE WHEN p_partkey % 5 = 0 THEN 'economy' ELSE lower(p_type) END AS db FROM part)
"""


def held(d):
    n = F.col("p_partkey")
    first = F.concat(F.lit("/"), F.lower("p_type"), F.when(n % 4 == 0, "s").otherwise(""), F.lit("/"), F.col("p_size").cast("string"))
    second = F.concat(F.lit("/extra/"), n.cast("string"))
    values = F.when(n % 3 == 0, F.array(first, second)).otherwise(F.array(first))

    def resource(v, recursive):
        return F.struct(v.alias("values"), F.lit(False).alias("isExcludes"), F.lit(recursive).alias("isRecursive"))

    db = F.when(n % 5 == 0, "economy").otherwise(F.lower("p_type"))
    paths = F.create_map(F.lit("path"), resource(values, True))
    dbs = F.create_map(F.lit("database"), resource(F.array(db), False))
    rows = d.table("part").select(
        F.col("p_brand").alias("service"), n.cast("string").alias("name"), F.lit("").alias("description"),
        F.when(n % 7 != 0, F.map_concat(paths, dbs)).otherwise(dbs).alias("resources"))
    empty = d.spark.createDataFrame([], SCHEMA)
    return empty.unionByName(rows, allowMissingColumns=True)


def seen(policies):
    values = F.array_join(F.col("resources")["path"]["values"], "|")
    return policies.select("name", F.coalesce(values, F.lit("")).alias("paths"),
                           F.array_join(F.col("resources")["database"]["values"], "|").alias("databases"))


SHOWN = "CASE WHEN has_path THEN concat_ws('|', p1, p2) ELSE '' END"


@query("single_resource_policies", "", HELD + "SELECT name FROM held WHERE has_path AND p2 IS NULL")
def single_resource_policies(d):
    return documents.single_resource(held(d), "FS").select("name")


@query("single_resource_databases", "", HELD + "SELECT name FROM held")
def single_resource_databases(d):
    return documents.single_resource(held(d), "HIVE").select("name")


@query("rehome_policies", "", HELD + """
SELECT name, CASE WHEN has_path THEN concat_ws('|', CASE WHEN starts_with(p1, '/economy') THEN '/dr/eco' || p1[9:] ELSE p1 END, p2) ELSE '' END AS paths, db AS databases FROM held""")
def rehome_policies(d):
    return seen(documents.rehome_policies(held(d), ("/economy/", "/dr/eco/"), "FS"))


@query("rehome_databases", "", HELD + f"SELECT name, {SHOWN} AS paths, CASE WHEN db = 'economy' THEN 'economy_dr' ELSE db END AS databases FROM held")
def rehome_databases(d):
    return seen(documents.rehome_policies(held(d), ("economy", "economy_dr"), "HIVE"))


@query("rehome_per_service", "", HELD + """
SELECT name, CASE WHEN has_path THEN concat_ws('|', CASE WHEN service LIKE '%1' AND starts_with(p1, '/promo') THEN '/dr/' || lower(service) || p1[7:] ELSE p1 END, p2) ELSE '' END AS paths, db AS databases FROM held""")
def rehome_per_service(d):
    rows = held(d)
    mapping = rows.where("service like '%1'").select("service").distinct().select(
        "service", F.lit("/promo").alias("source"), F.concat(F.lit("/dr/"), F.lower("service")).alias("target"))
    return seen(documents.rehome_policies(rows, mapping, "FS"))


@query("describe_imports", "", HELD + "SELECT name, name || ' created by replication while importing from ' || service || ' on 2024-05-06T07:08:09' AS description FROM held")
def describe_imports(d):
    return documents.describe_imports(held(d), F.col("service"), AT).select("name", "description")


DATASETS = """
WITH ds AS (SELECT CASE WHEN s_suppkey % 4 > 0 THEN 'svc' || CAST(s_suppkey % 3 AS VARCHAR) END AS service, CASE WHEN s_suppkey % 5 > 0 THEN 'cl' || CAST(s_nationkey AS VARCHAR) END AS cluster,
 '/src/' || s_name AS src, '/dr/' || s_name AS dst FROM supplier WHERE s_suppkey % 4 > 0)
"""


def datasets(d):
    n = F.col("s_suppkey")
    return d.table("supplier").select(
        F.when(n % 4 > 0, F.concat(F.lit("svc"), (n % 3).cast("string"))).alias("service"),
        F.when(n % 5 > 0, F.concat(F.lit("cl"), F.col("s_nationkey").cast("string"))).alias("source_cluster"),
        F.concat(F.lit("/src/"), "s_name", F.lit("/")).alias("source_dataset"),
        F.concat(F.lit("/dr/"), "s_name", F.lit("//")).alias("target_dataset"))


def flat(policies, resource):
    def accesses(column):
        return F.array_join(F.transform(F.get(column, 0)["accesses"], lambda a: a["type"]), ",")

    held_by = F.get("denyExceptions", 0)["users"]
    return policies.select(
        "service", "name", "description", F.array_join(F.col("resources")[resource]["values"], "|").alias("resource"),
        F.col("resources")[resource]["isRecursive"].alias("recursive"), accesses("denyPolicyItems").alias("denied"),
        F.array_join(F.get("denyPolicyItems", 0)["groups"], ",").alias("groups"), accesses("denyExceptions").alias("exempt"),
        F.array_join(held_by, ",").alias("users"), F.size("resources").cast("bigint").alias("resources"))


DENY = """SELECT service, coalesce(cluster, 'source') || '_replication deny policy for ' || dst AS name,
 'Deny policy created by replication while importing from ' || coalesce(cluster, 'source') || ' on 2024-05-06T07:08:09' AS description,
 src || '|{dummy}' AS resource, {recursive} AS recursive, '{denied}' AS denied, 'public' AS groups, '{exempt}' AS exempt, 'replication' AS users, CAST({n} AS BIGINT) AS resources FROM ds"""


@query("deny_policies", "", DATASETS + DENY.format(dummy="/dummy", recursive="true", denied="write", exempt="read,write,execute", n=1))
def deny_policies(d):
    return flat(documents.deny_policies(datasets(d), "FS", AT), "path")


@query("deny_policies_hive", "", DATASETS + DENY.format(dummy="dummy", recursive="false", denied="create,update,drop,alter,index,lock,write",
                                                        exempt="create,update,drop,alter,index,lock,write,select,read", n=3))
def deny_policies_hive(d):
    return flat(documents.deny_policies(datasets(d), "HIVE", AT), "database")


@query("add_deny_policies", "", "SELECT (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier WHERE s_suppkey % 4 > 0) AS policies, (SELECT count(*) FROM supplier WHERE s_suppkey % 4 > 0) AS deny")
def add_deny_policies(d):
    every = documents.add_deny_policies(held(d), datasets(d), "FS", AT)
    return every.agg(F.count("*").alias("policies"), F.count("denyPolicyItems").alias("deny"))


@query("access_policies_round_trip", "", HELD + f"SELECT name, {SHOWN} AS paths, db AS databases FROM held")
def access_policies_round_trip(d):
    place = write_access_policies(held(d), scratch_path(d.spark, "access"), "FS")
    return seen(read_access_policies(d.spark, place))


# An entity per part (a database) and per order line's part (a path).
def entities(d):
    n = F.col("p_partkey")
    place = F.concat(F.when(n % 3 == 0, "HDFS://nn1:8020").otherwise("hdfs://other:8020"), F.lit("/apps/"), "p_type")
    plain = F.create_map(F.lit("name"), F.when(n % 2 == 0, "stocks").otherwise(F.lower("p_type")), F.lit("clusterName"),
                         F.concat(F.lit("cl-"), (n % 4).cast("string")), F.lit("location"), place,
                         F.lit("replicatedTo"), F.lit("x"))
    path = F.create_map(F.lit("name"), F.concat(place, F.lit("/f"), n.cast("string")), F.lit("clusterName"), F.lit("cl-1"))
    kind = F.when(n % 5 == 0, "hdfs_path").otherwise("hive_db")
    return d.table("part").select(
        n.cast("string").alias("guid"), kind.alias("type"), (n % 3 > 0).alias("top_level"),
        F.when(n % 5 == 0, path).otherwise(plain).alias("attributes"),
        F.when(n % 4 == 0, F.array(F.lit("pii"))).alias("classifications"))


def entity_columns(df):
    a = F.col("attributes")
    return df.select("guid", a["name"].alias("name"), a["clusterName"].alias("cluster"), a["location"].alias("location"),
                     a["replicatedTo"].alias("replicated_to"), F.array_join("classifications", ",").alias("tags"))


ENTITIES = """
WITH e AS (SELECT CAST(p_partkey AS VARCHAR) AS guid, p_partkey AS n, CASE WHEN p_partkey % 3 = 0 THEN 'HDFS://nn1:8020' ELSE 'hdfs://other:8020' END || '/apps/' || p_type AS place, lower(p_type) AS lt FROM part)
"""
TAGS = "CASE WHEN n % 3 > 0 THEN CASE WHEN n % 4 = 0 THEN 'pii,cl_1_replicated' ELSE 'cl_1_replicated' END WHEN n % 4 = 0 THEN 'pii' END"


@query("apply_entity_transforms", "", ENTITIES + f"""
SELECT guid, CASE WHEN n % 5 = 0 THEN place || '/f' || guid WHEN n % 2 = 0 THEN 'stocks_dw' ELSE lt END AS name, CASE WHEN n % 5 = 0 THEN 'cl-1' WHEN n % 4 = 1 THEN 'cl-2' ELSE 'cl-' || CAST(n % 4 AS VARCHAR) END AS cluster,
 CASE WHEN n % 5 > 0 THEN CASE WHEN n % 3 = 0 THEN 'hdfs://nn2:8020' || place[16:] ELSE place END END AS location, CAST(NULL AS VARCHAR) AS replicated_to, {TAGS} AS tags FROM e""")
def apply_entity_transforms(d):
    rules = documents.build_rules("HIVE", "cl-1", "cl-2", "stocks", "stocks_dw", "hdfs://nn1:8020", "hdfs://nn2:8020")
    return entity_columns(documents.apply_entity_transforms(entities(d), rules))


@query("apply_path_transforms", "", ENTITIES + f"""
SELECT guid, CASE WHEN n % 5 = 0 THEN CASE WHEN n % 3 = 0 AND starts_with(lower(place), 'hdfs://nn1:8020/apps/economy') THEN 'hdfs://nn2:8020/dw/e/' || 'f' || guid ELSE place || '/f' || guid END WHEN n % 2 = 0 THEN 'stocks' ELSE lt END AS name,
 CASE WHEN n % 5 = 0 THEN 'cl-2' ELSE 'cl-' || CAST(n % 4 AS VARCHAR) END AS cluster, CASE WHEN n % 5 > 0 THEN place END AS location, CAST(NULL AS VARCHAR) AS replicated_to, {TAGS} AS tags FROM e""")
def apply_path_transforms(d):
    rules = documents.build_rules("FS", "cl-1", "cl-2", "/apps/economy", "/dw/e", "hdfs://nn1:8020", "hdfs://nn2:8020")
    return entity_columns(documents.apply_entity_transforms(entities(d), rules))


@query("changed_entities", "", """
WITH paths AS (SELECT 'p' || CAST(doc_id AS VARCHAR) AS guid, 'hdfs://nn/data/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) AS name, n_chars AS updated FROM documents),
dbs AS (SELECT 'd' || CAST(c_custkey AS VARCHAR) AS guid, 'db' || CAST(c_custkey % 50 AS VARCHAR) || '@cl' || CAST(c_nationkey % 3 AS VARCHAR) AS qualified_name, c_custkey AS updated FROM customer),
ds AS (SELECT DISTINCT source || '-' || lang AS dataset_id, 'hdfs://nn/data/' || source || '/' || lang AS place FROM documents UNION ALL SELECT DISTINCT source, 'hdfs://nn/data/' || source FROM documents),
marks AS (SELECT dataset_id, place, CASE WHEN length(dataset_id) % 2 = 0 THEN 2000 ELSE 0 END AS marker FROM ds),
hive AS (SELECT 'h' || CAST(n_nationkey AS VARCHAR) AS dataset_id, 'db' || CAST(n_nationkey AS VARCHAR) || '@cl1' AS qn FROM nation)
SELECT m.dataset_id, p.guid FROM paths p JOIN marks m ON starts_with(p.name, m.place || '/') AND p.updated > m.marker
UNION SELECT h.dataset_id, d.guid FROM dbs d JOIN hive h ON h.qn = d.qualified_name AND d.updated > 0""")
def changed_entities(d):
    docs = d.table("documents")
    place = F.concat(F.lit("/data/"), "source", F.lit("/"), "lang")
    nothing = F.lit(None).cast("string")
    paths = docs.select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("guid"), F.lit("hdfs_path").alias("type"),
                        F.concat(F.lit("hdfs://nn"), place, F.lit("/"), F.col("doc_id").cast("string")).alias("name"),
                        nothing.alias("qualified_name"), F.col("n_chars").alias("updated"))
    dbs = d.table("customer").select(
        F.concat(F.lit("d"), F.col("c_custkey").cast("string")).alias("guid"), F.lit("hive_db").alias("type"), nothing.alias("name"),
        F.concat(F.lit("db"), (F.col("c_custkey") % 50).cast("string"), F.lit("@cl"), (F.col("c_nationkey") % 3).cast("string")).alias("qualified_name"),
        F.col("c_custkey").alias("updated"))
    fs = (docs.select(F.concat("source", F.lit("-"), "lang").alias("dataset_id"), place.alias("dataset"))
          .union(docs.select("source", F.concat(F.lit("/data/"), "source", F.lit("/")))).distinct())
    sets = fs.select("dataset_id", F.lit("FS").alias("kind"), F.lit("cl1").alias("cluster"), "dataset", F.lit("hdfs://nn").alias("endpoint"))
    hive = d.table("nation").select(
        F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("dataset_id"), F.lit("HIVE").alias("kind"), F.lit("cl1").alias("cluster"),
        F.concat(F.lit("DB"), F.col("n_nationkey").cast("string")).alias("dataset"), nothing.alias("endpoint"))
    markers = sets.where("length(dataset_id) % 2 = 0").select("dataset_id", F.lit(2000).cast("bigint").alias("marker"))
    return documents.changed_entities(paths.unionByName(dbs), markers, sets.unionByName(hive))
