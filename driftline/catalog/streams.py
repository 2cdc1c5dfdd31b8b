"""The streams, run over all given rows until none is left."""

from pyspark.sql import functions as F

from driftline.catalog.registry import query
from driftline.plans.copying import DEFAULT_EXCLUDE
from driftline.sources import trees
from driftline.sources.scratch import scratch_path
from driftline.sources.views import VIEWS
from driftline.streaming import streams


def replay(d, table, columns):
    """The parquet table as a file stream."""
    schema = d.table(table).schema
    return (d.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(d.folder)).select(*columns)


def replay_late(d, columns, repeated=False):
    """The events as a stream of several batches, each with days from all over the time range; with ``repeated`` the rows
    of some users come once more in the last batches, under a later day."""
    place, events = scratch_path(d.spark, "late"), d.table("events")
    turn = F.dayofyear("ts") * 3 % 5
    turns = [events.where(turn == n) for n in (3, 1, 4, 0, 2)]
    if repeated:
        turns.append(events.where("user_id % 3 = 0").withColumn("ts", F.col("ts") + F.expr("INTERVAL 40 DAYS")))
    # a turn is as many files as a shuffle has parts, and so is a batch
    parts = int(d.spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in turns:
        rows.repartition(parts, "event_id").write.mode("append").parquet(place)
    files = d.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", parts)
    return files.parquet(place).select(*columns)


def event_stream(d):
    kind = F.col("event_type")
    return replay_late(d, [
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("event_time"),
        F.when(F.col("event_id") % 10 == 0, "policy").when(kind.isin("click", "signup"), "policy").otherwise("policyinstance").alias("entity_type"),
        F.when(kind == "click", 2).when(kind == "signup", 7).when(kind == "purchase", 8).when(kind == "error", 11).otherwise(12).alias("event_code")], repeated=True)


EVENT_ORACLE = """
WITH mixed AS (SELECT id, event_time, CASE WHEN id % 10 = 0 THEN 'policy' ELSE entity_type END AS entity_type, event_code FROM event)
SELECT id, event_time, entity_type, event_code, CASE WHEN event_code = 11 THEN 'error' ELSE 'info' END AS severity FROM mixed
WHERE (entity_type = 'policy' AND event_code IN (2, 7)) OR (entity_type = 'policyinstance' AND event_code IN (8, 11, 12))"""


def stored_events(d):
    """Sink and rejects of the event stream, started twice: the second start finds nothing new and repeats nothing."""
    sink, checkpoint = streams.stream_paths(d.spark, "events")
    rejects, stream = f"{sink}-rejects", event_stream(d)
    for _ in range(2):
        streams.stream_events(stream, sink, checkpoint, rejects).awaitTermination()
    return streams.event_table(d.spark, sink), d.spark.read.parquet(rejects)


@query("stream_events", "event", EVENT_ORACLE)
def stream_events(d):
    return stored_events(d)[0].select("id", F.col("event_time").cast("timestamp_ntz").alias("event_time"), "entity_type", "event_code", "severity")


@query("stream_event_rejects", "event", """
WITH mixed AS (SELECT id, CAST(policy_id AS BIGINT) AS user_id, CASE WHEN id % 10 = 0 THEN 'policy' ELSE entity_type END AS entity_type, event_code FROM event),
bad AS (SELECT * FROM mixed WHERE NOT ((entity_type = 'policy' AND event_code IN (2, 7)) OR (entity_type = 'policyinstance' AND event_code IN (8, 11, 12))))
SELECT id, entity_type, event_code FROM bad UNION ALL SELECT id, entity_type, event_code FROM bad WHERE user_id % 3 = 0""")
def stream_event_rejects(d):
    return stored_events(d)[1].select("id", "entity_type", "event_code")


def progress_columns():
    n = F.col("event_id")
    return [F.col("user_id").cast("string").alias("run_id"), n.alias("seq"),
            F.concat(F.lit("Job"), F.floor(n / 400).cast("string")).alias("job_id"),
            (n * 7 % 101).cast("double").alias("percent")]


PROGRESS_ORACLE = """
WITH r AS (SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS seq, 'job' || CAST(event_id // 400 AS VARCHAR) AS job_id, CAST(event_id * 7 % 101 AS DOUBLE) AS percent FROM events),
top AS (SELECT run_id, arg_max(job_id, seq) AS job_id FROM r GROUP BY run_id)
SELECT r.run_id, arg_max(r.seq, (r.percent, r.seq)) AS seq, r.job_id, max(r.percent) AS percent FROM r JOIN top t ON t.run_id = r.run_id AND t.job_id = r.job_id GROUP BY r.run_id, r.job_id"""


@query("stream_progress", "", PROGRESS_ORACLE)
def stream_progress(d):
    sink, checkpoint = streams.stream_paths(d.spark, "progress")
    changes = streams.stream_progress(replay_late(d, progress_columns()))

    def keep(batch, number):
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")

    (changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return streams.top_progress(d.spark.read.parquet(sink))


@query("latest_progress", "", PROGRESS_ORACLE)
def latest_progress(d):
    return streams.latest_progress(d.table("events").select(*progress_columns()))


@query("stream_new_files", "", """
SELECT '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS rel_path, CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE doc_id % 8 > 1""")
def stream_new_files(d):
    root = scratch_path(d.spark, "incoming")
    number = F.col("doc_id").cast("string")
    name = F.when(F.col("doc_id") % 8 == 0, F.concat(number, F.lit("._COPYING_"))).when(
        F.col("doc_id") % 8 == 1, F.concat(F.lit(".Trash/"), number)).otherwise(F.concat(number, F.lit(".txt")))
    trees.write_files(d.table("documents").select(F.concat(F.lit("/"), "source", F.lit("/"), name).alias("rel_path"),
                                                  F.col("text").alias("content")), root)
    sink, checkpoint = streams.stream_paths(d.spark, "found")
    found = streams.stream_new_files(d.spark, root, DEFAULT_EXCLUDE)
    (found.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
    return d.spark.read.parquet(sink).select(F.regexp_extract("path", "(/src[0-9]+/.*)$", 1).alias("rel_path"), "length")


@query("stream_last_status", "policy_instance", "SELECT policy_id, arg_max(status, (end_time, id)) AS last_status FROM policy_instance WHERE end_time IS NOT NULL GROUP BY policy_id")
def stream_last_status(d):
    text = VIEWS["policy_instance"].replace("TIMESTAMP '", "TIMESTAMP_NTZ '")
    runs = d.spark.sql(text, orders=replay(d, "orders", ["*"]))
    sink, checkpoint = streams.stream_paths(d.spark, "status")
    streams.stream_last_status(runs, sink, checkpoint).awaitTermination()
    return streams.last_status_table(d.spark, sink).select("policy_id", "last_status")
