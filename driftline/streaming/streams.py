"""The parts of replication that run continuously.

No stream has a watermark: events and progress may arrive at any time after they happened, and a row that comes late counts
as much as one that comes in time.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from driftline.operators.ordering import fold, placed
from driftline.plans.copying import exclude_find
from driftline.sources import trees
from driftline.sources.events import classify_events
from driftline.sources.files import expand
from driftline.sources.scratch import scratch_path, spread, written
from driftline.streaming.batch_table import BatchTable


#: Fixed value: the state store that keeps its rows on disk, for states that grow with the number of ids.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Files in a batch of new files.
FILES_PER_BATCH = 100_000
NEW_FILE = "path string, length bigint, mtime timestamp"


class Running:
    """Stream queries that belong together."""

    def __init__(self, *queries):
        self.queries = queries

    def awaitTermination(self) -> None:  # noqa: N802, as the queries have it
        for query in self.queries:
            query.awaitTermination()

    def stop(self) -> None:
        for query in self.queries:
            query.stop()


def _state_settings(spark: SparkSession) -> dict[str, str]:
    """Settings that put state in RocksDB, unless the session names another store."""
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKS,
             "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true"}
    return {k: v for k, v in names.items() if spark.conf.get(k, None) is None or "HDFSBacked" in spark.conf.get(k)}


def _started(spark: SparkSession, writer):
    """The query of ``writer``, with its state in RocksDB unless the session names another store."""
    own = _state_settings(spark)
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        return writer.start()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def first_of_each(events: DataFrame) -> DataFrame:
    """Of a stream with ``id``: the state of each id a batch has met, as the row that came first and ``fresh``.

    The state is kept by id alone, for ever: an id that comes again after any time, under any date, is known. Of several
    rows in one batch the earliest stands. ``fresh`` tells that the batch met the id for the first time. Batches are told
    apart by their time, which is stored with a batch before it runs, so one that runs again gives the same rows.
    """
    wide = sorted((c for c in events.columns if c != "id"), key=lambda c: c != "event_time")
    # the planner puts the batch's time here, not the time at which a task runs
    arrived = events.withColumn("arrived", F.current_timestamp())
    kept = arrived.groupBy("id").agg(F.min(F.struct("arrived", *wide)).alias("first"), F.max("arrived").alias("last"))
    return kept.select("id", *[F.col(f"first.{c}").alias(c) for c in wide], (F.col("first.arrived") == F.col("last")).alias("fresh"))


def stream_events(stream: DataFrame, sink: str, checkpoint: str, rejects: str) -> Running:
    """Append events with their severity and name to ``sink``, each id once, however late or under whatever day it comes.

    ``stream`` has id, event_time, event_code, entity_type. Events that their kind of entity may not raise, and those without
    an id, go to ``rejects``. Which ids are stored is the keyed state of the query (:func:`first_of_each`), on disk in
    RocksDB: a batch reads its own rows and the states of its own ids, never what earlier batches have written.
    :func:`event_table` reads the sink.
    """
    spark = stream.sparkSession
    ready = classify_events(stream)
    good = F.col("legal") & F.col("id").isNotNull()

    def store(batch: DataFrame, number: int) -> None:
        fresh = batch.where("fresh").drop("fresh").withColumn("day", F.to_date("event_time"))
        event_sink(batch.sparkSession, sink).append(fresh, number)

    stored = (first_of_each(ready.where(good).drop("legal")).writeStream.outputMode("update").foreachBatch(store)
              .option("checkpointLocation", f"{checkpoint}/events").trigger(availableNow=True))
    refused = (ready.where(~good).drop("legal").writeStream.format("parquet").option("path", rejects)
               .option("checkpointLocation", f"{checkpoint}/rejects").trigger(availableNow=True))
    return Running(_started(spark, stored), refused.start())


def event_sink(spark: SparkSession, sink: str) -> BatchTable:
    return BatchTable(spark, sink, by=["day"])


def event_table(spark: SparkSession, sink: str) -> DataFrame:
    """The events that :func:`stream_events` has stored, partitioned by ``day``."""
    return event_sink(spark, sink).read()


def stream_progress(stream: DataFrame) -> DataFrame:
    """Progress per run and job as a stream of changes: (run_id, job_id, percent, seq, last_seq).

    ``stream`` has run_id, seq, job_id, percent. The state is one small row per run and job, reduced before it is shuffled,
    and is kept: a late row meets the state it would have met in time. ``percent`` never falls; ``seq`` is the latest row that has
    it and ``last_seq`` the latest of all. :func:`top_progress` gives the run's progress from the changes.
    """
    return (stream.groupBy("run_id", F.lower("job_id").alias("job_id"))
            .agg(F.max(F.struct("percent", "seq")).alias("best"), F.max("seq").alias("last_seq"))
            .select("run_id", "job_id", "best.percent", "best.seq", "last_seq"))


def top_progress(changes: DataFrame) -> DataFrame:
    """(run_id, seq, job_id, percent) from the changes of :func:`stream_progress`, in any order, old ones included.

    The job seen last decides, and within it the highest percentage, the later row among equals.
    """
    per_job = changes.groupBy("run_id", "job_id").agg(
        F.max(F.struct("percent", "seq")).alias("best"), F.max("last_seq").alias("last_seq"))
    top = per_job.groupBy("run_id").agg(F.max_by(F.struct("job_id", "best"), "last_seq").alias("t"))
    return top.select("run_id", "t.best.seq", "t.job_id", "t.best.percent")


def latest_progress(rows: DataFrame) -> DataFrame:
    """The batch twin: the same of all rows at once."""
    return top_progress(stream_progress(rows))


def stream_new_files(spark: SparkSession, root: str, exclude: str) -> DataFrame:
    """New files below a root as a stream of (path, length, mtime), without excluded paths. Contents are not read.

    The driver knows no file: tasks list the root into files of a folder (:class:`Listings`), and these files are what the
    stream reads, one with at most FILES_PER_BATCH paths to a batch, the oldest paths first. Which paths came before is
    the keyed state of the query, on disk in RocksDB, so a new listing under the same checkpoint gives new paths only. The
    root is listed now, and again whenever the query has run out of paths. The stream has a session of its own, so that
    its listener hears of no other query. A batch that broke off reads its file again; if that is gone from the shared
    folder, its paths come with the new listing.
    """
    own = spark.newSession()
    # whether a batch is computed at all, and whole, was always up to the sink
    checks = {"spark.sql.streaming.stateStore.commitValidation.enabled": "false"}
    for key, value in {**spark.conf.getAll, **_state_settings(spark), **checks}.items():
        if own.conf.isModifiable(key):
            own.conf.set(key, value)
    listings = Listings(own, root, exclude)
    listings.add()
    own.streams.addListener(listings)
    # a pattern, since under one checkpoint the folder differs from start to start
    return (own.readStream.schema(NEW_FILE).option("maxFilesPerTrigger", 1).option("ignoreMissingFiles", True)
            .parquet(f"{listings.folder}/part-*").dropDuplicates(["path"]).select("path", "length", "mtime"))


class Listings(StreamingQueryListener):
    """A folder with the paths found below a root, each once, in files of at most FILES_PER_BATCH.

    As a listener it lists the root again when a query of its session is idle, which Spark tells about every ten seconds.
    """

    def __init__(self, spark: SparkSession, root: str, exclude: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        self.files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self.spark, self.root, self.exclude = spark, self.files.makeQualified(path).toString(), exclude
        self.folder = scratch_path(spark, "listings")
        self._shared().mkdirs(self._at(self.folder))
        self.holds = False

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _shared(self):
        return self._at(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def found(self) -> DataFrame:
        """The files that are there now, named and left out (hidden ones, empty ones) as by Spark's own file sources."""
        roots = expand(self.root)
        if not roots and not any(c in self.root for c in "*?[{"):
            raise FileNotFoundError(f"{self.root} is missing")
        name = F.col("name")
        hidden = name.startswith(".") | (name.startswith("_") & ~name.contains("="))
        listed = trees.list_tree(self.spark, roots, F.when(F.col("is_dir") & name.rlike("^_(common_)?metadata"), False).otherwise(
            hidden | name.endswith("._COPYING_")))
        below = F.col("path").substr(F.length("root_path") + 1, F.length("path"))
        rows = listed.where("not is_dir and length > 0").select(
            F.concat("root", below).alias("path"), "length", F.timestamp_millis(F.floor(F.col("mtime_ns") / 1_000_000)).alias("mtime"))
        # a directory is listed by one task; its paths are compared by all, as they are written before
        return exclude_find(written(spread(rows, F.xxhash64("path")), "found"), self.exclude, "path")

    def add(self) -> None:
        """Put the paths into the folder that it does not hold yet."""
        rows = self.found()
        if self.holds:
            rows = rows.join(self.spark.read.schema(NEW_FILE).parquet(self.folder).select("path"), "path", "left_anti")
        order = ["mtime", "path"]
        rows = placed(rows, [], order)
        parts = math.ceil(rows.count() / FILES_PER_BATCH)
        if not parts:
            return
        nth = fold(rows, [], order, {"nth": ("sum", F.lit(1).cast("bigint"))})
        part = F.floor((F.col("nth") - 1) / FILES_PER_BATCH).cast("int")
        staged, files = scratch_path(self.spark, "listing"), self._shared()
        nth.repartitionById(parts, part).select("path", "length", "mtime").write.parquet(staged)
        made = sorted(s.getPath().getName() for s in files.listStatus(self._at(staged)) if s.getPath().getName().startswith("part-"))
        now = int(time.time() * 1000) - len(made)
        for n, name in enumerate(made):  # a file source takes its oldest file first
            files.setTimes(self._at(f"{staged}/{name}"), now + n, -1)
            files.rename(self._at(f"{staged}/{name}"), self._at(f"{self.folder}/{name}"))
        self.holds = True

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.add()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def newest_status(rows: DataFrame) -> DataFrame:
    """(policy_id, last_status, end_time, id): the newest row of each policy."""
    return rows.groupBy("policy_id").agg(F.max(F.struct("end_time", "id", "last_status")).alias("b")).select(
        "policy_id", "b.last_status", "b.end_time", "b.id")


def stream_last_status(stream: DataFrame, table: str, checkpoint: str):
    """Keep the last finished run of each policy.

    A batch adds the newest run of the policies it has seen, and nothing else; batches are merged level by level
    (:class:`BatchTable`), so the table stays about as large as the number of policies. :func:`last_status_table` reads it.
    """

    def append(batch: DataFrame, number: int) -> None:
        ended = batch.where("end_time is not null").withColumnRenamed("status", "last_status")
        status_sink(batch.sparkSession, table).append(newest_status(ended), number)

    return (stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def status_sink(spark: SparkSession, table: str) -> BatchTable:
    return BatchTable(spark, table, merge=newest_status)


def last_status_table(spark: SparkSession, table: str) -> DataFrame:
    """The newest finished run per policy of what :func:`stream_last_status` has written."""
    return status_sink(spark, table).read()


def stream_paths(spark: SparkSession, purpose: str) -> tuple[str, str]:
    """A new sink and checkpoint path in the shared folder."""
    base = scratch_path(spark, purpose)
    return f"{base}/sink", f"{base}/checkpoint"
