"""Progress of copy jobs and of query-log driven runs, and the tracking text of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.texts import progress_pair

PROGRESS = ("total bigint, completed bigint, exportTotal bigint, exportCompleted bigint, importTotal bigint, "
            "importCompleted bigint, failed bigint, killed bigint, filesCopied bigint, dirCopied bigint, "
            "bytesCopied bigint, timeTaken bigint, unit string, jobProgress double")
METRIC = f"struct<jobId:string,jobType:string,progress:struct<{PROGRESS.replace(' bigint', ':bigint').replace(' string', ':string').replace(' double', ':double').replace(', ', ',')}>>"
TRACKING = f"array<{METRIC}>"

# Fields of the JSON in a query log line.
LOG_FIELDS = ("dumpType string, loadType string, estimatedNumTables bigint, estimatedNumEvents bigint, "
              "actualNumTables bigint, actualNumEvents bigint, numTables bigint, numEvents bigint, "
              "tablesDumpProgress string, eventsDumpProgress string, tablesLoadProgress string, "
              "eventsLoadProgress string")

# Share of the export in a run's percentage, and of the first phase in a bootstrap.
EXPORT_SHARE, BOOTSTRAP_SHARE = 10.0, 0.9


def copy_progress(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Progress per job: tasks are (job_id, state, start_ms, end_ms, progress), results as in copy_counters with job_id.

    A job is complete when no task is open; an open one shows the mean progress of its tasks, and its time runs to the
    latest time seen.
    """
    done = F.col("state").isin("SUCCEEDED", "FAILED", "KILLED")
    per_job = tasks.groupBy("job_id").agg(
        F.count("*").alias("total"),
        F.sum((F.col("state") == "SUCCEEDED").cast("bigint")).alias("succeeded"),
        F.sum((F.col("state") == "FAILED").cast("bigint")).alias("failed"),
        F.sum((F.col("state") == "KILLED").cast("bigint")).alias("killed"),
        F.min(done.cast("int")).alias("__complete"),
        F.avg("progress").alias("__mean"),
        (F.max("end_ms") - F.min("start_ms")).alias("time_taken"))
    copied = results.groupBy("job_id").agg(
        F.sum(F.col("action").isin("OVERWRITE", "APPEND").cast("bigint")).alias("files_copied"),
        F.sum((F.col("action") == "MKDIR").cast("bigint")).alias("dirs_copied"),
        F.sum(F.when(F.col("action").isin("OVERWRITE", "APPEND"), F.col("bytes")).otherwise(0)).alias("bytes_copied"))
    complete = F.col("__complete") == 1
    return per_job.join(copied, "job_id", "left").select(
        "job_id", "time_taken", F.when(complete, 100.0).otherwise(F.round(F.col("__mean") * 100, 2)).alias("progress"),
        "total", F.when(complete, F.col("total")).otherwise(F.col("succeeded")).alias("completed"), "failed", "killed",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("files_copied", "dirs_copied", "bytes_copied")])


def parse_query_log(lines: DataFrame) -> DataFrame:
    """(run_id, action, seq, event, kind, total, completed) of ``LEVEL : REPL::<EVENT>: {json}`` lines.

    ``kind`` is BOOTSTRAP or INCREMENTAL on START and END lines. Lines of another form have no event.
    """
    pattern = r"^\w+\s+:\s+.*REPL::([A-Z_]+): (\{.*)$"
    read = lines.select("run_id", "action", "seq", F.regexp_extract("line", pattern, 1).alias("word"),
                        F.from_json(F.regexp_extract("line", pattern, 2), LOG_FIELDS).alias("j"))
    event = F.col("word")

    def number(name: str) -> Column:
        return F.coalesce(F.col(f"j.{name}"), F.lit(0))

    export = F.col("action") == "EXPORT"
    kind = F.when(export, F.col("j.dumpType")).otherwise(F.col("j.loadType"))
    tables = F.when(export, F.when(event == "START", number("estimatedNumTables")).otherwise(
        number("actualNumTables"))).otherwise(number("numTables"))
    events = F.when(export, F.when(event == "START", number("estimatedNumEvents")).otherwise(
        number("actualNumEvents"))).otherwise(number("numEvents"))
    counted = F.when(kind == "BOOTSTRAP", tables).otherwise(events)
    pair = F.coalesce(*[F.when(event == name, F.col(f"j.{field}")) for name, field in (
        ("TABLE_DUMP", "tablesDumpProgress"), ("EVENT_DUMP", "eventsDumpProgress"),
        ("TABLE_LOAD", "tablesLoadProgress"), ("EVENT_LOAD", "eventsLoadProgress"))])
    done, total = progress_pair(pair)
    steps = event.isin("TABLE_DUMP", "EVENT_DUMP", "TABLE_LOAD", "EVENT_LOAD")
    ends = event.isin("START", "END")
    return read.select(
        "run_id", "action", "seq", F.when(event != "", event).alias("event"),
        F.when(ends, kind).alias("kind"),
        F.when(ends, counted).when(steps, total).alias("total"),
        F.when(event == "END", counted).when(steps, done).alias("completed"))


def hive_run_progress(lines: DataFrame) -> DataFrame:
    """(run_id, action, kind, total, completed): state of each run's export and import after its log so far.

    Only START and END lines and the last line count; the last line counts if there was a START and more than one line,
    or neither START nor END. Lines that carry no numbers change nothing.
    """
    parsed = parse_query_log(lines)
    last = F.struct("seq", F.col("event").alias("e"), F.col("total").alias("t"), F.col("completed").alias("c"))
    start, end = F.col("event") == "START", F.col("event") == "END"

    def newest(test: Column) -> Column:
        return F.max(F.when(test, F.struct("seq", "kind", "total", "completed")))

    runs = parsed.groupBy("run_id", "action").agg(
        F.count("*").alias("n"), newest(start).alias("s"), newest(end).alias("f"), F.max(last).alias("l"))
    use_last = ((F.col("s").isNotNull() & (F.col("n") > 1)) | (F.col("s").isNull() & F.col("f").isNull()))
    step = use_last & F.col("l.t").isNotNull() & F.col("l.e").isin("TABLE_DUMP", "EVENT_DUMP", "TABLE_LOAD",
                                                                    "EVENT_LOAD")
    final_end = F.col("f").isNotNull() & (F.col("s").isNull() | (F.col("f.seq") > F.col("s.seq")))
    return runs.select(
        "run_id", "action",
        F.when(final_end, F.col("f.kind")).otherwise(F.col("s.kind")).alias("kind"),
        F.when(step, F.col("l.t")).when(final_end, F.col("f.total")).otherwise(
            F.coalesce("s.total", F.lit(0))).alias("total"),
        F.when(step, F.col("l.c")).otherwise(F.coalesce("f.completed", F.lit(0))).alias("completed"))


def hive_progress_percent(progress: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run_id, percent): export counts 10, import 90, weighted by the kind of bootstrap.

    ``runs`` is (run_id, dataset_bootstrap, database_bootstrap); without it runs are plain. An export not seen counts in
    full once the import has started; nothing to do counts as done. A run of ``runs`` without any progress is at 90 in
    its database bootstrap, else at 100.
    """

    def figure(action: str, column: str) -> Column:
        return F.max(F.when(F.col("action") == action, F.col(column)))

    wide = progress.groupBy("run_id").agg(
        figure("EXPORT", "total").alias("et"), figure("EXPORT", "completed").alias("ec"),
        figure("IMPORT", "total").alias("it"), figure("IMPORT", "completed").alias("ic"))

    def share(done: str, total: str, weight: float) -> Column:
        part = F.when(F.col(total) == 0, 1.0).otherwise(F.col(done) / F.greatest(total, done))
        return F.least(F.lit(weight), part * weight)

    raw = (F.when(F.col("et").isNull(), EXPORT_SHARE).otherwise(share("ec", "et", EXPORT_SHARE))
           + F.when(F.col("it").isNull(), 0.0).otherwise(share("ic", "it", 100.0 - EXPORT_SHARE)))
    if runs is None:
        return wide.select("run_id", F.least(F.lit(100.0), F.round(raw, 2)).alias("percent"))
    both = runs.join(wide, "run_id", "left")
    seen = F.col("et").isNotNull() | F.col("it").isNotNull()
    first = F.col("dataset_bootstrap") & F.col("database_bootstrap")
    weighted = (F.when(~seen & F.col("database_bootstrap"), BOOTSTRAP_SHARE * 100).when(~seen, 100.0)
                .when(first, raw * BOOTSTRAP_SHARE)
                .when(F.col("dataset_bootstrap"), BOOTSTRAP_SHARE * 100 + raw * (1 - BOOTSTRAP_SHARE))
                .otherwise(raw))
    return both.select("run_id", F.least(F.lit(100.0), F.round(weighted, 2)).alias("percent"))


def transfer_stats(transfers: DataFrame) -> DataFrame:
    """(plugin, direction, bytes) moved so far."""
    return transfers.groupBy("plugin", "direction").agg(F.sum("bytes").alias("bytes"))


def tracking_array(text: Column) -> Column:
    """Tracking text as an array: one object, an array of them, or null when blank or unreadable."""
    trimmed = F.trim(text)
    wrapped = F.when(trimmed.startswith("["), trimmed).otherwise(F.concat(F.lit("["), trimmed, F.lit("]")))
    parsed = F.from_json(F.when(trimmed != "", wrapped), TRACKING, {"mode": "PERMISSIVE"})
    # unreadable text parses to an element without a job id; the parsed text is bound once, as an array's one element
    return F.get(F.transform(F.array(parsed), lambda jobs: F.when(
        F.forall(jobs, lambda m: m.isNotNull() & m["jobId"].isNotNull()), jobs)), 0)


def decode_tracking(instance: DataFrame) -> DataFrame:
    """(id, nth, job_id, job_type, progress fields) per tracked job; a run with blank text gives no rows."""
    # text that is blank or unreadable has no array, and nothing comes out of it
    rows = instance.select("id", F.posexplode(tracking_array(F.col("tracking_info"))).alias("nth", "m"))
    return rows.select("id", "nth", F.col("m.jobId").alias("job_id"), F.col("m.jobType").alias("job_type"),
                       "m.progress.*")


def tracking_rejects(instance: DataFrame) -> DataFrame:
    """(id, tracking_info) of runs whose tracking text cannot be read."""
    filled = instance.where(F.trim("tracking_info") != "")
    return filled.where(tracking_array(F.col("tracking_info")).isNull()).select("id", "tracking_info")


def tracking_update(instance: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """Runs with new progress in their tracking text: updates are (id, job_type, metric as JSON text).

    MAIN replaces everything. RECOVERY becomes the second element, in place of an earlier one; with no text yet it stands
    alone. A run may have several updates: they apply in ``order``, so a RECOVERY before the last MAIN is gone with what it
    belonged to. Without an order MAIN goes first, and updates of one kind that differ are an error.
    """
    def of(kind: str) -> Column:
        counts = F.col("metric").isNotNull() if order is None else F.lit(True)
        place = F.lit(0) if order is None else F.col(order)
        return F.when((F.col("job_type") == kind) & counts, F.struct(place.alias("__order"), "metric"))

    # one aggregation gives both kinds, and the least beside the last tells whether updates without an order agree
    new = updates.groupBy("id").agg(F.max(of("MAIN")).alias("__main"), F.max(of("RECOVERY")).alias("__recovery"),
                                    F.min(of("MAIN")).alias("__main_least"), F.min(of("RECOVERY")).alias("__recovery_least"))
    if order is None:
        clash = F.coalesce((F.col("__main") != F.col("__main_least")) | (F.col("__recovery") != F.col("__recovery_least")), F.lit(False))
        stop = F.raise_error(F.concat(F.lit("updates contradict each other for "), F.col("id").cast("string"))).cast("boolean")
        new = new.where(F.when(clash, stop).otherwise(F.col("__main").isNotNull() | F.col("__recovery").isNotNull()))
    new = new.drop("__main_least", "__recovery_least")
    stands = F.col("__main").isNull() | (F.col("__recovery.__order") >= F.col("__main.__order"))
    both = instance.join(new, "id", "left")
    # named step by step: written as one expression, each use would read the text again
    read = both.withColumns({
        "__old": F.when(F.col("__main").isNull() & F.col("__recovery").isNotNull(), tracking_array(F.col("tracking_info"))),
        "__first": F.from_json("__main.metric", METRIC),
        "__second": F.when(stands, F.from_json("__recovery.metric", METRIC))})
    head = F.when(F.col("__main").isNotNull(), F.array("__first")).otherwise(F.slice("__old", 1, 1))
    text = (F.when(F.col("__second").isNull(), F.coalesce(F.to_json("__first"), F.col("tracking_info")))
            .when(head.isNotNull(), F.to_json(F.concat(head, F.array("__second")))).otherwise(F.to_json("__second")))
    return read.withColumn("tracking_info", text).drop("__main", "__recovery", "__old", "__first", "__second")
