"""Changes to stored tables: each returns the table as it is afterwards."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.times import moment
from driftline.operators.joins import hot_join
from driftline.operators.ordering import fold, latest_per_key, numbered, placed
from driftline.operators.pointers import reached
from driftline.sources.scratch import written

# Statuses that end a policy.
COMPLETED = ["SUCCEEDED", "FAILED", "SUCCEEDEDWITHSKIPPED", "FAILEDWITHSKIPPED", "SUSPENDEDFORINTERVENTION"]


def next_versions(new: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``version`` and ``conflict`` to new entities of a ``name``.

    A name continues from its latest version; it conflicts if that one is neither retired nor complete. Several new rows
    of one name are numbered in ``order``.
    """
    latest = latest_per_key(existing, ["name"], [F.desc("version")]).select(
        "name", F.col("version").alias("__latest"),
        (F.col("retirement_time").isNull() & ~F.col("status").isin(COMPLETED)).alias("__open"))
    counted = numbered(new, ["name"], order, "__nth")
    both = hot_join(counted, latest, ["name"], "left")
    # of several new rows only the first finds the old one complete: the others meet its open successor
    conflict = F.coalesce("__open", F.lit(False)) | (F.col("__nth") > 1)
    version = (F.coalesce("__latest", F.lit(0)) + F.col("__nth")).cast("int")
    return both.withColumn("conflict", conflict).withColumn("version", F.when(~F.col("conflict"), version)).drop(
        "__latest", "__open", "__nth")


def incremental_export(changes: DataFrame, last_id: int) -> tuple[DataFrame, int]:
    """Rows after the last replicated id and the new id; an id that is not positive asks for all rows."""
    rows = changes if last_id <= 0 else changes.where(F.col("change_id") > last_id)
    newest = rows.agg(F.max("change_id").alias("id")).first()["id"]
    return rows, last_id if newest is None else newest


def incremental_load(target: DataFrame, changes: DataFrame, keys: list[str], loaded_id: int = 0) -> DataFrame:
    """The target after the changes: the last change per key wins, DELETE removes.

    Changes up to ``loaded_id`` have been applied before and do nothing.
    """
    values = [c for c in target.columns if c not in keys]
    fresh = changes.where(F.col("change_id") > loaded_id)
    final = latest_per_key(fresh, keys, [F.desc("change_id")]).select(
        *keys, F.col("op").alias("__op"), *[F.col(c).alias(f"__{c}") for c in values])
    both = target.join(final, keys, "full_outer")
    return both.where("__op is null or __op <> 'DELETE'").select(
        *keys, *[F.when(F.col("__op").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in values])


def retention_purge(policy: DataFrame, prop: DataFrame, instance: DataFrame, job: DataFrame, now: datetime,
                    days: int) -> dict[str, DataFrame]:
    """What is kept once policies retired more than ``days`` ago are gone with their properties, runs and jobs.

    Runs and jobs go with their parent whatever their own retirement time. Events stay.
    """
    limit = moment(now - timedelta(days=days))
    old = policy.where(F.col("retirement_time") < limit).select(F.col("id").alias("policy_id"))
    runs_gone = hot_join(instance, old, ["policy_id"], "left_semi", spread=F.col("id"))
    return {
        "policy": policy.where(F.col("retirement_time").isNull() | (F.col("retirement_time") >= limit)),
        "property": hot_join(prop, old.withColumnRenamed("policy_id", "owner_id"), ["owner_id"], "left_anti"),
        "policy_instance": hot_join(instance, old, ["policy_id"], "left_anti", spread=F.col("id")),
        "instance_job": hot_join(job, runs_gone.select("order_key"), ["order_key"], "left_anti"),
    }


def purge_rows(df: DataFrame, before: datetime) -> DataFrame:
    """What is kept of a table when each row goes by its own retirement time."""
    limit = moment(before)
    return df.where(F.col("retirement_time").isNull() | (F.col("retirement_time") >= limit))


def soft_delete(policy: DataFrame, instance: DataFrame, job: DataFrame, names: DataFrame, at: datetime,
                status: str = "DELETED") -> dict[str, DataFrame]:
    """Retire the active policies of the given names with their active runs and jobs."""
    when = moment(at)
    hit = policy.join(names.select("name").distinct(), "name", "left_semi").where("retirement_time is null")
    ids = hit.select(F.col("id").alias("policy_id"), F.lit(True).alias("__hit"))

    def close(df: DataFrame, marks: DataFrame, on: str, with_status: bool) -> DataFrame:
        # a policy is one row, but may have very many runs and jobs
        marked = df.join(marks, on, "left") if on == "id" else hot_join(df, marks, [on], "left")
        due = F.col("__hit").isNotNull() & F.col("retirement_time").isNull()
        values = {"retirement_time": F.when(due, when).otherwise(F.col("retirement_time"))}
        if with_status:
            values["status"] = F.when(due, F.lit(status)).otherwise(F.col("status"))
        return marked.withColumns(values).select(*df.columns)

    runs = hot_join(instance.where("retirement_time is null"), ids, ["policy_id"], "left_semi").select(
        "order_key", F.lit(True).alias("__hit"))
    return {
        "policy": close(policy, ids.withColumnRenamed("policy_id", "id"), "id", True),
        "policy_instance": close(instance, ids, "policy_id", False),
        "instance_job": close(job, runs, "order_key", False),
    }


def retire(df: DataFrame, wanted: DataFrame, keys: list[str], at: datetime) -> DataFrame:
    """Retire the active rows of the wanted keys, as when a cluster is deleted."""
    marks = wanted.select(*keys).distinct().withColumn("__hit", F.lit(True))
    due = F.col("__hit").isNotNull() & F.col("retirement_time").isNull()
    return df.join(marks, keys, "left").withColumn(
        "retirement_time", F.when(due, moment(at)).otherwise(F.col("retirement_time"))).select(*df.columns)


def folded_updates(updates: DataFrame, keys: list[str], columns: list[str], order: str | None = None) -> DataFrame:
    """One row per key; see :func:`apply_updates`."""
    if order is not None:
        # among equal orders the greatest value, so that the result does not depend on how rows are dealt
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c) for c in columns]
        return updates.groupBy(*keys).agg(*last or [F.lit(True).alias("__any")])
    same = updates.groupBy(*keys).agg(
        *[F.min(c).alias(c) for c in columns], *[F.max(c).alias(f"__max_{c}") for c in columns], F.count("*").alias("__n"))
    clash = F.lit(False)
    for c in columns:
        clash = clash | (F.col(c) != F.col(f"__max_{c}"))
    name = F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])
    stop = F.raise_error(F.concat(F.lit("updates contradict each other for "), name)).cast("boolean")
    # the count is read so that the check is not optimised away
    return same.where(F.when(F.coalesce(clash, F.lit(False)), stop).otherwise(F.col("__n") > 0)).select(*keys, *columns)


def apply_updates(table: DataFrame, updates: DataFrame, keys: list[str], increment: list[str] | None = None,
                  clear: list[str] | None = None, only: Column | None = None, hot: bool = False,
                  order: str | None = None) -> DataFrame:
    """Bulk update: non-null values of ``updates`` replace those of ``table``.

    Columns in ``increment`` go up by one, those in ``clear`` become null, once per row however many updates its key has.
    ``only`` restricts the rows that may change, as in "jobs that have not ended". Several updates of a key are folded to
    one: per column the last value in ``order`` that is not null. Without an ``order``, updates of one key that differ in a
    column are an error, since nothing says which is right. ``hot`` tells that ``table`` may have very many rows of one
    key, as jobs of a run.
    """
    changed = [c for c in updates.columns if c not in keys and c != order]
    if unknown := set(changed) - set(table.columns):
        raise ValueError(f"no such columns: {sorted(unknown)}")
    new = folded_updates(updates, keys, changed, order).select(
        *keys, *[F.col(c).alias(f"__{c}") for c in changed], F.lit(True).alias("__hit"))
    both = hot_join(table, new, keys, "left") if hot else table.join(new, keys, "left")
    hit = F.col("__hit").isNotNull()
    if only is not None:
        hit = hit & F.coalesce(only, F.lit(False))
    values = {}
    for c in changed:
        values[c] = F.when(hit & F.col(f"__{c}").isNotNull(), F.col(f"__{c}")).otherwise(F.col(c))
    for c in increment or []:
        values[c] = F.when(hit, F.col(c) + 1).otherwise(F.col(c))
    for c in clear or []:
        values[c] = F.when(~hit, F.col(c))
    return both.select(*[values[c].alias(c) if c in values else F.col(c) for c in table.columns])


def rerun(instance: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen runs (``id``) run again: status RUNNING, no end, one more run."""
    updates = chosen.select("id").distinct().withColumn("status", F.lit("RUNNING"))
    return apply_updates(instance, updates, ["id"], increment=["run_count"], clear=["end_time"])


def recover_interrupted(policy: DataFrame, instance: DataFrame, unresumed: DataFrame, at: datetime) -> DataFrame:
    """The runs after those that could not be resumed (``id``) are closed.

    If the policy was deleted, the run takes its status and retirement; otherwise it is KILLED, ended and retired now.
    """
    when = moment(at)
    owners = policy.select(F.col("id").alias("policy_id"), F.col("status").alias("p_status"),
                           F.col("retirement_time").alias("p_retired"))
    open_runs = instance.join(unresumed.select("id").distinct(), "id", "left_semi")
    closed = hot_join(open_runs, owners, ["policy_id"], spread=F.col("id"))
    gone = F.col("p_status") == "DELETED"
    updates = closed.select(
        "id", F.when(gone, F.lit("DELETED")).otherwise(F.lit("KILLED")).alias("status"),
        when.alias("end_time"),
        F.when(gone, F.col("p_retired")).otherwise(when).alias("retirement_time"))
    return apply_updates(instance, updates, ["id"])


def accepted_runs(runs: DataFrame) -> DataFrame:
    """The rows (``__row``) of ended runs that run, when a run is skipped while one that runs is still going.

    ``runs`` are written, with ``__row`` unique. After a run that runs, the next one that does is the first that starts at
    or after its end. Starts and ends laid out in one order give each run that successor by counting starts. A run that
    starts when all earlier ones have ended runs whatever came before; from these heads the successors are followed by
    pointer doubling, so a stretch of overlapping runs is spread over all tasks however long it is.
    """
    starts = runs.select("policy_id", F.col("start_time").alias("__at"), F.lit(1).alias("__kind"), "id", "__row", "end_time")
    ends = runs.select("policy_id", F.col("end_time").alias("__at"), F.lit(0).alias("__kind"), "id", "__row",
                       F.lit(None).cast(runs.schema["end_time"].dataType).alias("end_time"))
    order = ["__at", "__kind", "id", "__row"]
    line = fold(placed(starts.union(ends), ["policy_id"], order), ["policy_id"], order, {
        "__before": ("sum", F.col("__kind").cast("bigint")), "__reach": ("max", F.col("end_time"))}, inclusive=False)
    after = line.where("__kind = 0").select("__row", (F.col("__before") + 1).alias("__after"))
    numbers = line.where("__kind = 1").select(
        "__row", "policy_id", (F.col("__before") + 1).alias("__rank"),
        F.coalesce(F.col("__at") >= F.col("__reach"), F.lit(True)).alias("__head"))
    # a run that ends when it starts, or before, is followed by the next one
    nodes = written(numbers.join(after, "__row").withColumn("__next", F.greatest(F.col("__rank") + 1, "__after")), "runs")
    heads = nodes.where("__head").select(F.col("__row").alias("node"))
    others = nodes.where("not __head").select("policy_id", F.col("__rank").alias("__next"), F.col("__row").alias("next"))
    pointers = nodes.select("policy_id", "__next", F.col("__row").alias("node")).join(others, ["policy_id", "__next"])
    return reached(heads, pointers).select(F.col("node").alias("__row"))


def mark_overlaps(instance: DataFrame) -> DataFrame:
    """Adds ``blocked_by`` and ``overlap_status``: SKIPPED for a run that starts while an earlier one is still going.

    Runs that are skipped block nothing. A run without an end is still going and blocks all later ones; one without a start
    neither blocks nor is blocked. Runs that start together count in the order of their ids. No task holds the runs of a
    policy, nor those of a stretch in which runs overlap (:func:`accepted_runs`).
    """
    columns = ["policy_id", "id", "start_time", "end_time"]
    runs = written(instance.select(*columns, F.monotonically_increasing_id().alias("__row")), "instance")
    started = runs.where("start_time is not null")
    accepted = accepted_runs(started.where("end_time is not null")).withColumn("__runs", F.lit(True))
    order = ["start_time", "id", "__row"]
    timeline = placed(started.join(accepted, "__row", "left"), ["policy_id"], order)
    # accepted runs do not overlap, so the one that ends last among those before decides
    before = written(fold(timeline, ["policy_id"], order, {
        "__busy": ("max", F.when(F.col("__runs"), F.struct("end_time", "id")))}, inclusive=False), "busy")
    busy = F.coalesce(F.col("__busy.end_time") > F.col("start_time"), F.lit(False))
    # runs that have not ended: the first that no ended run blocks goes on, and everything after it is skipped
    stop = (before.where(F.col("end_time").isNull() & ~busy).groupBy("policy_id")
            .agg(F.min(F.struct("start_time", "id")).alias("__stop")))
    both = hot_join(before, stop, ["policy_id"], "left", spread=F.col("__row"))
    late = F.coalesce(F.struct("start_time", "id") > F.col("__stop"), F.lit(False))
    blocked = F.when(late, F.col("__stop.id")).when(F.col("__runs").isNull() & busy, F.col("__busy.id"))
    unstarted = runs.where("start_time is null").select(*columns, F.lit(None).cast(runs.schema["id"].dataType).alias("blocked_by"))
    return both.select(*columns, blocked.alias("blocked_by")).union(unstarted).withColumn(
        "overlap_status", F.when(F.col("blocked_by").isNotNull(), "SKIPPED").otherwise("RUN"))


def next_retry(failed: DataFrame, policy: DataFrame, default_delay: int = 30) -> DataFrame:
    """Adds ``retry_at``: the end of a failed run plus delay * 2^(run_count - 1) seconds, null once attempts are used up.

    ``policy`` has id, retry_attempts and retry_delay (seconds; the default replaces one that is not positive).
    """
    rules = policy.select(F.col("id").alias("policy_id"), "retry_attempts", "retry_delay")
    both = hot_join(failed, rules, ["policy_id"], spread=F.col("id"))
    delay = F.when(F.col("retry_delay") > 0, F.col("retry_delay")).otherwise(F.lit(default_delay))
    wait = F.floor(F.pow(F.lit(2.0), F.col("run_count") - 1)) * delay
    step = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), wait.cast("decimal(18,6)"))
    due = F.when(F.col("run_count") < F.col("retry_attempts"), F.col("end_time") + step)
    return both.withColumn("retry_at", due).drop("retry_attempts", "retry_delay")


def apply_entity_changes(entity: DataFrame, edits: DataFrame, key: str, at: datetime | None = None) -> DataFrame:
    """Active entities after edits: non-null fields replace, ``change_id`` goes up by one."""
    only = F.col("retirement_time").isNull() if "retirement_time" in entity.columns else None
    if at is not None and "last_modified_time" in entity.columns:
        edits = edits.withColumn("last_modified_time", moment(at))
    counted = ["change_id"] if "change_id" in entity.columns else []
    return apply_updates(entity, edits, [key], increment=counted, only=only)


def apply_property_changes(stored: DataFrame, diff: DataFrame, keys: list[str]) -> DataFrame:
    """Properties after a diff of them: updates and inserts take the new value, deletes go."""
    return diff.where("action <> 'delete'").select(
        *keys, F.when(F.col("action") == "keep", F.col("old_value")).otherwise(F.col("value")).alias("value"))
