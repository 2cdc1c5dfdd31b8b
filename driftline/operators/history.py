"""What the runs of a policy say about it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.operators.ordering import latest_per_key

# Run statuses a user may run again.
RERUNNABLE = ["FAILED", "KILLED", "FAILED_ADMIN"]
RUNS_DEFAULT = 3


def status_recent(instance: DataFrame, n: int = 2) -> DataFrame:
    """(policy_id, status, start_time, rank): latest start per status, the newest ``n`` statuses of each policy.

    Runs are reduced to one row per policy and status before anything is ranked. Equal times are ordered by status.
    """
    latest = instance.groupBy("policy_id", "status").agg(F.max("start_time").alias("start_time"))
    return latest_per_key(latest, ["policy_id"], [F.desc("start_time"), F.asc("status")], n, rank="rank")


def policy_report(instance: DataFrame) -> DataFrame:
    """Per policy the last success and the last failure: a failed or killed run, whichever ended later."""
    ended = instance.where("status <> 'RUNNING'")
    return ended.groupBy("policy_id").agg(
        F.max(F.when(F.col("status") == "SUCCESS", F.col("end_time"))).alias("last_succeeded"),
        F.max(F.when(F.col("status").isin("FAILED", "KILLED"), F.col("end_time"))).alias("last_failed"),
        F.max_by(F.when(F.col("status").isin("FAILED", "KILLED"), F.col("status")),
                 F.when(F.col("status").isin("FAILED", "KILLED"),
                        F.struct(F.col("end_time"), F.col("status") == "FAILED"))).alias("last_failed_status"),
    )


def final_status(instance: DataFrame) -> DataFrame:
    """(policy_id, final_status) from the two newest statuses."""
    two = status_recent(instance, 2).groupBy("policy_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("status"))).alias("first"),
        F.max(F.when(F.col("rank") == 2, F.col("status"))).alias("second"))
    first, second = F.col("first"), F.col("second")
    skipped = first == "SKIPPED"
    verdict = (F.when(first == "SUCCESS", "SUCCEEDED")
               .when((first == "FAILED_ADMIN") | (skipped & (second == "FAILED_ADMIN")), "SUSPENDEDFORINTERVENTION")
               .when(first.isin("FAILED", "KILLED"), "FAILED")
               .when(skipped & (second == "SUCCESS"), "SUCCEEDEDWITHSKIPPED")
               .when(skipped & second.isin("FAILED", "KILLED"), "FAILEDWITHSKIPPED")
               .otherwise("FAILED"))
    return two.select("policy_id", verdict.alias("final_status"))


def recent_runs(instance: DataFrame, k: int = RUNS_DEFAULT, most: int | None = None) -> DataFrame:
    """(policy_id, runs): the latest ``k`` runs of each policy, newest first, as an array."""
    kept = recent_run_rows(instance, k, most)
    return kept.groupBy("policy_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "id", "status", "start_time", "end_time"))),
                    lambda r: r.dropFields("rank")).alias("runs"))


def recent_run_rows(instance: DataFrame, k: int = RUNS_DEFAULT, most: int | None = None) -> DataFrame:
    """The same as rows with ``rank``. More than ``most``, the caller's own limit if there is one, is an error."""
    if k < 1 or (most is not None and k > most):
        raise ValueError(f"cannot show {k} runs of a policy" + (f"; at most {most}" if most is not None else ""))
    return latest_per_key(instance, ["policy_id"], [F.desc("start_time"), F.asc("id")], k, rank="rank")


def last_failed(instance: DataFrame, status: str = "FAILED") -> DataFrame:
    """Newest run of the given status per policy."""
    return latest_per_key(instance.where(F.col("status") == status), ["policy_id"],
                          [F.desc("end_time"), F.asc("id")])


def rerunnable(instance: DataFrame) -> DataFrame:
    """Latest run per policy that was not skipped, if a user may run it again."""
    latest = latest_per_key(instance.where("status <> 'SKIPPED'"), ["policy_id"],
                            [F.desc("start_time"), F.asc("id")])
    return latest.where(F.col("status").isin(RERUNNABLE)).select("policy_id", "id", "current_offset", "status")


def interrupted(instance: DataFrame) -> DataFrame:
    """Active runs that a restart cut off; they resume from their offset."""
    return instance.where("status = 'RUNNING' and retirement_time is null").select("id", "policy_id", "current_offset")


def last_finished(instance: DataFrame) -> DataFrame:
    """(policy_id, last_status) of the newest finished run."""
    return (instance.where("end_time is not null").groupBy("policy_id")
            .agg(F.max_by("status", F.struct("end_time", "id")).alias("last_status")))


def next_step(job: DataFrame) -> DataFrame:
    """(order_key, next_offset): the step after the last stored one."""
    return job.groupBy("order_key").agg((F.max("job_offset") + 1).alias("next_offset"))
