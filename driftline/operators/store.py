"""Queries over policies, runs, events, clusters and credentials.

A row is active while its ``retirement_time`` is null.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import paths, times
from driftline.operators.ancestors import ancestor_join, dataset_conflicts
from driftline.operators.filters import by_columns, filtered, last_values
from driftline.operators.history import policy_report, recent_runs
from driftline.operators.joins import hot_join
from driftline.operators.ordering import latest_per_key, page
from driftline.sources.events import code_table

# Filter field and column of each list query.
POLICY_FILTERS = {"sourcecluster": "source_cluster", "targetcluster": "target_cluster", "name": "name",
                  "type": "type", "status": "status"}
CREDENTIAL_FILTERS = {"name": "name", "provider": "provider", "authtype": "auth_type"}
RUN_FILTERS = ["name", "type", "status", "starttime", "endtime"]
RUN_ORDER = {"status": "status", "starttime": "start_time", "endtime": "end_time"}
EVENT_ORDER = {"policyid": "policy_id", "instanceid": "instance_id", "evententitytype": "entity_type",
               "eventid": "event_code", "eventseverity": "severity", "eventtimestamp": "event_time",
               "eventmessage": "message", "eventinfo": "info"}
# Statuses that take a policy out of, or keep it in, replication.
ENDED = ["SUCCEEDED", "FAILED", "SUCCEEDEDWITHSKIPPED", "FAILEDWITHSKIPPED"]
AT_WORK = ["RUNNING", "SUBMITTED", "SUSPENDED"]


def active(df: DataFrame) -> DataFrame:
    return df.where("retirement_time is null")


def archived(df: DataFrame) -> DataFrame:
    return df.where("retirement_time is not null")


def policies_filtered(policy: DataFrame, filter_by: str | None) -> DataFrame:
    return filtered(active(policy), filter_by, by_columns(POLICY_FILTERS))


def list_policies(policy: DataFrame, filter_by: str | None = None, order_by: str = "name", sort: str = "ASC",
                  offset: int = 0, n: int = 10, cap: int | None = None) -> DataFrame:
    return page(policies_filtered(policy, filter_by), order_by, sort, offset, n, ["id"],
                [*POLICY_FILTERS.values(), "frequency", "id"], cap)


def instances_filtered(policy: DataFrame, instance: DataFrame, filters: str | None = None,
                       retired: bool = False) -> DataFrame:
    """Policy and run joined, both active or both retired; a run keeps its own columns."""
    wanted = last_values(filters, RUN_FILTERS)
    state = archived if retired else active
    owners = state(policy).select(F.col("id").alias("policy_id"), F.col("name").alias("policy_name"),
                                  F.col("type").alias("policy_type"))
    runs = state(instance)
    for field, column in (("name", "policy_name"), ("type", "policy_type")):
        if field in wanted:
            owners = owners.where(F.col(column) == wanted[field])
    if "status" in wanted:
        runs = runs.where(F.col("status") == wanted["status"])
    if "starttime" in wanted:
        runs = runs.where(F.col("start_time") >= times.parse_iso(F.lit(wanted["starttime"])))
    if "endtime" in wanted:
        runs = runs.where(F.col("end_time") <= times.parse_iso(F.lit(wanted["endtime"])))
    return hot_join(runs, owners, ["policy_id"], spread=F.col("id"))


def list_instances(policy: DataFrame, instance: DataFrame, filters: str | None = None, order_by: str = "startTime",
                   sort: str = "DESC", offset: int = 0, n: int = 10, retired: bool = False,
                   policy_name: str | None = None, cap: int | None = None) -> DataFrame:
    """Runs with their policy. ``policy_name`` overrides a name in the filters. Runs are ordered by their own columns."""
    if policy_name is not None:
        filters = ",".join([f for f in (filters or "").split(",") if f] + [f"name:{policy_name}"])
    if order_by.lower() not in RUN_ORDER:
        raise ValueError(f"cannot order runs by {order_by}; use one of {sorted(RUN_ORDER)}")
    found = instances_filtered(policy, instance, filters, retired)
    return page(found, RUN_ORDER[order_by.lower()], sort, offset, n, ["id"], cap=cap)


def list_clusters(cluster: DataFrame, order_by: str = "name", sort: str = "ASC", offset: int = 0, n: int = 10,
                  pair: DataFrame | None = None, prop: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Active clusters, on demand with ``peers`` (sorted names) and ``properties`` (a map)."""
    from driftline.operators.clusters import fold_properties, pairs_of

    found = page(active(cluster), order_by, sort, offset, n, ["name", "version"], cap=cap)
    if pair is not None:
        peers = pairs_of(pair).groupBy("name", "version").agg(F.sort_array(F.collect_set("peer")).alias("peers"))
        found = found.join(peers, ["name", "version"], "left")
    if prop is not None:
        found = fold_properties(found, prop, ["name", "version"])
    return found


def list_credentials(credential: DataFrame, filter_by: str | None = None, order_by: str = "name", sort: str = "ASC",
                     offset: int = 0, n: int = 10, cap: int | None = None) -> DataFrame:
    """Credentials without any secret; they never retire."""
    found = filtered(credential, filter_by, by_columns(CREDENTIAL_FILTERS))
    return page(found, order_by, sort, offset, n, ["id"], [*CREDENTIAL_FILTERS.values(), "creation_time", "id"],
                cap)


def events_between(event: DataFrame, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Inclusive bounds; a bound that is not given does not restrict."""
    if start is not None:
        event = event.where(F.col("event_time") >= times.moment(start))
    if end is not None:
        event = event.where(F.col("event_time") <= times.moment(end))
    return event


def events_filtered(event: DataFrame, policy: DataFrame, by: dict[str, object] | None = None,
                    start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Events chosen by one of: policy_name, event_name, entity_type, instance_id, policy_run (name, number).

    A policy name stands for all policies of that name, retired ones too; a run belongs to the active one.
    """
    by = dict(by or {})
    found = events_between(event, start, end)
    if "policy_name" in by:
        ids = policy.where(F.col("name") == by.pop("policy_name")).select(F.col("id").alias("policy_id"))
        found = hot_join(found, ids.distinct(), ["policy_id"], "left_semi", spread=F.col("id"))
    if "event_name" in by:
        codes = code_table(event.sparkSession).where(F.lower("event_name") == str(by.pop("event_name")).lower())
        # at most 15 rows
        found = found.join(F.broadcast(codes.select("event_code")), "event_code", "left_semi")
    if "entity_type" in by:
        found = found.where(F.col("entity_type") == by.pop("entity_type"))
    if "instance_id" in by:
        found = found.where(F.col("instance_id") == by.pop("instance_id"))
    if "policy_run" in by:
        name, number = by.pop("policy_run")
        ids = active(policy).where(F.col("name") == name).select(
            F.concat("id", F.lit(f"@{number}")).alias("instance_id"))
        found = hot_join(found, ids.distinct(), ["instance_id"], "left_semi", spread=F.col("id"))
    if by:
        raise ValueError(f"unknown event criteria {sorted(by)}")
    return found


def events_query(event: DataFrame, policy: DataFrame, by: dict[str, object] | None = None,
                 start: datetime | None = None, end: datetime | None = None, order_by: str = "eventTimeStamp",
                 sort: str = "DESC", offset: int = 0, n: int = 10, cap: int | None = None) -> DataFrame:
    """One page of events."""
    if order_by.lower() not in EVENT_ORDER:
        raise ValueError(f"cannot order events by {order_by}; use one of {sorted(EVENT_ORDER)}")
    found = events_filtered(event, policy, by, start, end)
    return page(found, EVENT_ORDER[order_by.lower()], sort, offset, n, ["id"], cap=cap)


def total_results(found: DataFrame) -> DataFrame:
    """The count that goes with a page, taken before paging."""
    return found.agg(F.count("*").alias("total"))


def events_result(events: DataFrame) -> DataFrame:
    """Events as users see them: code decoded, both ids hidden for a blank policy id, sync events marked."""
    named = events.join(F.broadcast(code_table(events.sparkSession)), "event_code", "left")
    blank = F.col("policy_id").isNull() | (F.trim("policy_id") == "")
    sync = (F.col("entity_type") == "policy") & (F.get_json_object("info", "$.syncEvent") == "true")
    return named.select(
        "id", F.when(~blank, F.col("policy_id")).alias("policy_id"),
        F.when(~blank, F.col("instance_id")).alias("instance_id"),
        F.col("event_name").alias("event"), F.col("entity_type").alias("event_type"),
        F.col("severity"), F.col("event_time").alias("timestamp"), "message",
        F.coalesce(sync, F.lit(False)).alias("sync_event"))


def sync_event_count(result: DataFrame) -> DataFrame:
    return result.agg(F.count("*").alias("events"),
                      F.coalesce(F.sum(F.col("sync_event").cast("bigint")), F.lit(0)).alias("sync_events"))


def active_pair_policies(policy: DataFrame) -> DataFrame:
    """Policies at work between two clusters, whichever way: (cluster_a, cluster_b, policies), a before b."""
    at_work = active(policy).where(F.col("status").isin(AT_WORK))
    return at_work.groupBy(F.least("source_cluster", "target_cluster").alias("cluster_a"),
                           F.greatest("source_cluster", "target_cluster").alias("cluster_b")
                           ).agg(F.count("*").alias("policies"))


def active_credential_policies(policy: DataFrame, prop: DataFrame, credentials: DataFrame) -> DataFrame:
    """Policies at work per credential id; properties are (owner_id, property, value)."""
    ids = credentials.select(F.col("id").alias("value")).distinct()
    users = hot_join(prop, ids, ["value"]).select(F.col("owner_id").alias("id"), "value").withColumnRenamed(
        "value", "credential_id")
    at_work = active(policy).where(F.col("status").isin(AT_WORK)).select("id")
    return users.join(at_work, "id").groupBy("credential_id").agg(F.count("*").alias("policies"))


def same_source_target(policy: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted_id, policies): how many active policies have a wanted row's source dataset, clusters and type.

    Policies are counted per key first, so each wanted row meets one row however many policies share its key.
    """
    keys = ["source_dataset", "source_cluster", "target_cluster", "type"]
    counts = active(policy).groupBy(*keys).agg(F.count("*").alias("policies"))
    return hot_join(wanted.select("wanted_id", *keys), counts, keys).select("wanted_id", "policies")


def policies_for_type(policy: DataFrame, kind: str) -> DataFrame:
    return active(policy).where((F.col("type") == kind) & ~F.col("status").isin(ENDED))


def archived_policies(policy: DataFrame, name: str, newest: str = "creation_time") -> DataFrame:
    return archived(policy).where(F.col("name") == name).orderBy(F.desc(newest), "id")


def active_entities(df: DataFrame, keys: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """Active rows for the wanted keys, or all; a missing or repeated key is reported by :func:`duplicate_active`."""
    rows = active(df)
    return rows if wanted is None else rows.join(wanted.select(*keys).distinct(), keys, "left_semi")


def duplicate_active(df: DataFrame, keys: list[str], wanted: DataFrame | None = None) -> DataFrame:
    """(keys, active_rows) where the number of active rows is not one: an integrity error."""
    counts = active(df).groupBy(*keys).agg(F.count("*").alias("active_rows"))
    if wanted is None:
        return counts.where("active_rows > 1")
    all_keys = wanted.select(*keys).distinct().join(counts, keys, "left")
    return all_keys.withColumn("active_rows", F.coalesce("active_rows", F.lit(0))).where("active_rows <> 1")


def policies_to_schedule(policy: DataFrame, scheduled: DataFrame, local: str) -> DataFrame:
    """Submitted policies aimed at the local cluster that the scheduler does not know (``scheduled`` has ``id``)."""
    due = active(policy).where((F.col("status") == "SUBMITTED") & (F.col("target_cluster") == local))
    return due.join(scheduled.select("id").distinct(), "id", "left_anti")


def dataset_in_use(policy: DataFrame, datasets: DataFrame) -> DataFrame:
    """(dataset, except_name, policies): how many other running FS policies use the dataset as source or target.

    ``datasets`` is (dataset, except_name): the policy of that name does not count.
    """
    fs = policies_for_type(policy, "FS").select(
        "id", "name", F.explode(F.array_distinct(F.array("source_dataset", "target_dataset"))).alias("dataset"))
    per_name = fs.groupBy("dataset", "name").agg(F.count("*").alias("__own"))
    totals = per_name.groupBy("dataset").agg(F.sum("__own").alias("__all"))
    asked = hot_join(datasets.select("dataset", "except_name"), totals, ["dataset"])
    own = per_name.withColumnRenamed("name", "except_name")
    others = F.col("__all") - F.coalesce("__own", F.lit(0))
    both = hot_join(asked, own, ["dataset", "except_name"], "left")
    return both.select("dataset", "except_name", others.alias("policies")).where("policies > 0")


POLICY_FIELDS = {
    "STATUS": ["status"], "FREQUENCY": ["frequency"], "CLUSTERS": ["source_cluster", "target_cluster"],
    "DATASETS": ["source_dataset", "target_dataset"], "STARTTIME": ["start_time"], "ENDTIME": ["end_time"],
    "EXECUTIONTYPE": ["execution_type"],
}
ALWAYS = ["id", "name", "type", "description", "creation_time"]


def split_tags(tags: Column) -> Column:
    """Comma text to trimmed tags; blank text gives none."""
    parts = F.transform(F.split(tags, ","), lambda t: F.trim(t))
    return F.when(tags.isNull() | (F.trim(tags) == ""), F.array().cast("array<string>")).otherwise(parts)


def policy_view(policy: DataFrame, fields: list[str], instance: DataFrame | None = None,
                prop: DataFrame | None = None, runs: int = 3) -> DataFrame:
    """Policies with the asked columns only, joined with recent runs, report and properties when asked for."""
    from driftline.operators.clusters import fold_properties

    asked = [f.upper() for f in fields]
    known = [*POLICY_FIELDS, "TAGS", "INSTANCES", "REPORT", "CUSTOMPROPERTIES"]
    if unknown := [f for f in asked if f not in known]:
        raise ValueError(f"unknown fields {unknown}; use {known}")
    columns = [c for c in ALWAYS if c in policy.columns]
    for field in asked:
        columns += POLICY_FIELDS.get(field, [])
    view = policy.select(*columns, *([split_tags(F.col("tags")).alias("tags")] if "TAGS" in asked else []))
    if "INSTANCES" in asked:
        view = view.join(recent_runs(instance, runs).withColumnRenamed("policy_id", "id"), "id", "left")
    if "REPORT" in asked:
        view = view.join(policy_report(instance).withColumnRenamed("policy_id", "id"), "id", "left")
    if "CUSTOMPROPERTIES" in asked:
        view = fold_properties(view, prop.withColumnRenamed("owner_id", "id"), ["id"])
    return view


def with_default_target(new: DataFrame) -> DataFrame:
    """Submitted policies whose empty target dataset has become the path of the source."""
    given = F.when(F.trim("target_dataset") != "", F.col("target_dataset"))
    return new.withColumn("target_dataset", F.coalesce(given, paths.uri_path(F.col("source_dataset"))))


def cluster_rules(new: DataFrame, cluster: DataFrame, pair: DataFrame) -> DataFrame:
    """(id, rule) for each rule about clusters that a submitted policy breaks.

    Named clusters must exist (their newest active version counts); two different ones must be paired, and one of those
    named must be the local one. A file policy needs HDFS on the clusters it names.
    """
    from driftline.operators.clusters import pairs_of

    known = newest_version(active(cluster), ["name"]).select("name", "local", "hdfs")
    paired = pairs_of(pair).where("status = 'PAIRED'").select(
        F.col("name").alias("source_cluster"), F.col("peer").alias("target_cluster"), F.lit(True).alias("paired")).distinct()
    both = new.select("id", "type", "source_cluster", "target_cluster")
    for side in ("source", "target"):
        facts = known.select(F.col("name").alias(f"{side}_cluster"), F.lit(True).alias(f"{side}_known"),
                             F.col("local").alias(f"{side}_local"), F.col("hdfs").alias(f"{side}_hdfs"))
        both = both.join(facts, f"{side}_cluster", "left")
    both = both.join(paired, ["source_cluster", "target_cluster"], "left")
    tests = {}
    for side in ("source", "target"):
        named = F.col(f"{side}_cluster").isNotNull()
        tests[f"unknown_{side}_cluster"] = named & F.col(f"{side}_known").isNull()
        tests[f"{side}_without_hdfs"] = (F.col("type") == "FS") & ~F.col(f"{side}_hdfs")
    two = F.col("source_known") & F.col("target_known") & (F.col("source_cluster") != F.col("target_cluster"))
    tests["clusters_not_paired"] = two & F.col("paired").isNull()
    local = F.coalesce("source_local", F.lit(False)) | F.coalesce("target_local", F.lit(False))
    tests["no_local_cluster"] = F.coalesce("source_cluster", "target_cluster").isNotNull() & ~local
    broken = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in tests.items()]))
    return both.select("id", F.explode(broken).alias("rule"))


def validate_policies(new: DataFrame, policy: DataFrame, now: datetime, zones: DataFrame | None = None,
                      min_frequency: int = 60, cluster: DataFrame | None = None,
                      pair: DataFrame | None = None) -> DataFrame:
    """(id, rule) for each rule a submitted policy breaks; with ``cluster`` and ``pair`` also :func:`cluster_rules`.

    ``new`` has id, name, type, source_cluster, target_cluster, source_dataset, target_dataset, frequency, start_time,
    end_time, cloud_credential; ``zones`` are encryption zones (path, key_name).
    """
    moment = times.moment(now)

    def blank(column: str) -> Column:
        return F.col(column).isNull() | (F.trim(F.col(column)) == "")

    fs = F.col("type") == "FS"
    cloud_source, cloud_target = paths.is_cloud(F.col("source_dataset")), paths.is_cloud(F.col("target_dataset"))
    cloud = F.coalesce(cloud_source | cloud_target, F.lit(False))
    rules = {
        "missing_name": blank("name"),
        "missing_type": blank("type"),
        "missing_source_dataset": blank("source_dataset"),
        "missing_frequency": F.col("frequency").isNull(),
        "missing_credential": cloud & blank("cloud_credential"),
        "cloud_to_cloud": cloud_source & cloud_target,
        "one_cluster_with_cloud": fs & ~blank("cloud_credential")
        & (blank("source_cluster") == blank("target_cluster")),
        "missing_source_cluster": fs & blank("cloud_credential") & blank("source_cluster"),
        "missing_target_cluster": fs & blank("cloud_credential") & blank("target_cluster"),
        "frequency_too_low": F.col("frequency") < min_frequency,
        "end_before_start": F.col("end_time") < F.col("start_time"),
        "start_in_past": F.col("start_time") < moment - F.expr("INTERVAL '1' MINUTE"),
        "end_in_past": F.col("end_time") < moment,
        "bad_target_name": (F.col("type") == "HIVE") & ~cloud_target
        & ~F.col("target_dataset").rlike("^[a-zA-Z0-9_]*$"),
    }
    broken = F.array_compact(F.array(*[F.when(test, F.lit(rule)) for rule, test in rules.items()]))
    report = new.select("id", F.explode(broken).alias("rule"))

    def clash(kind: str) -> DataFrame:
        mine = new.where(F.col("type") == kind).select("id", F.col("target_dataset").alias("dataset"))
        theirs = policies_for_type(policy, kind).select(F.col("target_dataset").alias("dataset"))
        hits = dataset_conflicts(mine, theirs, kind).where("conflict").select("dataset")
        return hot_join(mine, hits, ["dataset"], "left_semi").select("id", F.lit("target_in_replication").alias("rule"))

    for kind in ("FS", "HIVE"):
        report = report.unionByName(clash(kind))
    wanted = new.withColumnRenamed("id", "wanted_id")
    same = same_source_target(policy, wanted).select(F.col("wanted_id").alias("id")).distinct()
    report = report.unionByName(same.withColumn("rule", F.lit("source_on_same_target")))
    if cluster is not None and pair is not None:
        report = report.unionByName(cluster_rules(new, cluster, pair))
    if zones is not None:
        report = report.unionByName(encryption_compat(new, zones).where("problem is not null")
                                    .select("id", F.col("problem").alias("rule")))
    return report


def encryption_compat(policy: DataFrame, zones: DataFrame) -> DataFrame:
    """(id, source_key, target_key, encrypt, problem): zones of both datasets and what they forbid.

    A source inside a zone needs an encrypted target: a zone, or on a cloud store an encryption algorithm
    (``cloud_encryption``, if the column is there). A source inside a zone may not be made snapshottable
    (``enable_snapshot``). A target in a zone turns encryption on for the policy. Zones with a ``cluster`` hold on that cluster
    only, which is then the policy's source or target cluster; a dataset on a cloud store lies in no zone.
    """
    both = policy
    for side in ("source", "target"):
        dataset = F.col(f"{side}_dataset")
        placed = both.withColumn("__place", F.when(~paths.is_cloud(dataset), paths.uri_path(dataset)))
        by = (f"{side}_cluster", "cluster") if "cluster" in zones.columns else None
        both = ancestor_join(placed, zones.select("path", "key_name", *(["cluster"] if by else [])), "__place", by=by)
        both = both.withColumnRenamed("zone_key_name", f"{side}_key").drop("zone_path", "zone_cluster", "__place")
    for column, kind in (("cloud_encryption", "string"), ("enable_snapshot", "boolean")):
        if column not in both.columns:
            both = both.withColumn(column, F.lit(None).cast(kind))
    cloud_source, cloud_target = paths.is_cloud(F.col("source_dataset")), paths.is_cloud(F.col("target_dataset"))
    algorithm = F.coalesce(F.upper("cloud_encryption"), F.lit("NONE")) != "NONE"
    source_on = F.when(cloud_source, algorithm).otherwise(F.col("source_key").isNotNull())
    target_on = F.when(cloud_target, algorithm).otherwise(F.col("target_key").isNotNull())
    problem = (F.when(~cloud_source & source_on & F.coalesce("enable_snapshot", F.lit(False)),
                      "encrypted_source_snapshottable")
               .when(source_on & ~target_on, "target_not_encrypted"))
    return both.select("id", "source_key", "target_key", (source_on | target_on).alias("encrypt"),
                       problem.alias("problem"))


def newest_version(df: DataFrame, keys: list[str]) -> DataFrame:
    return latest_per_key(df, keys, [F.desc("version")])
