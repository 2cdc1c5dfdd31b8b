"""Rewriting of access policies and metadata entities for another place."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions import paths
from driftline.functions.times import format_iso, moment
from driftline.operators.joins import hot_join
from driftline.sources.access_policies import RESOURCE_OF

# Accesses denied to everyone, and allowed again to the copying user, per dataset kind.
DENIED = {"FS": ["write"], "HIVE": ["create", "update", "drop", "alter", "index", "lock", "write"]}
EXEMPT = {"FS": ["read", "write", "execute"],
          "HIVE": ["create", "update", "drop", "alter", "index", "lock", "write", "select", "read"]}
EVERYONE = "public"


def _clean(dataset: Column) -> Column:
    return F.regexp_replace(dataset, "/+$", "")


def single_resource(policies: DataFrame, kind: str) -> DataFrame:
    """Policies whose dataset resource has exactly one value."""
    return policies.where(F.size(F.col("resources")[RESOURCE_OF[kind]]["values"]) == 1)


def rehome_policies(policies: DataFrame, mapping: DataFrame | tuple[str, str], kind: str) -> DataFrame:
    """Replace the source dataset by the target one in the dataset resource.

    Paths change by plain prefix (``/a`` also changes ``/ab``), database names when equal. ``mapping`` is one
    (source, target) pair, or a DataFrame (service, source, target) with at most one row per service.
    """
    if isinstance(mapping, tuple):
        rows = policies.withColumns({"__s": F.lit(mapping[0]), "__t": F.lit(mapping[1])})
    else:
        pairs = mapping.select("service", F.col("source").alias("__s"), F.col("target").alias("__t"))
        rows = hot_join(policies, pairs, ["service"], "left")
    source, target = _clean(F.col("__s")), _clean(F.col("__t"))

    def moved(value: Column) -> Column:
        if kind == "FS":
            return F.when(value.startswith(source), F.concat(target, value.substr(F.length(source) + 1,
                                                                                  F.length(value)))).otherwise(value)
        return F.when(value == source, target).otherwise(value)

    def resource(key: Column, held: Column) -> Column:
        changed = held.withField("values", F.transform(held["values"], moved))
        return F.when((key == RESOURCE_OF[kind]) & held["values"].isNotNull(), changed).otherwise(held)

    return rows.withColumn("resources", F.transform_values("resources", resource)).drop("__s", "__t")


def describe_imports(policies: DataFrame, source: Column, at: datetime, user: str = "replication") -> DataFrame:
    """Put name, source and date into the description."""
    when = format_iso(moment(at))
    text = F.concat(F.col("name"), F.lit(f" created by {user} while importing from "), source, F.lit(" on "), when)
    return policies.withColumn("description", text)


def deny_policies(datasets: DataFrame, kind: str, at: datetime, user: str = "replication") -> DataFrame:
    """One policy per dataset (service, source_cluster, source_dataset, target_dataset) that has a service.

    Everyone is denied writing, the copying user is exempt. The resource is the dataset and a dummy, recursive for paths;
    for databases all tables and columns.
    """
    rows = datasets.where(F.col("service").isNotNull() & (F.col("service") != ""))
    when = format_iso(moment(at))
    source, target = _clean(F.col("source_dataset")), _clean(F.col("target_dataset"))

    def resource(values: Column, recursive: bool) -> Column:
        return F.struct(values.alias("values"), F.lit(False).alias("isExcludes"), F.lit(recursive).alias("isRecursive"))

    def item(accesses: list[str], users: list[str], groups: list[str]) -> Column:
        none = F.array().cast("array<string>")
        return F.array(F.struct(
            F.array(*[F.struct(F.lit(a).alias("type"), F.lit(True).alias("isAllowed")) for a in accesses]
                    ).alias("accesses"),
            (F.array(*map(F.lit, users)) if users else none).alias("users"),
            (F.array(*map(F.lit, groups)) if groups else none).alias("groups"),
            F.array().cast("array<struct<type:string,values:array<string>>>").alias("conditions"),
            F.lit(False).alias("delegateAdmin")))

    everything = resource(F.array(F.lit("*")), False)
    if kind == "FS":
        resources = F.create_map(F.lit("path"), resource(F.array(source, F.lit("/dummy")), True))
    else:
        resources = F.create_map(
            F.lit("database"), resource(F.array(source, F.lit("dummy")), False),
            F.lit("table"), everything, F.lit("column"), everything)
    cluster = F.coalesce("source_cluster", F.lit("source"))
    return rows.select(
        "service",
        F.concat(cluster, F.lit(f"_{user} deny policy for "), target).alias("name"),
        F.concat(F.lit(f"Deny policy created by {user} while importing from "), cluster, F.lit(" on "),
                 when).alias("description"),
        resources.alias("resources"),
        item(DENIED[kind], [], [EVERYONE]).alias("denyPolicyItems"),
        item(EXEMPT[kind], [user], []).alias("denyExceptions"))


def add_deny_policies(policies: DataFrame, datasets: DataFrame, kind: str, at: datetime,
                      user: str = "replication") -> DataFrame:
    return policies.unionByName(deny_policies(datasets, kind, at, user), allowMissingColumns=True)


# Entity type that carries each kind of dataset.
ENTITY_TYPE = {"FS": "hdfs_path", "HIVE": "hive_db"}


def build_rules(kind: str, source_cluster: str, target_cluster: str, source_dataset: str, target_dataset: str,
                source_endpoint: str = "", target_endpoint: str = "", source_name: str | None = None) -> list[dict]:
    """Attribute rules for a dataset: each has conditions and actions, ``type.attribute`` to ``VERB: argument``."""

    def place(endpoint: str, dataset: str) -> str:
        return (endpoint + dataset).rstrip("/") + "/"

    def prefix_rule(attribute: str, old: str, new: str) -> dict:
        return {"conditions": {attribute: f"STARTS_WITH_IGNORE_CASE: {old}"},
                "actions": {attribute: f"REPLACE_PREFIX: = :{old}={new}"}}

    tag = (source_name or source_cluster).replace("-", "_").replace(" ", "_") + "_replicated"
    cluster = f"{ENTITY_TYPE[kind]}.clusterName"
    rules = [
        {"conditions": {"__entity": "topLevel: "}, "actions": {"__entity": f"ADD_CLASSIFICATION: {tag}"}},
        {"conditions": {}, "actions": {"__entity.replicatedTo": "CLEAR:", "__entity.replicatedFrom": "CLEAR:"}},
        {"conditions": {cluster: f"EQUALS: {source_cluster}"}, "actions": {cluster: f"SET: {target_cluster}"}},
    ]
    if kind == "FS":
        rules.append(prefix_rule("hdfs_path.name", place(source_endpoint, source_dataset),
                                 place(target_endpoint, target_dataset)))
        return rules
    if source_dataset != target_dataset:
        rules.append({"conditions": {"hive_db.name": f"EQUALS: {source_dataset}"},
                      "actions": {"hive_db.name": f"SET: {target_dataset}"}})
    return rules + [prefix_rule(attribute, source_endpoint, target_endpoint)
                    for attribute in ("hive_db.location", "hive_storagedesc.location")]


def _verb(text: str) -> tuple[str, str]:
    word, _, argument = text.partition(":")
    return word.strip(), argument.strip()


def apply_entity_transforms(entities: DataFrame, rules: list[dict]) -> DataFrame:
    """Entities (type, top_level, attributes map<string,string>, classifications array<string>) after the rules, in order.

    All conditions of a rule must hold. ``__entity`` speaks of the entity itself: ``topLevel``, classifications, and
    attributes of entities of any type.
    """
    columns = set(entities.columns)

    def scope(lhs: str) -> tuple[Column, str]:
        kind, _, attribute = lhs.rpartition(".")
        return (F.lit(True) if kind == "__entity" else F.col("type") == kind), attribute

    def without(attribute: str) -> Column:
        return F.map_filter("attributes", lambda k, _: k != attribute)

    for rule in rules:
        holds = F.lit(True)
        for lhs, text in rule["conditions"].items():
            verb, argument = _verb(text)
            if verb == "topLevel":
                holds = holds & F.col("top_level")
                continue
            typed, attribute = scope(lhs)
            value = F.col("attributes")[attribute]
            if verb == "EQUALS":
                test = value == argument
            elif verb == "STARTS_WITH_IGNORE_CASE":
                test = F.lower(value).startswith(argument.lower())
            else:
                raise ValueError(f"unknown condition {text}")
            holds = holds & typed & F.coalesce(test, F.lit(False))
        for lhs, text in rule["actions"].items():
            verb, argument = _verb(text)
            if verb == "ADD_CLASSIFICATION":
                tags = F.array_union(F.coalesce("classifications", F.array().cast("array<string>")),
                                     F.array(F.lit(argument)))
                entities = entities.withColumn("classifications", F.when(holds, tags).otherwise(
                    F.col("classifications")))
                continue
            typed, attribute = scope(lhs)
            value = F.col("attributes")[attribute]
            if verb == "CLEAR":
                changed = without(attribute)
            else:
                if verb == "SET":
                    new = F.lit(argument)
                elif verb == "REPLACE_PREFIX":
                    # written as "<separator> :<old><separator><new>", the separator being one character
                    separator = argument[0]
                    old, _, put = argument.partition(":")[2].partition(separator)
                    new = F.concat(F.lit(put), value.substr(F.lit(len(old) + 1), F.length(value)))
                else:
                    raise ValueError(f"unknown action {text}")
                put_one = F.create_map(F.lit(attribute), new)
                changed = F.when(value.isNotNull() | F.lit(verb == "SET"),
                                 F.map_concat(without(attribute), put_one)).otherwise(
                    F.col("attributes"))
            entities = entities.withColumn("attributes", F.when(holds & typed, changed).otherwise(
                F.col("attributes")))
    return entities.select(*[c for c in entities.columns if c in columns])


def rules_table(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules as rows, in order, for keeping them beside the data."""
    rows = [(n, r["conditions"], r["actions"]) for n, r in enumerate(rules)]
    return spark.createDataFrame(rows, "nth int, conditions map<string,string>, actions map<string,string>")


def changed_entities(entities: DataFrame, markers: DataFrame, datasets: DataFrame) -> DataFrame:
    """(dataset_id, guid) of entities changed since the target's last marker.

    ``entities`` are (guid, type, name, qualified_name, updated); ``datasets`` (dataset_id, kind, cluster, dataset,
    endpoint); ``markers`` (dataset_id, marker). A dataset without a marker takes everything. Paths match by prefix with a
    trailing slash, databases by ``db@cluster``.
    """
    since = datasets.join(markers.select("dataset_id", "marker"), "dataset_id", "left").withColumn(
        "marker", F.coalesce("marker", F.lit(0)))
    databases = since.where("kind = 'HIVE'").select(
        "dataset_id", "marker", paths.database_at_cluster(F.col("dataset"), F.col("cluster")).alias("qualified_name"))
    hive = hot_join(entities.where("type = 'hive_db'"), databases, ["qualified_name"], spread=F.col("guid"))
    places = since.where("kind = 'FS'").select(
        "dataset_id", "marker",
        paths.strip_slash(F.concat(F.coalesce("endpoint", F.lit("")), "dataset")).alias("__prefix"))
    # an entity has few prefixes, a dataset may have very many entities: prefixes are joined by equality and salted.
    # The match is on "prefix/", so an entity named like the dataset itself, without the slash, is not in it.
    inner = entities.where("type = 'hdfs_path'").select(
        "guid", "updated", F.explode(paths.prefixes(F.col("name"), include_self=False)).alias("__prefix"))
    slashed = entities.where("type = 'hdfs_path' and name like '%/'").select(
        "guid", "updated", paths.strip_slash(F.col("name")).alias("__prefix"))
    fs = hot_join(inner.unionByName(slashed).distinct(), places, ["__prefix"], spread=F.col("guid"))
    both = hive.select("dataset_id", "guid", "updated", "marker").unionByName(
        fs.select("dataset_id", "guid", "updated", "marker"))
    return both.where("updated > marker").select("dataset_id", "guid").distinct()
