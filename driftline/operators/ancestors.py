"""Joins between paths and the paths that contain them.

Paths are laid out in an order in which all that a path contains follows it directly. Zones then are intervals that open
and close, and what contains a path is told by the last zone that opened or closed before it: a join by order
(:mod:`driftline.operators.ordered`), for which no path is repeated, whatever its depth. Only zones, the small side, are
looked up by their prefixes, to find what a zone lies in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import paths
from driftline.operators.ordered import last_event
from driftline.sources.scratch import written

#: stands behind all that a path contains, and before all that comes after it
CLOSED = "\x01"


def path_order(path: Column) -> Column:
    """A string whose order puts what a path contains directly behind it; the root's
    (and that of an empty path) is empty, a trailing slash is nothing."""
    # a slash comes before all letters that a name may have
    return F.replace(F.rtrim(path, F.lit("/")), F.lit("/"), F.lit("\0"))


def nested(zones: DataFrame, path: str, by: str | None = None) -> DataFrame:
    """(inner, outer): all pairs of the distinct paths of ``zones`` of which one lies in the other; equal in ``by``, if given."""
    keys = [path] if by is None else [path, by]
    known = zones.select(*keys).where(F.col(path).isNotNull()).distinct()
    same = F.when(path_order(F.col(path)) == "", "/").otherwise(paths.strip_slash(F.col(path)))
    inner = known.select(F.col(path).alias("inner"), *keys[1:], F.explode(paths.prefixes(F.col(path), False)).alias("__prefix"))
    outer = known.select(F.col(path).alias("outer"), *keys[1:], same.alias("__prefix"))
    return inner.join(outer, ["__prefix", *keys[1:]]).drop("__prefix")


def containing(df: DataFrame, zones: DataFrame, path: str, zone: str, pick: str = "shallowest",
               include_self: bool | Column = True, how: str = "inner", by: tuple[str, str] | None = None) -> DataFrame:
    """Rows of ``df`` with the columns of the shallowest or deepest zone that contains their path.

    With ``how="left"`` rows without a zone stay. Whole segments are compared and a trailing slash makes no difference.
    ``include_self`` says, also per row, whether a zone may be the path itself. ``by`` names a column of ``df`` and one of
    ``zones`` that must be equal, too, as the cluster that both are on. A row without a path, or a null ``by``, has no zone.
    Of several zones of one path one is taken. Rows of one path come into one task, so a path that very many rows have is
    better joined once (see :func:`ancestor_join`).
    """
    def order(p: Column, b: str | None) -> Column:
        # letters and digits only, then a space: nothing of one group comes between paths of another
        return path_order(p) if b is None else F.concat(F.hex(F.encode(F.col(b).cast("string"), "utf-8")), F.lit(" "), path_order(p))

    ours, theirs = (None, None) if by is None else by
    value = F.struct(*[F.col(c) for c in zones.columns])
    one = zones.withColumn("__order", order(F.col(zone), theirs)).where(F.col("__order").isNotNull()).groupBy("__order").agg(
        F.min_by(value, F.to_json(value)).alias("__zone"))
    one = written(one.select("*", F.col(f"__zone.{zone}").alias("__path"), *([F.col(f"__zone.{theirs}").alias("__by")] if by else [])), "zones")
    group = [] if by is None else ["__by"]
    pairs = nested(one, "__path", "__by" if by else None)
    if pick == "shallowest":
        # only outermost zones count, and nothing is left when one closes
        inner = pairs.select(F.col("inner").alias("__path"), *group).distinct()
        opened = one.join(inner, ["__path", *group], "left_anti").withColumn("__outer", F.lit(None).cast(one.schema["__zone"].dataType))
    else:
        near = pairs.groupBy("inner", *group).agg(F.max_by("outer", F.length(path_order(F.col("outer")))).alias("__near")).withColumnRenamed("inner", "__path")
        outer = one.select(F.col("__path").alias("__near"), *group, F.col("__zone").alias("__outer"))
        opened = one.join(near, ["__path", *group], "left").join(outer, ["__near", *group], "left")
    events = written(opened.select("__order", F.lit(1).alias("__tie"), F.col("__zone").alias("__found")).union(
        opened.select(F.concat("__order", F.lit(CLOSED)), F.lit(-1), "__outer")), "events")

    self = include_self if isinstance(include_self, Column) else F.lit(include_self)
    rows = df.withColumns({"__order": order(F.col(path), ours), "__tie": F.when(self, 2).otherwise(0)})
    found = last_event(rows.where(F.col("__order").isNotNull()), events, "__order", "__tie", "__found").drop("__order", "__tie")
    if how == "inner":
        return found.where(F.col("__found").isNotNull()).select(*df.columns, "__found.*")
    without = rows.where(F.col("__order").isNull()).select(*df.columns, *[
        F.lit(None).cast(zones.schema[c].dataType).alias(c) for c in zones.columns])
    return found.select(*df.columns, "__found.*").union(without)


def ancestor_join(df: DataFrame, zones: DataFrame, path: str = "path", zone: str = "path",
                  pick: str = "shallowest", include_self: bool = True, unique: bool = False,
                  by: tuple[str, str] | None = None) -> DataFrame:
    """Every row of ``df`` with the columns of the zone that contains its path, null where none does.

    With ``unique`` the paths are known to be distinct, which saves joining back; else each path is looked up once, and
    adaptive execution splits the join of a path that very many rows have. ``by`` is as in :func:`containing`; a row whose
    column is null has no zone.
    """
    if pick not in ("shallowest", "deepest"):
        raise ValueError(f"pick must be shallowest or deepest, not {pick}")
    renamed = zones.select(*[F.col(c).alias(f"zone_{c}") for c in zones.columns])
    same = None if by is None else (by[0], f"zone_{by[1]}")
    if unique:
        return containing(df, renamed, path, f"zone_{zone}", pick, include_self, "left", same)
    on = [path] if by is None else [path, by[0]]
    distinct = df.select(*on).where(F.col(path).isNotNull()).distinct()
    best = containing(distinct, renamed, path, f"zone_{zone}", pick, include_self, by=same)
    return df.join(best, on, "left").select(*df.columns, *renamed.columns)


def exact_zone(df: DataFrame, zones: DataFrame, path: str = "path", zone: str = "path") -> DataFrame:
    """Adds ``in_zone``: the path itself, not an ancestor, is a zone (a trailing slash makes no difference)."""
    marks = zones.select(paths.strip_slash(F.col(zone)).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    keyed = df.withColumn("__key", paths.strip_slash(F.col(path)))
    return keyed.join(marks, "__key", "left").withColumn(
        "in_zone", F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")


def dataset_conflicts(candidates: DataFrame, existing: DataFrame, kind: str = "FS",
                      dataset: str = "dataset") -> DataFrame:
    """(dataset, conflict) for each candidate: is it covered by, or does it cover, an existing dataset.

    Databases conflict when equal. Paths conflict when equal, ancestor or descendant by whole segments, both on a cluster
    or both on a cloud store with the same scheme. Each side is laid out once among the other (:func:`containing`), so
    pairs are never listed.
    """
    new = candidates.select(F.col(dataset).alias("dataset")).distinct()
    old = existing.select(F.col(dataset).alias("dataset")).distinct()
    if kind == "HIVE":
        hit = old.withColumn("__hit", F.lit(True))
        return new.join(hit, "dataset", "left").select("dataset", F.coalesce("__hit", F.lit(False)).alias("conflict"))

    new = new.withColumn("__place", paths.storage_place(F.col("dataset")))
    held = old.select(paths.storage_place(F.col("dataset")).alias("__held")).distinct()
    covered = containing(new, held, "__place", "__held", "shallowest", how="left")
    # the deepest candidates that hold an existing dataset; what they lie in covers it as well
    places = new.select(F.col("__place").alias("__new")).distinct()
    deepest = containing(held, places, "__held", "__new", "deepest").select("__new").distinct()
    covers = deepest.select(F.explode(paths.prefixes(F.col("__new"))).alias("__place")).distinct().withColumn("__covers", F.lit(True))
    both = covered.join(covers, "__place", "left")
    return both.select("dataset", (F.col("__held").isNotNull() | F.col("__covers").isNotNull()).alias("conflict"))
