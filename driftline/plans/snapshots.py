"""Change sets between snapshots, and the moves, deletes and copies they call for."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions import paths, times
from driftline.operators.ancestors import containing
from driftline.operators.joins import hot_join
from driftline.operators.ordering import latest_per_key
from driftline.plans.copying import delete_missing, plan_copy
from driftline.plans.options import CopyOptions
from driftline.sources.scratch import written

# Fixed value: name given to the folder that holds moved entries on their way.
MOVE_FOLDER = ".moving"


# attributes whose change is a modification, where both snapshots have them
ATTRIBUTES = ["owner", "group", "permission", "acl", "xattrs"]


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(type, source, target) between two snapshots (file_id, parent_id, name, path, is_dir, checksum, attributes).

    A file or directory is modified if its content is, or any of ATTRIBUTES that both snapshots have.

    The result is written: it is small beside the snapshots, and all that follows reads it more than once.
    """
    return written(compare(old, new), "diff")


def compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """The change set, not yet computed.

    Entries are matched by file id; a rename is a change of (parent_id, name), so the children of a renamed directory are
    not listed. Only the top of a created or deleted subtree is listed. All source paths are in the names of the old
    snapshot, also for an entry created inside a directory that was renamed since.
    """
    kinds = dict(new.dtypes)
    shared = [c for c in ATTRIBUTES if c in old.columns and c in new.columns]
    wide = ["parent_id", "name", "path", "is_dir", "checksum", *shared]

    def compared(c: str, side: str) -> Column:
        # maps cannot be compared directly: as sorted entries they can
        return (F.sort_array(F.map_entries(c)) if kinds[c].startswith("map") else F.col(c)).alias(f"{side}_{c}")

    ours = old.select("file_id", *[compared(c, "o") for c in wide])
    theirs = new.select("file_id", *[compared(c, "n") for c in wide])
    both = ours.join(theirs, "file_id", "full_outer")
    created, deleted = F.col("o_path").isNull(), F.col("n_path").isNull()
    kept = ~created & ~deleted
    renamed = kept & ((F.col("o_parent_id") != F.col("n_parent_id")) | (F.col("o_name") != F.col("n_name")))
    same = F.lit(True)
    for c in ("checksum", *shared):
        same = same & F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    modified = kept & ~same

    found = F.array_compact(F.array(F.when(created, F.lit("CREATE")), F.when(deleted, F.lit("DELETE")),
                                    F.when(renamed, F.lit("RENAME")), F.when(modified, F.lit("MODIFY"))))
    changed = both.where(F.size(found) > 0).withColumn("type", F.explode(found))

    # one directory may hold a large part of all changes: the join on the parent is salted. Only directories are parents.
    by_parent = changed.withColumn("__parent", F.when(F.col("type") == "CREATE", F.col("n_parent_id"))
                                   .when(F.col("type") == "DELETE", F.col("o_parent_id")))
    parents = (old.where("is_dir").select(F.col("file_id").alias("__parent"), F.col("path").alias("p_old"))
               .join(new.where("is_dir").select(F.col("file_id").alias("__parent"), F.col("path").alias("p_new")),
                     "__parent", "full_outer").withColumn("p_known", F.lit(True)))
    placed = hot_join(by_parent, parents, ["__parent"], "left", spread=F.col("file_id"))
    covered = (((F.col("type") == "CREATE") & F.col("p_old").isNull())
               | ((F.col("type") == "DELETE") & F.col("p_new").isNull())) & F.col("p_known")
    base = F.when(F.col("p_old") == "/", F.lit("")).otherwise(F.col("p_old"))
    source = (F.when((F.col("type") == "CREATE") & F.col("p_old").isNotNull(),
                     F.concat(base, F.lit("/"), F.col("n_name")))
              .when(F.col("type") == "CREATE", F.col("n_path")).otherwise(F.col("o_path")))
    return placed.where(~F.coalesce(covered, F.lit(False))).select(
        "type", source.alias("source"), F.when(F.col("type") == "RENAME", F.col("n_path")).alias("target"))


def translate_renames(diff: DataFrame) -> DataFrame:
    """CREATE and MODIFY rows with the ``target`` they have after the renames of the same diff.

    The deepest rename that holds the path applies. A rename of the very path counts for MODIFY only: a created entry of
    that name is another file.
    """
    changes = diff.where("type in ('CREATE', 'MODIFY')").select("type", "source").distinct()
    renames = diff.where("type = 'RENAME'").select(F.col("source").alias("r_source"), F.col("target").alias("r_target"))
    best = containing(changes, renames, "source", "r_source", "deepest", F.col("type") == "MODIFY", "left")
    tail = F.col("source").substr(F.length("r_source") + 1, F.length("source"))
    return best.select("type", "source", F.coalesce(F.concat("r_target", tail), "source").alias("target"))


def expand_created(translated: DataFrame, renames: DataFrame, manifest: DataFrame) -> DataFrame:
    """Paths below created directories, without what a rename moved there.

    ``translated`` are CREATE rows with their final path in ``target``; ``renames`` have the final path in ``target``;
    ``manifest`` is the new tree (path, is_dir).
    """
    tops = translated.where("type = 'CREATE'").select(F.col("target").alias("created")).distinct()
    movers = renames.where("type = 'RENAME'").select(F.col("target").alias("moved")).distinct()
    entries = manifest.select("path")
    inside = containing(entries, tops, "path", "created", "deepest", include_self=False)
    shadowed = containing(inside, movers, "path", "moved", "deepest", how="left")
    return shadowed.where("moved is null or length(moved) <= length(created)").select("path", "created")


def copy_list_from_diff(diff: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of the new tree to copy once renames and deletes are done: modified, created, and below created."""
    translated = written(translate_renames(diff), "translated")
    below = expand_created(translated, diff, manifest).select("path")
    listed = translated.select(F.col("target").alias("path")).union(below).distinct()
    return manifest.join(listed, "path", "left_semi")


def _ops(rows: DataFrame, target_root: str) -> DataFrame:
    root = target_root.rstrip("/")
    return rows.select("type", F.concat(F.lit(root), "source").alias("source"),
                       F.concat(F.lit(root), "target").alias("target"))


def sync_ops(diff: DataFrame, target_root: str) -> DataFrame:
    """Renames and deletes to apply on the target before copying; deletes have no target."""
    rows = diff.where("type in ('RENAME', 'DELETE')").select(
        "type", "source", F.when(F.col("type") == "RENAME", F.col("target")).alias("target"))
    return _ops(rows, target_root)


def reverse_sync_ops(reverse_diff: DataFrame, target_root: str) -> DataFrame:
    """Moves that take the target back to an earlier snapshot.

    The renames of a reverse diff are spelled the way back, but its deletes still name paths from before them: they are
    looked up through the swapped renames.
    """
    renames = reverse_diff.where("type = 'RENAME'")
    swapped = renames.select(F.lit("RENAME").alias("type"), F.col("target").alias("source"),
                             F.col("source").alias("target"))
    deletes = reverse_diff.where("type = 'DELETE'").select(F.lit("CREATE").alias("type"), "source", "target")
    # a deleted path is looked up like a created one: only a proper ancestor moves it
    moved = translate_renames(swapped.unionByName(deletes))
    gone = moved.select(F.lit("DELETE").alias("type"), F.col("target").alias("source"),
                        F.lit(None).cast("string").alias("target"))
    return _ops(gone.unionByName(renames.select("type", "source", "target")), target_root)


def move_order(ops: DataFrame) -> DataFrame:
    """Adds ``out_level`` and ``in_level``, the order of moves.

    Sources leave deepest first, then targets are filled shallowest first; entries of one level never contain each other,
    so a level runs in parallel. Deletes have no ``in_level``.
    """
    return ops.withColumns({
        "out_level": paths.depth(F.col("source")),
        "in_level": F.when(F.col("target").isNotNull(), paths.depth(F.col("target"))),
    })


def merge_manifest(stored: DataFrame, changed: DataFrame) -> DataFrame:
    """Stored manifest with changed rows put in; on an equal path the changed row wins."""
    kept = stored.join(changed.select("rel_path"), "rel_path", "left_anti")
    return kept.unionByName(changed)


def latest_common_snapshot(source: DataFrame, target: DataFrame, prefix: Column) -> DataFrame:
    """(dataset, name) of the newest target snapshot whose name the source has too; null where none is common.

    Snapshots are (dataset, name, mtime); ``prefix`` is the name prefix of the policy's snapshots.
    """
    ours = target.where(F.col("name").startswith(prefix))
    known = source.where(F.col("name").startswith(prefix)).select("dataset", "name").distinct()
    common = ours.join(known, ["dataset", "name"], "left_semi").groupBy("dataset").agg(
        F.max_by("name", F.struct("mtime", "name")).alias("name"))
    return target.select("dataset").distinct().join(common, "dataset", "left")


def latest_snapshot(snapshots: DataFrame, prefix: Column) -> DataFrame:
    """(dataset, name) of the newest snapshot with the prefix."""
    return (snapshots.where(F.col("name").startswith(prefix)).groupBy("dataset")
            .agg(F.max_by("name", F.struct("mtime", "name")).alias("name")))


def evict_snapshots(snapshots: DataFrame, keep: int, max_age: str, now: datetime, prefix: str = "") -> DataFrame:
    """Snapshots to delete: older than ``max_age`` (as ``days(3)``) and not among the newest ``keep`` of their dataset."""
    ours = snapshots.where(F.col("name").startswith(prefix))
    limit = times.moment(now) - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (times.age_ms(F.lit(max_age)) / 1000).cast("decimal(18,6)"))
    old = ours.where(F.col("mtime") < limit)
    if keep <= 0:
        return old
    newest = latest_per_key(ours, ["dataset"], [F.desc("mtime"), F.desc("name")], keep).select("dataset", "name")
    return old.join(newest, ["dataset", "name"], "left_anti")


@dataclass
class SyncPlan:
    """What :func:`plan_sync` found; ``kind`` is incremental or full.

    ``moves`` are as :func:`move_order` gives them, ``copies`` as :func:`plan_copy` does, ``deletes`` as
    :func:`delete_missing`; moves come first and deletes last. An incremental plan deletes by moves, a full one has none.
    """

    kind: str
    moves: DataFrame | None
    copies: DataFrame
    deletes: DataFrame | None


def sync_precheck(target_from: DataFrame, target_now: DataFrame, from_time: datetime, to_time: datetime,
                  reverse: bool = False) -> bool:
    """True if a diff can be used: the target is as it was at ``from`` and the snapshots are in time order."""
    if (from_time < to_time) if reverse else (from_time > to_time):
        raise ValueError("snapshots are in the wrong time order")
    return compare(target_from, target_now).isEmpty()


def plan_of_changes(changed: DataFrame, source: DataFrame) -> DataFrame:
    """The rows of a copy list (``path``, ``is_dir``) as a copy plan; lengths come from the source manifest."""
    rows = changed.select(F.col("path").alias("rel_path"), "is_dir").join(source.select("rel_path", "length"), "rel_path", "left")
    return rows.select("rel_path", F.when(F.col("is_dir"), "MKDIR").otherwise("OVERWRITE").alias("action"),
                       F.lit("changed").alias("reason"),
                       F.when(F.col("is_dir"), F.lit(0)).otherwise(F.col("length")).cast("bigint").alias("bytes"), "is_dir", "length")


def plan_sync(source_from: DataFrame, source_to: DataFrame, target_from: DataFrame, target_now: DataFrame,
              from_time: datetime, to_time: datetime, target_root: str, source: DataFrame, target: DataFrame,
              options: CopyOptions) -> SyncPlan:
    """Incremental plan from snapshots when the target is unchanged, else a full comparison of the manifests.

    With ``diff`` the target goes on from an earlier to a later snapshot, with ``reverse_diff`` back from a later to an earlier
    one; both start where the target is. The difference names every path as it is on the target now, so its renames and
    deletes apply as they are, either way. ``source`` is the manifest of the tree at ``to``.
    """
    if (options.diff or options.reverse_diff) and sync_precheck(target_from, target_now, from_time, to_time, options.reverse_diff):
        diff = snapshot_diff(source_from, source_to)
        return SyncPlan("incremental", move_order(sync_ops(diff, target_root)),
                        plan_of_changes(copy_list_from_diff(diff, source_to), source), None)
    deletes = delete_missing(source, target) if options.delete_missing else None
    return SyncPlan("full", None, plan_copy(source, target, options), deletes)
