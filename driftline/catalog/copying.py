"""Manifests, copy plans and snapshots."""

from datetime import datetime

from pyspark.sql import functions as F

from driftline.catalog.registry import query
from driftline.functions import paths
from driftline.operators import ordering
from driftline.plans import copying, digests, snapshots
from driftline.plans.options import CopyOptions, cluster_preset
from driftline.sources.manifests import manifest_totals, read_manifest, write_manifest
from driftline.sources.scratch import scratch_path

SYNC_APPEND = CopyOptions(sync=True, append=True, preserve=frozenset({"BLOCKSIZE"}))


def prefixes(d):
    return d.append_candidate.select(
        "rel_path", copying.prefix_checksum(F.col("content"), F.col("target_length")).alias("prefix_checksum"))


PLAN_CTE = """
WITH prefix AS (SELECT rel_path, md5(substring(content, 1, CAST(target_length AS INT))) AS prefix_checksum FROM append_candidate),
plan AS (
 SELECT s.rel_path, s.length, t.length AS t_length,
  CASE WHEN t.rel_path IS NOT NULL AND t.is_dir <> s.is_dir THEN 'ERROR/type_clash'
   WHEN t.rel_path IS NULL THEN 'OVERWRITE/missing'
   WHEN s.length = t.length AND s.block_size = t.block_size AND (s.checksum IS NULL OR t.checksum IS NULL OR s.checksum = t.checksum) THEN 'SKIP/same'
   WHEN t.length < s.length AND p.prefix_checksum = t.checksum THEN 'APPEND/longer'
   WHEN s.length <> t.length THEN 'OVERWRITE/length'
   WHEN s.block_size <> t.block_size THEN 'OVERWRITE/block_size'
   ELSE 'OVERWRITE/checksum' END AS verdict
 FROM source_manifest s LEFT JOIN target_manifest t ON s.rel_path = t.rel_path LEFT JOIN prefix p ON s.rel_path = p.rel_path)
"""
PLAN_VIEWS = "source_manifest target_manifest append_candidate"


@query("plan_copy", PLAN_VIEWS, PLAN_CTE + """
SELECT rel_path, split_part(verdict, '/', 1) AS action, split_part(verdict, '/', 2) AS reason,
 CAST(CASE split_part(verdict, '/', 1) WHEN 'OVERWRITE' THEN length WHEN 'APPEND' THEN length - t_length ELSE 0 END AS BIGINT) AS bytes FROM plan""")
def plan_copy(d):
    plan = copying.plan_copy(d.source_manifest, d.target_manifest, SYNC_APPEND, prefixes(d))
    return plan.select("rel_path", "action", "reason", "bytes")


@query("plan_summary", PLAN_VIEWS, PLAN_CTE + """
SELECT split_part(verdict, '/', 1) AS action, split_part(verdict, '/', 2) AS reason, count(*) AS files,
 CAST(sum(CASE split_part(verdict, '/', 1) WHEN 'OVERWRITE' THEN length WHEN 'APPEND' THEN length - t_length ELSE 0 END) AS BIGINT) AS bytes
FROM plan GROUP BY ALL""")
def plan_summary(d):
    plan = copying.plan_copy(d.source_manifest, d.target_manifest, SYNC_APPEND, prefixes(d))
    return copying.plan_summary(plan)


@query("plan_copy_overwrite", "source_manifest target_manifest", """
SELECT s.rel_path, CASE WHEN t.is_dir THEN 'ERROR' ELSE 'OVERWRITE' END AS action,
 CASE WHEN t.rel_path IS NULL THEN 'missing' WHEN t.is_dir THEN 'type_clash' ELSE 'overwrite' END AS reason,
 CAST(CASE WHEN t.is_dir THEN 0 ELSE s.length END AS BIGINT) AS bytes
FROM source_manifest s LEFT JOIN target_manifest t ON s.rel_path = t.rel_path""")
def plan_copy_overwrite(d):
    plan = copying.plan_copy(d.source_manifest, d.target_manifest, CopyOptions(overwrite=True))
    return plan.select("rel_path", "action", "reason", "bytes")


@query("prefix_checksums", "append_candidate", """
SELECT rel_path, md5(substring(content, 1, CAST(target_length AS INT))) AS prefix_checksum FROM append_candidate""")
def prefix_checksums(d):
    return prefixes(d)


@query("delete_missing", "source_manifest target_manifest", """
SELECT rel_path, is_dir FROM target_manifest t WHERE NOT EXISTS (SELECT 1 FROM source_manifest s WHERE s.rel_path = t.rel_path)
 AND NOT EXISTS (SELECT 1 FROM target_manifest u WHERE u.is_dir AND u.rel_path <> t.rel_path AND starts_with(t.rel_path, u.rel_path || '/')
  AND NOT EXISTS (SELECT 1 FROM source_manifest s WHERE s.rel_path = u.rel_path))""")
def delete_missing(d):
    return copying.delete_missing(d.source_manifest, d.target_manifest)


# Directories above the old tree are added so that whole subtrees go missing at once.
TREE_SQL = """
WITH old_tree AS (SELECT path AS rel_path, is_dir FROM snapshot_old UNION ALL
  SELECT DISTINCT path || '/sub', true FROM snapshot_old WHERE is_dir UNION ALL SELECT path || '/sub/leaf', false FROM snapshot_old WHERE is_dir),
gone AS (SELECT * FROM old_tree o WHERE NOT EXISTS (SELECT 1 FROM snapshot_new n WHERE n.path = o.rel_path))
"""


@query("delete_missing_subtrees", "snapshot_old snapshot_new", TREE_SQL + """
SELECT rel_path, is_dir FROM gone g WHERE NOT EXISTS (SELECT 1 FROM gone a WHERE a.is_dir AND a.rel_path <> g.rel_path AND starts_with(g.rel_path, a.rel_path || '/'))""")
def delete_missing_subtrees(d):
    old = d.snapshot_old.select(F.col("path").alias("rel_path"), "is_dir")
    tops = old.where("is_dir").select("rel_path").distinct()
    tree = (old.unionByName(tops.select(F.concat("rel_path", F.lit("/sub")).alias("rel_path"), F.lit(True).alias("is_dir")))
            .unionByName(tops.select(F.concat("rel_path", F.lit("/sub/leaf")).alias("rel_path"), F.lit(False).alias("is_dir"))))
    return copying.delete_missing(d.snapshot_new.select(F.col("path").alias("rel_path"), "is_dir"), tree)


@query("exclude_find", "source_manifest", """
SELECT rel_path FROM source_manifest WHERE NOT regexp_matches(rel_path, '/src1[0-9]/|[05]\\.txt$')""")
def exclude_find(d):
    return copying.exclude_find(d.source_manifest, r"/src1[0-9]/|[05]\.txt$").select("rel_path")


@query("exclude_fullmatch", "source_manifest", """
SELECT rel_path FROM source_manifest WHERE NOT regexp_full_match(rel_path, '(/src0/.*)|(.*/en/[0-9]*7\\.txt)|(src1)')""")
def exclude_fullmatch(d):
    return copying.exclude_fullmatch(d.source_manifest, ["/src0/.*", r".*/en/[0-9]*7\.txt", "src1"]).select("rel_path")


@query("manifest_totals", "target_manifest", """
SELECT count(*) AS paths, CAST(sum(CAST(is_dir AS INT)) AS BIGINT) AS dirs, CAST(sum(CASE WHEN NOT is_dir THEN length END) AS BIGINT) AS bytes FROM target_manifest""")
def totals(d):
    return manifest_totals(d.target_manifest)


@query("write_manifest", "source_manifest", """
SELECT count(*) AS paths, CAST(sum(CAST(is_dir AS INT)) AS BIGINT) AS dirs, CAST(sum(length) AS BIGINT) AS bytes FROM source_manifest""")
def stored_totals(d):
    return write_manifest(d.source_manifest, scratch_path(d.spark, "manifest"))


@query("read_manifest", "source_manifest", "SELECT * FROM source_manifest")
def stored_manifest(d):
    path = scratch_path(d.spark, "manifest")
    write_manifest(d.source_manifest, path)
    return read_manifest(d.spark, path)


@query("duplicate_paths", "source_manifest target_manifest", """
SELECT rel_path, count(*) AS sources, min(path) AS first_source, max(path) AS last_source
FROM (SELECT rel_path, '/a' || rel_path AS path FROM source_manifest UNION ALL SELECT rel_path, '/b' || rel_path FROM target_manifest)
GROUP BY rel_path HAVING count(*) > 1""")
def duplicate_paths(d):
    both = (d.source_manifest.select("rel_path", F.concat(F.lit("/a"), "rel_path").alias("path"))
            .unionByName(d.target_manifest.select("rel_path", F.concat(F.lit("/b"), "rel_path").alias("path"))))
    return copying.duplicate_paths(both)


@query("copy_counters", PLAN_VIEWS, PLAN_CTE + """
, done AS (SELECT split_part(rel_path, '/', 2) AS job_id, length, CASE WHEN verdict LIKE 'ERROR%' THEN 'FAIL' ELSE split_part(verdict, '/', 1) END AS action,
 CASE split_part(verdict, '/', 1) WHEN 'OVERWRITE' THEN length WHEN 'APPEND' THEN length - t_length ELSE 0 END AS bytes FROM plan)
SELECT job_id, CAST(sum(CASE WHEN action IN ('OVERWRITE', 'APPEND') THEN 1 ELSE 0 END) AS BIGINT) AS copied, CAST(0 AS BIGINT) AS dir_copied,
 CAST(sum(CASE WHEN action = 'SKIP' THEN 1 ELSE 0 END) AS BIGINT) AS skipped, CAST(sum(CASE WHEN action = 'FAIL' THEN 1 ELSE 0 END) AS BIGINT) AS failed,
 CAST(sum(CASE WHEN action IN ('OVERWRITE', 'APPEND') THEN bytes ELSE 0 END) AS BIGINT) AS bytes_copied,
 CAST(sum(CASE WHEN action IN ('OVERWRITE', 'APPEND') THEN length ELSE 0 END) AS BIGINT) AS bytes_expected,
 CAST(sum(CASE WHEN action = 'FAIL' THEN length ELSE 0 END) AS BIGINT) AS bytes_failed,
 CAST(sum(CASE WHEN action = 'SKIP' THEN length ELSE 0 END) AS BIGINT) AS bytes_skipped FROM done GROUP BY job_id""")
def copy_counters(d):
    plan = copying.plan_copy(d.source_manifest, d.target_manifest, SYNC_APPEND, prefixes(d))
    done = plan.withColumns({
        "job_id": F.element_at(F.split("rel_path", "/"), 2),
        "action": F.when(F.col("action") == "ERROR", "FAIL").otherwise(F.col("action"))})
    return copying.copy_counters(done, ["job_id"])


@query("attributes_to_fix", "source_manifest target_manifest", """
SELECT rel_path, attributes FROM (SELECT s.rel_path, concat_ws(',', CASE WHEN NOT s.is_dir AND s.block_size <> t.block_size THEN 'BLOCKSIZE' END,
  CASE WHEN s.owner <> t.owner THEN 'USER' END, CASE WHEN s.permission <> t.permission THEN 'PERMISSION' END) AS attributes
 FROM source_manifest s JOIN target_manifest t ON s.rel_path = t.rel_path) WHERE attributes <> ''""")
def attributes_to_fix(d):
    found = copying.attributes_to_fix(d.source_manifest, d.target_manifest, ["BLOCKSIZE", "USER", "PERMISSION"])
    return found.select("rel_path", F.array_join("attributes", ",").alias("attributes"))


# ---- orders and splits


@query("sort_listing", "source_manifest", "SELECT rel_path, length FROM source_manifest")
def sort_listing(d):
    return ordering.sort_listing(d.source_manifest.select("rel_path", "length"))


@query("balance_by_bytes", "source_manifest", """
WITH placed AS (SELECT rel_path, length, sum(length) OVER (ORDER BY rel_path) - length AS before, sum(length) OVER () AS total FROM source_manifest)
SELECT rel_path, length, CAST(floor(before / ceil(total / 7)) AS BIGINT) AS part FROM placed""")
def balance_by_bytes(d):
    return ordering.balance_by_bytes(d.source_manifest.select("rel_path", "length"), 7)


# ---- snapshots

DIFF_CTE = """
WITH pairs AS (SELECT o.file_id AS o_id, n.file_id AS n_id, o.path AS o_path, n.path AS n_path, n.name AS n_name, n.parent_id AS n_parent, o.parent_id AS o_parent,
  (o.parent_id <> n.parent_id OR o.name <> n.name) AS renamed, o.checksum IS DISTINCT FROM n.checksum AS modified
 FROM snapshot_old o FULL JOIN snapshot_new n ON o.file_id = n.file_id),
diff AS (
 SELECT 'CREATE' AS type, coalesce(p.path || '/' || n_name, n_path) AS source, CAST(NULL AS VARCHAR) AS target FROM pairs LEFT JOIN snapshot_old p ON p.file_id = n_parent
  WHERE o_id IS NULL AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.n_id = n_parent AND q.o_id IS NULL)
 UNION ALL SELECT 'DELETE', o_path, NULL FROM pairs WHERE n_id IS NULL AND NOT EXISTS (SELECT 1 FROM pairs q WHERE q.o_id = pairs.o_parent AND q.n_id IS NULL)
 UNION ALL SELECT 'RENAME', o_path, n_path FROM pairs WHERE o_id IS NOT NULL AND n_id IS NOT NULL AND renamed
 UNION ALL SELECT 'MODIFY', o_path, NULL FROM pairs WHERE o_id IS NOT NULL AND n_id IS NOT NULL AND modified),
ren AS (SELECT source AS r_source, target AS r_target FROM diff WHERE type = 'RENAME'),
moved AS (SELECT type, source, coalesce((SELECT max_by(r_target || substr(source, length(r_source) + 1), length(r_source)) FROM ren
   WHERE starts_with(source, r_source || '/') OR (type = 'MODIFY' AND source = r_source)), source) AS target
 FROM diff WHERE type IN ('CREATE', 'MODIFY'))
"""
SNAPS = "snapshot_old snapshot_new"


def the_diff(d):
    return snapshots.snapshot_diff(d.snapshot_old, d.snapshot_new)


@query("snapshot_diff", SNAPS, DIFF_CTE + "SELECT type, source, target FROM diff")
def snapshot_diff(d):
    return the_diff(d)


@query("snapshot_diff_by_digest", SNAPS, DIFF_CTE + "SELECT type, source, target FROM diff")
def snapshot_diff_by_digest(d):
    """The same from stored snapshots, whose directories are listed only where their digests differ."""
    old, new = (digests.store(s, scratch_path(d.spark, "stored")) for s in (d.snapshot_old, d.snapshot_new))
    return digests.stored_diff(old, new)


@query("sync_precheck_by_digest", SNAPS, """
SELECT (SELECT count(*) FROM snapshot_old o FULL JOIN snapshot_old n ON o.file_id = n.file_id WHERE o.file_id IS NULL OR n.file_id IS NULL) = 0 AS unchanged,
 (SELECT count(*) FROM snapshot_old o FULL JOIN snapshot_new n ON o.file_id = n.file_id WHERE o.file_id IS NULL OR n.file_id IS NULL) = 0 AS changed""")
def sync_precheck_by_digest(d):
    old, again, new = (digests.store(s, scratch_path(d.spark, "stored")) for s in (d.snapshot_old, d.snapshot_old, d.snapshot_new))
    return d.spark.createDataFrame([(digests.unchanged(old, again), digests.unchanged(old, new))], "unchanged boolean, changed boolean")


@query("translate_renames", SNAPS, DIFF_CTE + "SELECT type, source, target FROM moved")
def translate_renames(d):
    return snapshots.translate_renames(the_diff(d))


@query("expand_created", SNAPS, DIFF_CTE + """
, created AS (SELECT path AS created FROM snapshot_new WHERE is_dir AND file_id % 3 = 0)
SELECT n.path AS path, max_by(created, length(created)) AS created FROM snapshot_new n JOIN created c ON starts_with(n.path, c.created || '/')
WHERE NOT EXISTS (SELECT 1 FROM ren r WHERE starts_with(r.r_target, c.created || '/') AND (n.path = r.r_target OR starts_with(n.path, r.r_target || '/')))
GROUP BY n.path""")
def expand_created(d):
    # every third directory is taken as created, so that renames into created directories occur
    made = d.snapshot_new.where("is_dir and file_id % 3 = 0").select(F.lit("CREATE").alias("type"), F.col("path").alias("target"))
    return snapshots.expand_created(made, the_diff(d), d.snapshot_new)


@query("copy_list_from_diff", SNAPS, DIFF_CTE + """
, below AS (SELECT n.path FROM snapshot_new n JOIN moved m ON m.type = 'CREATE' AND starts_with(n.path, m.target || '/'))
SELECT path, is_dir, checksum FROM snapshot_new WHERE path IN (SELECT target FROM moved UNION SELECT path FROM below)""")
def copy_list_from_diff(d):
    return snapshots.copy_list_from_diff(the_diff(d), d.snapshot_new).select("path", "is_dir", "checksum")


@query("sync_ops", SNAPS, DIFF_CTE + """
SELECT type, '/dr' || source AS source, '/dr' || target AS target FROM diff WHERE type IN ('RENAME', 'DELETE')""")
def sync_ops(d):
    return snapshots.sync_ops(the_diff(d), "/dr/")


REVERSE = """
WITH rdiff AS (SELECT 'RENAME' AS type, '/' || source AS source, '/was/' || source AS target FROM documents WHERE doc_id % 4 = 0 GROUP BY source
 UNION ALL SELECT 'DELETE', '/was/' || source || '/' || lang || '/' || CAST(doc_id AS STRING), NULL FROM documents WHERE doc_id % 6 = 1)
"""


@query("reverse_sync_ops", "", REVERSE + """
SELECT type, '/dr' || source AS source, '/dr' || target AS target FROM rdiff WHERE type = 'RENAME'
UNION ALL SELECT type, '/dr' || coalesce((SELECT max_by(r.source || substr(x.source, length(r.target) + 1), length(r.target)) FROM rdiff r
  WHERE r.type = 'RENAME' AND starts_with(x.source, r.target || '/')), x.source), NULL FROM rdiff x WHERE type = 'DELETE'""")
def reverse_sync_ops(d):
    docs = d.table("documents")
    renames = docs.where("doc_id % 4 = 0").select("source").distinct().select(
        F.lit("RENAME").alias("type"), F.concat(F.lit("/"), "source").alias("source"),
        F.concat(F.lit("/was/"), "source").alias("target"))
    deletes = docs.where("doc_id % 6 = 1").select(
        F.lit("DELETE").alias("type"),
        F.concat(F.lit("/was/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string")).alias("source"),
        F.lit(None).cast("string").alias("target"))
    return snapshots.reverse_sync_ops(renames.unionByName(deletes), "/dr")


@query("move_order", SNAPS, DIFF_CTE + """
SELECT type, '/dr' || source AS source, length(source) - length(replace(source, '/', '')) + 1 AS out_level,
 length(target) - length(replace(target, '/', '')) + 1 AS in_level FROM diff WHERE type IN ('RENAME', 'DELETE')""")
def move_order(d):
    ops = snapshots.move_order(snapshots.sync_ops(the_diff(d), "/dr"))
    return ops.select("type", "source", F.col("out_level").cast("bigint").alias("out_level"),
                      F.col("in_level").cast("bigint").alias("in_level"))


@query("sync_precheck", SNAPS, """
SELECT (SELECT count(*) FROM snapshot_old o FULL JOIN snapshot_old n ON o.file_id = n.file_id WHERE o.file_id IS NULL OR n.file_id IS NULL) = 0 AS unchanged,
 (SELECT count(*) FROM snapshot_old o FULL JOIN snapshot_new n ON o.file_id = n.file_id WHERE o.file_id IS NULL OR n.file_id IS NULL) = 0 AS changed""")
def sync_precheck(d):
    first, last = datetime(2001, 1, 1), datetime(2001, 2, 1)
    rows = [(snapshots.sync_precheck(d.snapshot_old, d.snapshot_old, first, last),
             snapshots.sync_precheck(d.snapshot_old, d.snapshot_new, first, last))]
    return d.spark.createDataFrame(rows, "unchanged boolean, changed boolean")


def _plan(d, target_now):
    return snapshots.plan_sync(
        d.snapshot_old, d.snapshot_new, d.snapshot_old, target_now, datetime(2001, 1, 1), datetime(2001, 2, 1), "/dr",
        d.source_manifest, d.target_manifest,
        cluster_preset(diff=True, from_snapshot="s1", to_snapshot="s2"))


@query("plan_sync_incremental", SNAPS, DIFF_CTE + """
SELECT 'incremental' AS kind, 'copy' AS step, target AS path FROM moved
UNION ALL SELECT 'incremental', lower(type), '/dr' || source FROM diff WHERE type IN ('RENAME', 'DELETE')""")
def plan_sync_incremental(d):
    plan = _plan(d, d.snapshot_old)
    copies = plan.copies.select(F.lit(plan.kind).alias("kind"), F.lit("copy").alias("step"),
                                F.col("rel_path").alias("path"))
    return copies.unionByName(plan.moves.select(F.lit(plan.kind).alias("kind"), F.lower("type").alias("step"),
                                                F.col("source").alias("path")))


@query("plan_sync_full", "source_manifest target_manifest", """
SELECT 'full' AS kind, CASE WHEN t.is_dir THEN 'error' WHEN t.rel_path IS NULL THEN 'overwrite' WHEN s.length = t.length AND s.block_size = t.block_size
  AND (t.checksum IS NULL OR s.checksum = t.checksum) THEN 'skip' ELSE 'overwrite' END AS step, s.rel_path AS path
 FROM source_manifest s LEFT JOIN target_manifest t ON s.rel_path = t.rel_path
UNION ALL SELECT 'full', 'delete', rel_path FROM target_manifest t WHERE NOT EXISTS (SELECT 1 FROM source_manifest s WHERE s.rel_path = t.rel_path)""")
def plan_sync_full(d):
    plan = _plan(d, d.snapshot_new)
    copies = plan.copies.select(F.lit(plan.kind).alias("kind"), F.lower("action").alias("step"), F.col("rel_path").alias("path"))
    return copies.unionByName(plan.deletes.select(F.lit(plan.kind).alias("kind"), F.lit("delete").alias("step"),
                                                  F.col("rel_path").alias("path")))


@query("merge_manifest", "source_manifest target_manifest", """
SELECT coalesce(t.rel_path, s.rel_path) AS rel_path, CASE WHEN t.rel_path IS NOT NULL THEN t.length ELSE s.length END AS length,
 CASE WHEN t.rel_path IS NOT NULL THEN t.checksum ELSE s.checksum END AS checksum
FROM source_manifest s FULL JOIN target_manifest t ON s.rel_path = t.rel_path""")
def merge_manifest(d):
    merged = snapshots.merge_manifest(d.source_manifest, d.target_manifest)
    return merged.select("rel_path", "length", "checksum")


@query("latest_common_snapshot", "snapshot", """
WITH src AS (SELECT * FROM snapshot WHERE order_key % 3 <> 0), tgt AS (SELECT * FROM snapshot WHERE order_key % 5 <> 0),
best AS (SELECT t.dataset, arg_max(t.name, (t.mtime, t.name)) AS name FROM tgt t JOIN src s ON s.dataset = t.dataset AND s.name = t.name WHERE starts_with(t.name, 'sync-p1-') GROUP BY t.dataset)
SELECT d.dataset, best.name FROM (SELECT DISTINCT dataset FROM tgt) d LEFT JOIN best ON best.dataset = d.dataset""")
def latest_common_snapshot(d):
    return snapshots.latest_common_snapshot(d.snapshot.where("order_key % 3 <> 0"), d.snapshot.where("order_key % 5 <> 0"),
                                            F.lit("sync-p1-"))


@query("latest_snapshot", "snapshot", """
SELECT dataset, arg_max(name, (mtime, name)) AS name FROM snapshot WHERE starts_with(name, 'sync-') GROUP BY dataset""")
def latest_snapshot(d):
    return snapshots.latest_snapshot(d.snapshot, F.lit("sync-"))


@query("evict_snapshots", "snapshot", """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY mtime DESC, name DESC) AS rn FROM snapshot)
SELECT dataset, name, mtime FROM ranked WHERE rn > 3 AND mtime < TIMESTAMP '2001-09-01 00:00:00' - INTERVAL 1647 DAY""")
def evict_snapshots(d):
    return snapshots.evict_snapshots(d.snapshot, 3, "days(1647)", datetime(2001, 9, 1)).select("dataset", "name", "mtime")


# ---- ancestors


@query("ancestor_join", "policy zones", """
SELECT id, source_dataset, (SELECT min_by(key_name, length(path)) FROM zones WHERE starts_with(source_dataset || '/', path)) AS key_name FROM policy""")
def ancestor_join(d):
    from driftline.operators.ancestors import ancestor_join as join

    found = join(d.policy.select("id", "source_dataset"), d.zones, "source_dataset")
    return found.select("id", "source_dataset", F.col("zone_key_name").alias("key_name"))


@query("exact_zone", "policy zones", """
SELECT id, source_dataset IN (SELECT source_dataset FROM policy WHERE CAST(id AS INT) % 9 = 0) AS in_zone FROM policy""")
def exact_zone(d):
    from driftline.operators.ancestors import exact_zone as mark

    dirs = d.policy.where("cast(id as int) % 9 = 0").select(F.concat("source_dataset", F.lit("/")).alias("path"))
    return mark(d.policy.select("id", "source_dataset"), dirs, "source_dataset").select("id", "in_zone")


CONFLICTS = """
WITH cand AS (SELECT DISTINCT CASE WHEN CAST(id AS INT) % 4 = 0 THEN source_dataset ELSE source_dataset || '/part' || CAST(CAST(id AS INT) % 3 AS STRING) END AS dataset FROM policy WHERE type = 'FS'),
held AS (SELECT DISTINCT CASE WHEN CAST(id AS INT) % 2 = 0 THEN source_dataset ELSE source_dataset || '/part' || CAST(CAST(id AS INT) % 5 AS STRING) || '/x' END AS dataset FROM policy WHERE type = 'HIVE')
"""


@query("dataset_conflicts", "policy", CONFLICTS + """
SELECT c.dataset, EXISTS (SELECT 1 FROM held h WHERE starts_with(c.dataset || '/', h.dataset || '/') OR starts_with(h.dataset || '/', c.dataset || '/')) AS conflict FROM cand c""")
def dataset_conflicts(d):
    from driftline.operators.ancestors import dataset_conflicts as conflicts

    number = F.col("id").cast("int")
    cand = d.policy.where("type = 'FS'").select(F.when(number % 4 == 0, F.col("source_dataset")).otherwise(
        F.concat("source_dataset", F.lit("/part"), (number % 3).cast("string"))).alias("dataset"))
    held = d.policy.where("type = 'HIVE'").select(F.when(number % 2 == 0, F.col("source_dataset")).otherwise(
        F.concat("source_dataset", F.lit("/part"), (number % 5).cast("string"), F.lit("/x"))).alias("dataset"))
    return conflicts(cand, held)


@query("dataset_conflicts_hive", "policy", """
SELECT DISTINCT tags AS dataset, tags IN (SELECT tags FROM policy WHERE type = 'FS' AND tags NOT LIKE 'tag1%') AS conflict FROM policy WHERE type = 'HIVE'""")
def dataset_conflicts_hive(d):
    from driftline.operators.ancestors import dataset_conflicts as conflicts

    return conflicts(d.policy.where("type = 'HIVE'").select(F.col("tags").alias("dataset")),
                     d.policy.where("type = 'FS' and tags not like 'tag1%'").select(F.col("tags").alias("dataset")), "HIVE")


# ---- listings


@query("list_directory", "snapshot_old", """
WITH kids AS (SELECT path, name, is_dir, file_id FROM snapshot_old WHERE is_dir)
SELECT path, name, is_dir, CAST(0 AS BIGINT) AS length, CASE WHEN file_id % 2 = 0 THEN 'key' || CAST(file_id AS STRING) END AS encryption_key,
 file_id % 3 = 0 AS snapshottable, (SELECT count(*) FROM kids) AS total FROM kids WHERE contains(name, 'src1') ORDER BY name LIMIT 8""")
def list_directory(d):
    from driftline.operators.listing import list_directory as listing

    tree = d.snapshot_old.withColumn("length", F.lit(0).cast("bigint"))
    dirs = tree.where("is_dir")
    zones = dirs.where("file_id % 2 = 0").select(paths.add_slash(F.col("path")).alias("path"),
                                                 F.concat(F.lit("key"), F.col("file_id").cast("string")).alias("key_name"))
    snaps = dirs.where("file_id % 3 = 0").select(paths.add_slash(F.col("path")).alias("path"))
    return listing(tree.select("path", "is_dir", "length"), "/", zones, snaps, "src1", 8)


@query("list_databases", "policy zones", """
SELECT 'db' || id AS name, 'hdfs://nn:8020' || source_dataset AS location, (SELECT min_by(key_name, length(path)) FROM zones WHERE starts_with(source_dataset || '/', path)) AS encryption_key FROM policy WHERE type = 'HIVE'""")
def list_databases(d):
    from driftline.operators.listing import list_databases as listing

    dbs = d.policy.where("type = 'HIVE'").select(F.concat(F.lit("db"), "id").alias("name"),
                                                 F.concat(F.lit("hdfs://nn:8020"), "source_dataset").alias("location"))
    return listing(dbs, d.zones)


@query("list_tables", "", "SELECT p_brand AS database, p_type || '_' || CAST(p_partkey AS STRING) AS name FROM part WHERE p_brand = 'Brand#2'")
def list_tables(d):
    from driftline.operators.listing import list_tables as listing

    tables = d.table("part").select(F.col("p_brand").alias("database"),
                                    F.concat("p_type", F.lit("_"), F.col("p_partkey").cast("string")).alias("name"))
    return listing(tables, "Brand#2")
