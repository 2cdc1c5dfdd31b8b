"""Jobs on real files: the documents are written as files below a scratch folder first."""

import gzip
import math
from datetime import datetime

from pyarrow.fs import FileSelector
from pyspark.sql import functions as F

from driftline.catalog.registry import query
from driftline.operators import listing
from driftline.operators.logs import assemble_log_records
from driftline.plans import copying, execute, ranges, snapshots
from driftline.plans.options import CopyOptions
from driftline.sources import log_index, logs, trees
from driftline.sources.files import make_parent, open_root
from driftline.sources.scratch import scratch_path, written


def contents(d):
    """(rel_path, content) of the source tree."""
    return d.table("documents").select(
        F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"),
        F.col("text").alias("content"))


def source_tree(d):
    root = scratch_path(d.spark, "source")
    trees.write_files(contents(d), root)
    return root


def target_tree(d):
    """An outdated copy: some files are missing, cut short, changed, or gone from the source."""
    docs, size = d.table("documents"), F.length("text")
    place = F.concat(F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    cut = F.substring(F.col("text"), F.lit(1), (size - size % 10 - 1).cast("int"))
    text = F.when(F.col("doc_id") % 13 == 0, cut).when(F.col("doc_id") % 9 == 0, F.concat(F.lit("x"), "text")).otherwise(F.col("text"))
    kept = docs.where("doc_id % 5 <> 0").select(F.concat(F.lit("/"), "source", place).alias("rel_path"), text.alias("content"))
    stale = docs.where("doc_id % 11 = 0").select(F.concat(F.lit("/stale"), place).alias("rel_path"), F.col("text").alias("content"))
    root = scratch_path(d.spark, "target")
    trees.write_files(kept.unionByName(stale), root)
    return root


TREE = """
WITH tree AS (SELECT '/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS rel_path, false AS is_dir, CAST(strlen(text) AS BIGINT) AS length FROM documents
 UNION ALL SELECT DISTINCT '/' || source || '/' || lang, true, 0 FROM documents UNION ALL SELECT DISTINCT '/' || source, true, 0 FROM documents)
"""


def listed(d, root, mode="sync"):
    return trees.with_rel_path(trees.scan_tree(d.spark, [root]), mode)


@query("scan_tree", "", TREE + "SELECT rel_path, is_dir, length FROM tree")
def scan_tree(d):
    return listed(d, source_tree(d)).select("rel_path", "is_dir", "length")


@query("scan_tree_two_rounds", "", TREE + "SELECT rel_path, is_dir, length FROM tree WHERE is_dir")
def scan_tree_two_rounds(d):
    found = trees.scan_tree(d.spark, [source_tree(d)], 2)
    return trees.with_rel_path(found, "sync").select("rel_path", "is_dir", "length")


@query("scan_globs", "", TREE + """
SELECT regexp_replace(rel_path, '^/[^/]*', '') AS rel_path, is_dir, length FROM tree WHERE rel_path LIKE '/src1%/%'""")
def scan_globs(d):
    found = trees.scan_globs(d.spark, [source_tree(d) + "/src1*"])
    return trees.with_rel_path(found, "sync", roots=2).select("rel_path", "is_dir", "length")


@query("scan_from_list", "", TREE + "SELECT rel_path, is_dir, length FROM tree WHERE rel_path = '/src0' OR rel_path LIKE '/src0/%' OR rel_path LIKE '/src2%'")
def scan_from_list(d):
    root, listing_file = source_tree(d), scratch_path(d.spark, "list")
    lines = d.spark.createDataFrame([(f"{root}/src0",), ("  ",), (f"{root}/src2*",)], "value string")
    lines.coalesce(1).write.text(listing_file)
    found = trees.scan_from_list(d.spark, listing_file)
    # several roots are copied with their own names
    return trees.with_rel_path(found, "copy", True, roots=2).select("rel_path", "is_dir", "length")


@query("rel_path_rooting", "", TREE + """
SELECT 'copy' AS mode, '/tree' || rel_path AS rel_path FROM tree UNION ALL SELECT 'copy', '/tree' UNION ALL SELECT 'copy_new', rel_path FROM tree UNION ALL SELECT 'copy_new', '' UNION ALL SELECT 'overwrite', rel_path FROM tree""")
def rel_path_rooting(d):
    root = scratch_path(d.spark, "rooting") + "/tree"
    trees.write_files(contents(d), root)
    found = trees.scan_tree(d.spark, [root])
    kinds = {"copy": ("copy", True), "copy_new": ("copy", False), "overwrite": ("overwrite", True)}
    parts = [trees.with_rel_path(found, mode, exists).select(F.lit(name).alias("mode"), "rel_path")
             for name, (mode, exists) in kinds.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("file_prefix_checksums", "append_candidate", """
SELECT rel_path, md5(substring(content, 1, CAST(target_length AS INT))) AS prefix_checksum FROM append_candidate""")
def file_prefix_checksums(d):
    sizes = d.append_candidate.select("rel_path", F.octet_length(F.substring(
        F.col("content"), F.lit(1), F.col("target_length").cast("int"))).cast("bigint").alias("target_length"))
    return copying.prefix_checksums(sizes, source_tree(d))


SYNCED = """
WITH s AS (SELECT doc_id, strlen(text) AS size, strlen(substring(text, 1, CAST(length(text) - length(text) % 10 - 1 AS INT))) AS cut FROM documents),
plan AS (SELECT CASE WHEN doc_id % 5 = 0 THEN 'OVERWRITE' WHEN doc_id % 13 = 0 THEN 'APPEND' WHEN doc_id % 9 = 0 THEN 'OVERWRITE' ELSE 'SKIP' END AS action, size,
 CASE WHEN doc_id % 5 = 0 THEN size WHEN doc_id % 13 = 0 THEN size - cut WHEN doc_id % 9 = 0 THEN size ELSE 0 END AS bytes FROM s)
"""


def synced(d, atomic=False):
    """Plan and copy the source tree onto the outdated target; returns roots, results and what is to be deleted."""
    src, dst = source_tree(d), target_tree(d)
    options = CopyOptions(sync=True, append=True, delete_missing=True)
    ours, theirs = trees.with_checksums(listed(d, src)), trees.with_checksums(listed(d, dst))
    ours, theirs = (m.withColumn("block_size", F.lit(128)) for m in (ours, theirs))
    prefixes = copying.prefix_checksums(copying.append_candidates(ours, theirs), src)
    plan = copying.plan_copy(ours, theirs, options, prefixes)
    return src, dst, ours, execute.execute_copy(plan, src, dst, options, 4), copying.delete_missing(ours, theirs)


@query("execute_copy", "", SYNCED + """
SELECT action, count(*) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM plan GROUP BY action
UNION ALL SELECT 'MKDIR', (SELECT count(DISTINCT source) FROM documents) + (SELECT count(*) FROM (SELECT DISTINCT source, lang FROM documents)), 0""")
def execute_copy(d):
    return synced(d)[3].groupBy("action").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


@query("verify_copy_before_deletes", "", """
WITH gone AS (SELECT lang, doc_id FROM documents WHERE doc_id % 11 = 0)
SELECT '/stale/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS rel_path, 'missing_on_source' AS problem FROM gone
UNION ALL SELECT DISTINCT '/stale/' || lang, 'missing_on_source' FROM gone UNION ALL SELECT '/stale', 'missing_on_source'""")
def verify_copy_before_deletes(d):
    src, dst, ours, _, _ = synced(d)
    return execute.verify_copy(ours, trees.with_checksums(listed(d, dst)))


@query("execute_deletes", "", "SELECT '/stale' AS rel_path, true AS deleted, CAST(0 AS BIGINT) AS differences")
def execute_deletes(d):
    src, dst, ours, _, gone = synced(d)
    done = execute.execute_deletes(gone, dst)
    left = execute.verify_copy(ours, trees.with_checksums(listed(d, dst))).count()
    return done.withColumn("differences", F.lit(left).cast("bigint"))


@query("execute_copy_again", "", "SELECT 'SKIP' AS action, count(*) AS files FROM documents")
def execute_copy_again(d):
    src, dst, ours, _, _ = synced(d)
    theirs = trees.with_checksums(listed(d, dst)).withColumn("block_size", F.lit(128))
    again = copying.plan_copy(ours, theirs, CopyOptions(sync=True))
    return again.where("not is_dir").groupBy("action").agg(F.count("*").alias("files"))


@query("execute_copy_atomic", "", TREE + "SELECT rel_path, is_dir, length FROM tree")
def execute_copy_atomic(d):
    src, dst = source_tree(d), scratch_path(d.spark, "atomic")
    ours = trees.with_checksums(listed(d, src)).withColumn("block_size", F.lit(128))
    plan = copying.plan_copy(ours, ours.limit(0), CopyOptions(atomic=True))
    execute.execute_copy(plan, src, dst, CopyOptions(atomic=True))
    return listed(d, dst).select("rel_path", "is_dir", "length")


@query("execute_copy_ranges", "", """
WITH f AS (SELECT CAST(strlen(text) AS BIGINT) AS length FROM documents),
r AS (SELECT length, unnest(range((length + 999) // 1000)) AS nth FROM f WHERE length > 1000)
SELECT 'OVERWRITE' AS action, (SELECT count(*) FROM f) AS files, CAST(0 AS BIGINT) AS differences,
 CAST((SELECT sum(length) FROM f WHERE length <= 1000) + (SELECT sum(least(1000, length - 1000 * nth)) FROM r WHERE nth % 2 = 1) AS BIGINT) AS bytes""")
def execute_copy_ranges(d):
    """A copy that broke off when it had every other range of its large files, and goes on."""
    src, dst = source_tree(d), scratch_path(d.spark, "ranges")
    ours = trees.with_checksums(listed(d, src)).withColumn("block_size", F.lit(128))
    plan = copying.plan_copy(ours, ours.limit(0), CopyOptions(overwrite=True))
    large = written(plan.where("action = 'OVERWRITE' AND length > 1000").select("rel_path", "length"), "large")
    ranges.copy_ranges(ranges.ranges_of(large, 1000).where("nth % 2 = 0"), src, dst, 1000)
    done = execute.execute_copy(plan, src, dst, CopyOptions(overwrite=True), range_bytes=1000)
    left = execute.verify_copy(ours, trees.with_checksums(listed(d, dst))).count()
    return done.where("action <> 'MKDIR'").groupBy("action").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes")).withColumn(
        "differences", F.lit(left).cast("bigint"))


@query("execute_moves", "snapshot_new", "SELECT path FROM snapshot_new WHERE NOT is_dir AND file_id < 1000000")
def execute_moves(d):
    root = scratch_path(d.spark, "moves")
    files = d.table("documents").select(F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("rel_path"),
                                        F.col("text").alias("content"))
    trees.write_files(files, root)
    diff = snapshots.snapshot_diff(d.snapshot_old, d.snapshot_new)
    execute.execute_moves(snapshots.sync_ops(diff, root), root)
    return listed(d, root).where("not is_dir").select(F.col("rel_path").alias("path"))


@query("list_directory_of_files", "", """
SELECT '/' || source || '/' || lang AS path, lang AS name FROM documents WHERE source = 'src1' GROUP BY source, lang""")
def list_directory_of_files(d):
    tree = listed(d, source_tree(d)).select(F.col("rel_path").alias("path"), "is_dir", "length")
    nothing = d.spark.createDataFrame([], "path string, key_name string")
    return listing.list_directory(tree, "/src1", nothing, nothing.select("path")).select("path", "name")


@query("read_logs", "log_line", """
SELECT count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars, count(DISTINCT h) AS hours
FROM (SELECT line, date_trunc('hour', ts) AS h FROM log_line JOIN events ON event_id = line_no)
WHERE h + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-02 05:30:00' AND h <= TIMESTAMP '2024-01-03 07:10:00'""")
def read_logs(d):
    """Log lines written to files by hour, every other hour compressed, then read back for a range of time."""
    place = scratch_path(d.spark, "logs")
    lines = d.log_line.join(d.table("events").select(F.col("event_id").alias("line_no"), "ts"), "line_no")
    write_logs(lines.select(F.date_format("ts", "yyyy-MM-dd-HH").alias("hour"), "line_no", "line"), place)
    found = logs.read_logs(d.spark, place, datetime(2024, 1, 2, 5, 30), datetime(2024, 1, 3, 7, 10), datetime(2024, 3, 1), "server")
    hour = F.regexp_extract("name", r"log\.([0-9-]+)", 1)
    return found.agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("chars"), F.countDistinct(hour).alias("hours"))


def write_logs(lines, place):
    """One file per hour and batch, as many hosts would write them, so that no task holds a whole hour."""

    def write(frames):
        fs, base = open_root(place)
        for frame in frames:
            for hour, part in frame.groupby("hour"):
                data = ("\n".join(part.sort_values("line_no")["line"]) + "\n").encode()
                # the first line number tells the files of an hour apart, also when a task runs again
                name = f"{base}/server-{part['line_no'].min()}.log.{hour}"
                if int(hour[-2:]) % 2:
                    name, data = name + ".gz", gzip.compress(data)
                make_parent(fs, name)
                with fs.open_output_stream(name, compression=None) as out:
                    out.write(data)
            yield frame[["line_no"]]

    written(lines.mapInPandas(write, "line_no bigint"), "log-lines")


# splits of a log, at the most about
SPLITS = 2048


def split_bytes(size):
    return max(4096, math.ceil(size / SPLITS))


@query("log_records_of_hosts", "log_line", r"""
WITH marked AS (SELECT line_no, line, line_no // 3 % 2 AS host, CASE WHEN regexp_matches(line, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}\s+\w+\s+') THEN 1 ELSE 0 END AS starts FROM log_line),
counted AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY host ORDER BY line_no) AS BIGINT) AS record FROM marked)
SELECT CAST(host AS VARCHAR) AS host, record, string_agg(line, chr(10) ORDER BY line_no) AS text FROM counted WHERE record > 0 GROUP BY host, record""")
def log_records_of_hosts(d):
    """Whole records from two folders with files of one name, each read in many splits: of 4 KB, or of large logs about
    SPLITS, as each split is a task that reports to the driver."""
    place = host_logs(d, "hosts", 1 << 62)
    fs, base = open_root(place)
    size = sum(f.size or 0 for f in fs.get_file_info(FileSelector(base, recursive=True)))
    key = "spark.sql.files.maxPartitionBytes"
    before = d.spark.conf.get(key)
    try:
        d.spark.conf.set(key, str(split_bytes(size)))  # the lines are placed while the records are put together
        now = datetime(2024, 3, 1)
        lines = logs.read_logs(d.spark, f"{place}/*", datetime(2024, 2, 29), now, now, "server")
        records = assemble_log_records(lines, logs.LINE_ORDER)
    finally:
        d.spark.conf.set(key, before)
    return records.select(F.regexp_extract("file", "/h([01])/", 1).alias("host"), "record", "text")


def host_logs(d, purpose, span):
    """The log lines of two hosts, every three lines from another one, in files ``/h<host>/server.log`` and so on, each of
    ``span`` line numbers; every other one is packed. A file is written line by line by the task that holds its range."""
    place = scratch_path(d.spark, purpose)
    host, part = F.floor(F.col("line_no") / 3) % 2, F.floor(F.col("line_no") / span)
    rows = d.log_line.select(host.alias("host"), part.alias("part"), "line_no", "line")

    def write(frames):
        fs, base = open_root(place)
        now, out = None, None
        for frame in frames:
            for (host, part), lines in frame.groupby(["host", "part"], sort=False):
                if (host, part) != now:
                    if out:
                        out.close()
                    now, name = (host, part), f"{base}/h{host}/server.log" + (f".{part}" if part else "") + (".gz" if part % 2 else "")
                    make_parent(fs, name)
                    out = fs.open_output_stream(name, compression="gzip" if part % 2 else None)
                out.write(("\n".join(lines["line"]) + "\n").encode())
        if out:
            out.close()
        yield from ()

    # a file is a stream of its lines, whatever their number
    dealt = rows.repartition("host", "part").sortWithinPartitions("host", "part", "line_no")
    written(dealt.mapInPandas(write, "line_no bigint"), "host-logs")
    return place


@query("search_logs_by_index", "log_line", r"""
WITH marked AS (SELECT line_no, line, line_no // 3 % 2 AS host, line_no // 500 AS part, CASE WHEN regexp_matches(line, '^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}\s+\w+\s+') THEN 1 ELSE 0 END AS starts FROM log_line),
counted AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY host, part ORDER BY line_no) AS BIGINT) AS record FROM marked),
records AS (SELECT host, part, record, max(CASE WHEN starts = 1 THEN line END) AS first, string_agg(line, chr(10) ORDER BY line_no) AS text FROM counted WHERE record > 0 GROUP BY host, part, record)
SELECT CAST(host AS VARCHAR) AS host, record, left(first, 23) AS time, text FROM records
WHERE left(first, 23) >= '2024-01-03 06:00:00' AND left(first, 23) <= '2024-01-09 12:30:00' AND regexp_matches(first, 'POLICYNAME\[p7\]|POLICYID\[11\]')""")
def search_logs_by_index(d):
    """Two runs of the indexer, the second with nothing to do, and a search that opens the blocks that may hold a hit."""
    place, index = host_logs(d, "indexed", 500), scratch_path(d.spark, "log-index")
    found = written(log_index.list_logs(d.spark, f"{place}/*", "server"), "logs")
    for _ in range(2):
        log_index.update_index(found, index, 4096)
    hits = log_index.search_index(found, index, {"policyname": "p7", "policyid": "11"}, datetime(2024, 1, 3, 6), datetime(2024, 1, 9, 12, 30))
    return hits.select(F.regexp_extract("file", "/h([01])/", 1).alias("host"), "record", "time", "text")


@query("execute_attributes", "", """
SELECT '/' || source || '/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS rel_path,
 CASE doc_id % 3 WHEN 0 THEN 'rw-r-----' WHEN 1 THEN 'rwxr-xr-x' ELSE 'rw-rw-r--' END AS permission, TIMESTAMP '2020-02-03 04:05:06' AS mtime, 0 AS left_to_fix FROM documents
UNION ALL SELECT DISTINCT '/' || source || '/' || lang, 'rwxr-x--x', TIMESTAMP '2020-02-03 04:05:06', 0 FROM documents
UNION ALL SELECT DISTINCT '/' || source, 'rwxr-x--x', TIMESTAMP '2020-02-03 04:05:06', 0 FROM documents""")
def execute_attributes(d):
    """Attributes given to the source tree, copied with it, and nothing left to fix after the copy."""
    src, dst = source_tree(d), target_tree(d)
    number = F.regexp_extract("rel_path", "([0-9]+)[.]txt$", 1).try_cast("bigint") % 3
    wanted = listed(d, src).withColumns({
        "permission": F.when(F.col("is_dir"), "rwxr-x--x").when(number == 0, "rw-r-----").when(number == 1, "rwxr-xr-x").otherwise("rw-rw-r--"),
        "mtime": F.lit(datetime(2020, 2, 3, 4, 5, 6)).cast("timestamp_ntz"),
        "attributes": F.array(F.lit("PERMISSION"), F.lit("TIMES"))})
    execute.execute_attributes(wanted, src)
    options = CopyOptions(sync=True, preserve=frozenset({"BLOCKSIZE", "PERMISSION", "USER", "GROUP", "TIMES"}))
    ours, theirs = trees.with_checksums(listed(d, src)), trees.with_checksums(listed(d, dst))
    execute.execute_copy(execute.with_attributes(copying.plan_copy(ours, theirs, options), ours), src, dst, options)
    # what the copy skipped keeps its own attributes until they are fixed
    fixes = copying.attributes_to_fix(ours, written(listed(d, dst), "copied"), sorted(options.preserve))
    execute.execute_attributes(execute.with_attributes(fixes, ours), dst)
    theirs = written(listed(d, dst), "fixed")
    left = copying.attributes_to_fix(ours, theirs, sorted(options.preserve - {"TIMES"})).count()
    found = ours.select("rel_path").join(theirs, "rel_path")
    return found.select("rel_path", "permission", "mtime", F.lit(left).alias("left_to_fix"))


@query("execute_sync", "", """
SELECT step, CAST(0 AS BIGINT) AS differences FROM (VALUES ('forward'), ('back')) AS t(step)""")
def execute_sync(d):
    """The tree of the old snapshot taken to the new one and back again, each time by its difference alone."""
    old, new, dst = (scratch_path(d.spark, name) for name in ("old", "new", "synced"))
    docs, number = d.table("documents"), F.col("doc_id").cast("string")
    at = lambda folder, name: F.concat(F.lit("/"), folder, F.lit("/"), name, F.lit(".txt"))
    before = docs.select(at(F.col("source"), number).alias("rel_path"), F.col("text").alias("content"))
    home = F.when(F.col("doc_id") % 14 == 3, "src0").when(F.col("source") == "src3", "src3_moved").otherwise(F.col("source"))
    text = F.when(F.col("doc_id") % 10 == 1, F.concat(F.lit("m"), "text")).otherwise(F.col("text"))
    kept = F.when(F.col("doc_id") % 6 != 0, F.struct(at(home, number).alias("rel_path"), text.alias("content")))
    new_one = F.struct(at(F.lit("src1"), F.concat(F.lit("new"), number)).alias("rel_path"), F.col("text").alias("content"))
    added = F.when(F.col("doc_id") % 15 == 2, new_one)
    # in one pass over the documents
    after = docs.select(F.inline(F.array_compact(F.array(kept, added))))
    trees.write_files(before, [old, dst])
    trees.write_files(after, new)
    manifests = [trees.with_checksums(listed(d, root)) for root in (old, new)]
    # both are read in many steps and hold a checksum of each text
    snapshots_of = [written(d.snapshot_old, "snapshot"), written(d.snapshot_new, "snapshot")]
    times, steps = [datetime(2024, 1, 1), datetime(2024, 1, 2)], []
    for step, a, b in (("forward", 0, 1), ("back", 1, 0)):
        options = CopyOptions(sync=True, diff=a < b, reverse_diff=a > b, from_snapshot="a", to_snapshot="b")
        plan = snapshots.plan_sync(snapshots_of[a], snapshots_of[b], snapshots_of[a], snapshots_of[a], times[a], times[b], dst,
                                   manifests[b], manifests[a], options)
        assert plan.kind == "incremental"
        execute.execute_sync(plan, (old, new)[b], dst, options, manifests[b])
        differences = execute.verify_copy(manifests[b], trees.with_checksums(listed(d, dst)))
        # a folder that has lost all its files stays, as snapshots list folders only with what is in them
        differences = differences.where("problem <> 'missing_on_source' OR rel_path LIKE '%.txt'")
        steps.append(differences.agg(F.lit(step).alias("step"), F.count("*").alias("differences")))
    return steps[0].unionByName(steps[1])
