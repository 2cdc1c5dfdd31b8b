"""Listing of file trees into manifests."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import paths
from driftline.sources import files
from driftline.sources.scratch import spread, spread_in_order, written

FOUND = "root string, root_path string, path string, is_dir boolean, length bigint, mtime_ns bigint"
_FOUND = [part.split()[0] for part in FOUND.split(", ")]
LISTED = ("root string, root_path string, path string, is_dir boolean, length bigint, mtime timestamp_ntz, "
          "atime timestamp_ntz, owner string, group string, permission string, block_size bigint, replication int, "
          "acl string, xattrs map<string,string>")
_COLUMNS = [part.split()[0] for part in LISTED.split(", ")]
_BATCH = 5000
# the attributes of a path as they are in LISTED, with their types; atime stands before them
_FACTS = {"owner": pa.string(), "group": pa.string(), "permission": pa.string(), "block_size": pa.int64(), "replication": pa.int32(),
          "acl": pa.string(), "xattrs": pa.map_(pa.string(), pa.string())}


def _found(root: str, root_path: str, info: pafs.FileInfo) -> tuple:
    is_dir = info.type == pafs.FileType.Directory
    return root, root_path, info.path, is_dir, 0 if is_dir else info.size, info.mtime_ns or 0


def _list_children(batches):
    for batch in batches:
        rows: list[tuple] = []
        for root, path in zip(batch["root"], batch["path"]):
            fs, root_path = files.open_root(root)
            # a directory that vanished since its parent was listed counts as empty
            selector = pafs.FileSelector(path, allow_not_found=True)
            for info in files.retried(lambda: fs.get_file_info(selector)):
                rows.append(_found(root, root_path, info))
                if len(rows) >= _BATCH:
                    yield pd.DataFrame(rows, columns=_FOUND)
                    rows = []
        yield pd.DataFrame(rows, columns=_FOUND)


def _list_roots(batches):
    for batch in batches:
        rows = []
        for root in batch["root"]:
            fs, path = files.open_root(root)
            info = files.retried(lambda: files.kind(fs, path))
            if info.type != pafs.FileType.NotFound:
                rows.append(_found(root, path, info))
        yield pd.DataFrame(rows, columns=_FOUND)


def _describe(batches):
    """Rows of FOUND to rows of LISTED, without files that have vanished since they were listed."""
    for batch in batches:
        known = []
        for root, path in zip(batch.column("root").to_pylist(), batch.column("path").to_pylist()):
            fs, _ = files.open_root(root)
            try:
                known.append(files.retried(lambda: files.attributes(fs, path)))
            except FileNotFoundError:
                known.append(None)
        here = batch.filter(pa.array([k is not None for k in known], pa.bool_()))
        known = [k for k in known if k is not None]
        changed = np.asarray(here.column("mtime_ns"), np.int64) // 1000
        seen = [None if k["atime_ns"] is None else k["atime_ns"] // 1000 for k in known]
        facts = [pa.array([k[name] if name != "xattrs" or k[name] is None else list(k[name].items()) for k in known], kind)
                 for name, kind in _FACTS.items()]
        yield pa.RecordBatch.from_arrays([*here.columns[:-1], pa.array(changed, pa.timestamp("us")), pa.array(seen, pa.timestamp("us")), *facts],
                                         _COLUMNS)


def _listed(found: DataFrame) -> DataFrame:
    """Listing a directory is one task, whatever it holds; the attributes of its entries are read by all tasks."""
    return written(spread(found, F.xxhash64("path")).mapInArrow(_describe, LISTED), "scan")


def scan_tree(spark: SparkSession, roots: list[str] | DataFrame, expand_rounds: int | None = None) -> DataFrame:
    """Recursive listing of ``roots`` (a list, or a DataFrame with ``root``): one row per file and directory.

    Directories of one level are listed in parallel and written before the next level starts, so there are as many jobs
    as the tree is deep. Attributes are read in a step of their own, so that one large directory keeps no task busy alone. ``expand_rounds`` stops after that many levels. A missing root gives no rows.
    """
    return _levels(spark, roots, _listed, expand_rounds)


def list_tree(spark: SparkSession, roots: list[str] | DataFrame, hidden: Column) -> DataFrame:
    """Rows of FOUND as :func:`scan_tree` finds them, without their attributes. Below the roots, entries for whose ``name``
    ``hidden`` holds are left out with all they contain."""
    def shown(found: DataFrame) -> DataFrame:
        named = found.withColumn("name", F.substring_index("path", "/", -1))
        return written(named.where((F.col("path") == F.col("root_path")) | ~hidden).drop("name"), "list")

    return _levels(spark, roots, shown)


def _levels(spark: SparkSession, roots: list[str] | DataFrame, finish: Callable[[DataFrame], DataFrame],
            expand_rounds: int | None = None) -> DataFrame:
    """What ``finish`` makes, and writes, of the entries of each level."""
    start = spark.createDataFrame([(r,) for r in roots], "root string") if isinstance(roots, list) else roots
    level = finish(start.select("root").distinct().mapInPandas(_list_roots, FOUND))
    found, rounds = level, 0
    while expand_rounds is None or rounds < expand_rounds:
        below = level.where("is_dir").select("root", "path")
        if below.isEmpty():
            break
        dealt = spread(below, F.xxhash64("root", "path"))
        level = finish(dealt.mapInPandas(_list_children, FOUND))
        found, rounds = found.unionByName(level), rounds + 1
    return found


def _expand_roots(batches):
    for batch in batches:
        found = []
        for pattern in batch["pattern"]:
            matches = files.retried(lambda: files.expand(pattern))
            if not matches:
                raise FileNotFoundError(f"no path matches {pattern}")
            found += matches
        yield pd.DataFrame({"root": found})


def scan_globs(spark: SparkSession, patterns: list[str] | DataFrame, expand_rounds: int | None = None) -> DataFrame:
    """Roots matching glob patterns (``*``, ``?``, ``[ab]``, ``{a,b}``), listed as by :func:`scan_tree`.

    ``patterns`` is a list, or a DataFrame with ``pattern``. A pattern that matches nothing is an error.
    """
    wanted = spark.createDataFrame([(p,) for p in patterns], "pattern string") if isinstance(patterns, list) else patterns
    dealt = spread(wanted.select("pattern").distinct(), F.xxhash64("pattern"))
    return scan_tree(spark, written(dealt.mapInPandas(_expand_roots, "root string"), "roots"), expand_rounds)


def scan_from_list(spark: SparkSession, list_path: str) -> DataFrame:
    """As :func:`scan_globs` for the patterns in a text file, one per line; blank lines are left out."""
    lines = spark.read.text(list_path).select(F.trim("value").alias("pattern")).where("pattern <> ''")
    return scan_globs(spark, lines)


def with_rel_path(listed: DataFrame, mode: str = "copy", target_exists: bool = True,
                  target_is_file: bool = False, roots: int = 1) -> DataFrame:
    """Adds ``rel_path``, the path below the copy root.

    ``mode`` is copy, sync or overwrite. The contents of a root directory are copied for sync, overwrite, or a single
    root with a new target; otherwise the directory's own name is part of the path. A lone file is its own copy root
    when the target is a file or does not exist.
    """
    if mode not in ("copy", "sync", "overwrite"):
        raise ValueError(f"unknown mode {mode}")
    root = paths.strip_slash(F.col("root_path"))
    contents_only = mode != "copy" or (roots == 1 and not target_exists)
    lone_itself = roots == 1 and (target_is_file or not target_exists)
    root_is_file = (F.col("path") == root) & ~F.col("is_dir")
    keep_root = F.when(root_is_file, F.lit(lone_itself)).otherwise(F.lit(contents_only) | (root == "/"))
    copy_root = F.when(keep_root, root).otherwise(paths.parent(root))
    base = F.when(copy_root == "/", F.lit(0)).otherwise(F.length(copy_root))
    placed = listed.withColumn("rel_path", F.col("path").substr(base + 1, F.length("path")))
    if mode != "copy":
        placed = placed.where(~((F.col("rel_path") == "") & F.col("is_dir")))
    return placed


def _write_files(roots: list[str]):
    def run(batches):
        opened, made = [files.open_root(root) for root in roots], set()
        for batch in batches:
            for rel_path, content in zip(batch["rel_path"], batch["content"]):
                data = content if isinstance(content, bytes) else content.encode("utf-8")
                for fs, base in opened:
                    path = base.rstrip("/") + rel_path
                    files.make_parent(fs, path, made)
                    with fs.open_output_stream(path) as out:
                        out.write(data)
            yield batch[["rel_path"]]

    return run


def write_files(df: DataFrame, root: str | list[str]) -> DataFrame:
    """Write each row's ``content`` to ``root`` + ``rel_path``; returns the written paths.

    Of several roots each gets all files; the contents are computed and dealt over the tasks once for all of them.
    """
    dealt = spread_in_order(df.select("rel_path", "content"), "rel_path")
    return written(dealt.mapInPandas(_write_files([root] if isinstance(root, str) else root), "rel_path string"), "files")


def _digest_rows(batches):
    for batch in batches:
        found = []
        for root, path, is_dir, limit in zip(batch["root"], batch["path"], batch["is_dir"], batch["limit"]):
            if is_dir:
                found.append(None)
                continue
            fs, _ = files.open_root(root)
            size = None if pd.isna(limit) else int(limit)
            found.append(files.retried(lambda: files.digest(fs, path, size)))
        yield pd.DataFrame({"root": batch["root"], "path": batch["path"], "checksum": found})


def checksums(listed: DataFrame, limit=None) -> DataFrame:
    """(root, path, checksum) of listed files; ``limit`` is a Column with the number of leading bytes to read."""
    size = F.lit(None).cast("bigint") if limit is None else limit.cast("bigint")
    rows = listed.select("root", "path", "is_dir", size.alias("limit"))
    return spread(rows, F.xxhash64("root", "path")).mapInPandas(_digest_rows, "root string, path string, checksum string")


def _with_digests(batches):
    for batch in batches:
        rows = pd.DataFrame({"root": batch.column("root").to_pylist(), "path": batch.column("path").to_pylist(),
                             "is_dir": batch.column("is_dir").to_pylist(), "limit": None})
        found = next(_digest_rows([rows]))["checksum"].tolist()
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "checksum"])


def with_checksums(listed: DataFrame) -> DataFrame:
    """``listed`` with the ``checksum`` of each file, in one pass and written, so no file is read again and nothing joined.

    Tasks read in the order of the paths, as files are mostly written.
    """
    rows = listed.select("root", "path", *[c for c in listed.columns if c not in ("root", "path")])
    schema = T.StructType([*rows.schema.fields, T.StructField("checksum", T.StringType())])
    return written(spread(rows, F.xxhash64("root", "path")).sortWithinPartitions("path").mapInArrow(_with_digests, schema), "checksums")
