"""What to copy, append, skip, delete and correct, decided by joining two manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.ancestors import containing
from driftline.plans.options import CopyOptions
from driftline.sources import trees
from driftline.sources.scratch import written


def exclude_find(manifest: DataFrame, regex: str, path: str = "rel_path") -> DataFrame:
    """Drop paths in which the regex finds a match anywhere."""
    return manifest.where(~F.col(path).rlike(regex))


# Fixed value: temporary, hidden and trash files left out by default.
DEFAULT_EXCLUDE = r"\/.*_COPYING_$|\/.*_COPYING$|^.*\/\.[^\/]*$|\/_temporary$|\/\_temporary\/|.*/\.Trash\/.*"


def exclude_fullmatch(manifest: DataFrame, regexes: list[str], path: str = "rel_path") -> DataFrame:
    """Drop paths that one of the regexes matches as a whole."""
    if not regexes:
        return manifest
    return manifest.where(~F.col(path).rlike("^(?:" + "|".join(f"(?:{r})" for r in regexes) + ")$"))


def duplicate_paths(manifest: DataFrame) -> DataFrame:
    """Relative paths that more than one source maps to, with how many and the first and last source."""
    return (manifest.groupBy("rel_path")
            .agg(F.count("*").alias("sources"), F.min("path").alias("first_source"), F.max("path").alias("last_source"))
            .where("sources > 1"))


def prefix_checksum(content: Column, size: Column) -> Column:
    """Checksum of the first ``size`` characters or bytes of a content column."""
    return F.md5(F.substring(content, F.lit(1), size.cast("int")))


def prefix_checksums(candidates: DataFrame, read_root: str) -> DataFrame:
    """(rel_path, prefix_checksum) of append candidates (rel_path, target_length), read from files under a root."""
    base = trees.files.open_root(read_root)[1].rstrip("/")
    rows = candidates.select(
        F.lit(read_root).alias("root"), F.concat(F.lit(base), "rel_path").alias("path"),
        F.lit(False).alias("is_dir"), "target_length")
    done = trees.checksums(rows, F.col("target_length"))
    return done.select(F.col("path").substr(F.lit(len(base) + 1), F.length("path")).alias("rel_path"),
                       F.col("checksum").alias("prefix_checksum"))


def append_candidates(source: DataFrame, target: DataFrame) -> DataFrame:
    """Files whose target is shorter: the only ones whose prefix must be read."""
    theirs = target.where("not is_dir").select("rel_path", F.col("length").alias("target_length"))
    return (source.where("not is_dir").join(theirs, "rel_path")
            .where("target_length < length").select("rel_path", "target_length"))


def plan_copy(source: DataFrame, target: DataFrame, options: CopyOptions,
              prefixes: DataFrame | None = None) -> DataFrame:
    """(rel_path, action, reason, bytes) for each row of the source manifest.

    Actions are SKIP, APPEND, OVERWRITE, MKDIR and ERROR. ``prefixes`` (rel_path, prefix_checksum) is needed for append
    mode only: without a prefix checksum nothing is appended.
    """
    options.checked()
    overwrite = options.overwrite or options.target_is_file
    theirs = target.select("rel_path", *[F.col(c).alias(f"t_{c}") for c in
                                         ("is_dir", "length", "block_size", "checksum")])
    both = source.join(theirs, "rel_path", "left")
    if options.append and prefixes is not None:
        both = both.join(prefixes.select("rel_path", "prefix_checksum"), "rel_path", "left")
    else:
        both = both.withColumn("prefix_checksum", F.lit(None).cast("string"))

    missing = F.col("t_is_dir").isNull()
    same_length = F.col("length") == F.col("t_length")
    keep_block = "BLOCKSIZE" in options.preserve
    same_block = (F.col("block_size") == F.col("t_block_size")) if keep_block else F.lit(True)
    # a checksum that cannot be had on either side counts as equal here, and as different for an append
    unknown_sum = F.col("checksum").isNull() | F.col("t_checksum").isNull()
    same_sum = F.lit(options.skip_crc) | unknown_sum | (F.col("checksum") == F.col("t_checksum"))
    can_append = F.coalesce(
        F.lit(options.append) & (F.col("t_length") < F.col("length"))
        & (F.col("prefix_checksum") == F.col("t_checksum")), F.lit(False))
    cases = [
        (~missing & (F.col("is_dir") != F.col("t_is_dir")), "ERROR", "type_clash"),
        (F.col("is_dir"), "MKDIR", "directory"),
        (missing, "OVERWRITE", "missing"),
        (F.lit(overwrite), "OVERWRITE", "overwrite"),
        (F.lit(not options.sync), "SKIP", "exists"),
        (same_length & same_block & same_sum, "SKIP", "same"),
        (can_append, "APPEND", "longer"),
        (~same_length, "OVERWRITE", "length"),
        (~same_block, "OVERWRITE", "block_size"),
    ]
    verdict = None
    for test, action, reason in cases:
        answer = F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
        verdict = F.when(test, answer) if verdict is None else verdict.when(test, answer)
    verdict = verdict.otherwise(F.struct(F.lit("OVERWRITE").alias("action"), F.lit("checksum").alias("reason")))
    size = (F.when(F.col("action") == "OVERWRITE", F.col("length"))
            .when(F.col("action") == "APPEND", F.col("length") - F.col("t_length")).otherwise(F.lit(0)))
    return (both.withColumn("__verdict", verdict)
            .select("rel_path", "is_dir", "length", "t_length", "__verdict.*")
            .select("rel_path", "action", "reason", size.cast("bigint").alias("bytes"), "is_dir", "length"))


def plan_summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action", "reason").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))


def delete_missing(source: DataFrame, target: DataFrame, exclude: str | None = None) -> DataFrame:
    """Target paths to delete because the source has none; a deleted directory covers what is below it.

    ``exclude`` is the copy's exclude regex: files it leaves out of the listing are never deleted either.
    """
    theirs = target if exclude is None else exclude_find(target, exclude)
    gone = theirs.join(source.select("rel_path"), "rel_path", "left_anti").select("rel_path", "is_dir")
    # far smaller than the manifests, and needed on both sides of the join below
    gone = written(gone, "gone")
    dirs = gone.where("is_dir").select(F.col("rel_path").alias("gone_dir"))
    held = containing(gone, dirs, "rel_path", "gone_dir", "shallowest", include_self=False, how="left")
    return held.where("gone_dir is null").drop("gone_dir")


def copy_counters(results: DataFrame, by: list[str]) -> DataFrame:
    """COPY, DIR_COPY, SKIP, FAIL and the byte counters, per ``by``.

    ``results`` has action (OVERWRITE, APPEND, MKDIR, SKIP, FAIL), length and bytes (what was written).
    """
    wrote = F.col("action").isin("OVERWRITE", "APPEND")

    def total(test: Column, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, value)), F.lit(0)).cast("bigint")

    one = F.lit(1)
    return results.groupBy(*by).agg(
        total(wrote, one).alias("copied"),
        total(F.col("action") == "MKDIR", one).alias("dir_copied"),
        total(F.col("action") == "SKIP", one).alias("skipped"),
        total(F.col("action") == "FAIL", one).alias("failed"),
        total(wrote, F.col("bytes")).alias("bytes_copied"),
        total(wrote, F.col("length")).alias("bytes_expected"),
        total(F.col("action") == "FAIL", F.col("length")).alias("bytes_failed"),
        total(F.col("action") == "SKIP", F.col("length")).alias("bytes_skipped"),
    )


def attributes_to_fix(source: DataFrame, target: DataFrame, preserve: list[str],
                      raw_xattrs: bool = False) -> DataFrame:
    """(rel_path, is_dir, attributes): which preserved attributes of existing targets differ.

    ACL outranks permission (under ACL only the sticky bit is still compared); replication is for files only; times are
    always set; ``raw.*`` extended attributes follow their own flag.
    """
    wanted = set(preserve)
    columns = set(source.columns) & set(target.columns) - {"rel_path"}
    theirs = target.select("rel_path", *[F.col(c).alias(f"t_{c}") for c in columns])
    both = source.join(theirs, "rel_path")

    def differs(column: str) -> Column:
        return ~F.col(column).eqNullSafe(F.col(f"t_{column}")) if column in columns else F.lit(False)

    def sticky(column: str) -> Column:
        return F.lower(F.substring(column, -1, 1)) == "t"

    # map values cannot be compared directly: as sorted entries they can
    def entries(column: str) -> Column:
        return F.sort_array(F.map_entries(F.col(column)))

    tests: list[tuple[str, Column]] = []
    if "REPLICATION" in wanted:
        tests.append(("REPLICATION", ~F.col("is_dir") & differs("replication")))
    if "BLOCKSIZE" in wanted:
        tests.append(("BLOCKSIZE", ~F.col("is_dir") & differs("block_size")))
    if "USER" in wanted:
        tests.append(("USER", differs("owner")))
    if "GROUP" in wanted:
        tests.append(("GROUP", differs("group")))
    if "ACL" in wanted:
        tests.append(("ACL", differs("acl")))
        if "permission" in columns:
            tests.append(("PERMISSION", sticky("permission") != sticky("t_permission")))
    elif "PERMISSION" in wanted:
        tests.append(("PERMISSION", differs("permission")))
    if "CHECKSUMTYPE" in wanted:
        tests.append(("CHECKSUMTYPE", ~F.col("is_dir") & differs("checksum_type")))
    if ("XATTR" in wanted or raw_xattrs) and "xattrs" in columns:
        # raw.* names are listed only under their own flag, the others only when XATTR is preserved
        ours, held = F.col("xattrs"), F.col("t_xattrs")
        for column in ("xattrs", "t_xattrs"):
            if not raw_xattrs:
                both = both.withColumn(column, F.map_filter(column, lambda k, _: ~k.startswith("raw.")))
            if "XATTR" not in wanted:
                both = both.withColumn(column, F.map_filter(column, lambda k, _: k.startswith("raw.")))
        tests.append(("XATTR", ours.isNotNull() & (F.size(ours) > 0)
                      & ~entries("xattrs").eqNullSafe(F.when(held.isNotNull(), entries("t_xattrs")))))
    if "TIMES" in wanted:
        tests.append(("TIMES", F.lit(True)))
    if not tests:
        return both.select("rel_path", "is_dir", F.array().cast("array<string>").alias("attributes")).limit(0)
    found = F.array_compact(F.array(*[F.when(test, F.lit(label)) for label, test in tests]))
    return both.select("rel_path", "is_dir", found.alias("attributes")).where(F.size("attributes") > 0)
