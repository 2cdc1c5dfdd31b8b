"""Snapshots stored with a digest per directory, and differences that go down only where digests differ.

The digest of a directory is made of its entries (id, name, kind, checksum, attributes) and of the digests of the
directories among them, so it stands for all that lies below. Entries are stored in buckets by their directory. A
difference starts at the top and lists a directory only if its digest differs, or if it is in one of the snapshots alone:
what is read follows the number of changes, not the size of the tree.
"""

from __future__ import annotations

import json
import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.functions import paths
from driftline.plans.snapshots import ATTRIBUTES, compare
from driftline.sources.scratch import scratch_path, written

#: about so many entries share a bucket
BUCKET_ROWS = 100_000
#: bucket of the entries whose directory is not part of the snapshot, as the root
TOPS = -1
DIGEST = ["digest_a", "digest_b"]


def with_digests(snapshot: DataFrame) -> DataFrame:
    """Entries with ``digest_a`` and ``digest_b`` (null for files), made level by level from the deepest directories up.

    The digests of a directory's entries are combined by XOR, so tasks combine their own entries before they are shuffled
    and a directory with very many entries is no hot key.
    """
    kinds = dict(snapshot.dtypes)
    told = [c for c in ["checksum", *ATTRIBUTES] if c in snapshot.columns]
    values = [F.sort_array(F.map_entries(c)) if kinds[c].startswith("map") else F.col(c) for c in told]
    marks = [F.col(c).isNull() for c in told]  # a null is no part of a hash
    place = scratch_path(snapshot.sparkSession, "levels")
    own = [F.xxhash64(F.lit(n), "file_id", "name", "is_dir", *values, *marks).alias(f"own_{d}") for n, d in enumerate(DIGEST)]
    snapshot.select("file_id", "parent_id", "is_dir", paths.depth(F.col("path")).alias("level"), *own).write.partitionBy("level").parquet(place)
    entries = snapshot.sparkSession.read.schema("file_id long, parent_id long, is_dir boolean, own_digest_a long, own_digest_b long, level int").parquet(place)
    deepest = entries.agg(F.max("level")).first()[0]
    below, parts = None, []
    for level in range(deepest if deepest is not None else -1, -1, -1):
        rows = entries.where(F.col("level") == level)
        if below is not None:
            rows = rows.join(below.withColumnRenamed("dir", "file_id"), "file_id", "left")
        else:
            rows = rows.withColumns({d: F.lit(None).cast("long") for d in DIGEST})
        whole = [F.bit_xor(F.xxhash64(f"own_{d}", F.coalesce(d, F.lit(0)))).alias(d) for d in DIGEST]
        below = written(rows.groupBy(F.col("parent_id").alias("dir")).agg(*whole), "digests")
        parts.append(below.where("dir IS NOT NULL"))
    none = snapshot.sparkSession.createDataFrame([], "dir long, digest_a long, digest_b long")
    # a directory's entries lie on one level, so each directory has one row
    known = reduce(DataFrame.unionByName, parts, none).withColumnRenamed("dir", "file_id")
    zero = [F.when(F.col("is_dir"), F.coalesce(d, F.lit(0))).alias(d) for d in DIGEST]
    return snapshot.join(known, "file_id", "left").select(*snapshot.columns, *zero)


class StoredSnapshot:
    """A snapshot that :func:`store` has written."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        facts = json.loads(spark.read.schema("value string").text(f"{self.path}/facts").first()["value"])
        self.buckets, self.schema = facts["buckets"], T.StructType.fromJson(facts["schema"])

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/entries")

    def attributes(self) -> list[str]:
        return [c for c in ["checksum", *ATTRIBUTES] if c in self.schema.names]

    def tops(self) -> DataFrame:
        return self.entries().where(F.col("bucket") == TOPS).drop("bucket")

    def listed(self, dirs: DataFrame) -> DataFrame:
        """The entries of directories (``file_id``); only their buckets are read."""
        wanted = dirs.select(F.col("file_id").alias("parent_id"), bucket_of("file_id", self.buckets).alias("bucket"))
        touched = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]  # as many as there are buckets at most
        rows = self.entries().where(F.col("bucket").isin(touched))
        return rows.join(wanted, ["bucket", "parent_id"], "left_semi").select(*[c for c in self.schema.names if c != "bucket"])


def bucket_of(directory: str, buckets: int):
    return F.pmod(F.xxhash64(directory), F.lit(buckets)).cast("int")


def store(snapshot: DataFrame, path: str, bucket_rows: int = BUCKET_ROWS) -> StoredSnapshot:
    """Write a snapshot (file_id, parent_id, name, path, is_dir, checksum, attributes) with its digests."""
    spark = snapshot.sparkSession
    digested = written(with_digests(snapshot), "digested")
    buckets = max(1, math.ceil(digested.count() / bucket_rows))
    dirs = digested.where("is_dir").select(F.col("file_id").alias("parent_id"), F.lit(True).alias("__known"))
    bucket = F.when(F.col("__known"), bucket_of("parent_id", buckets)).otherwise(TOPS)
    rows = digested.join(dirs, "parent_id", "left").select(*digested.columns, bucket.alias("bucket"))
    # by range, so that a directory with very many entries is written by several tasks
    ordered = rows.repartitionByRange("bucket", "parent_id", "file_id").sortWithinPartitions("bucket", "parent_id", "file_id")
    ordered.write.mode("overwrite").partitionBy("bucket").parquet(f"{path.rstrip('/')}/entries")
    facts = json.dumps({"buckets": buckets, "schema": rows.schema.jsonValue()})
    spark.createDataFrame([(facts,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path.rstrip('/')}/facts")
    return StoredSnapshot(spark, path)


def _equal(columns: list[str], left: str, right: str):
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def unchanged(old: StoredSnapshot, new: StoredSnapshot) -> bool:
    """Whether two snapshots hold the same, told by their tops alone."""
    if old.attributes() != new.attributes():
        return compare(old.entries().drop("bucket"), new.entries().drop("bucket")).isEmpty()
    columns = [c for c in ["file_id", "parent_id", "name", "is_dir", *old.attributes(), *DIGEST]]
    maps = [c for c in columns if isinstance(old.schema[c].dataType, T.MapType)]
    fixed = [F.sort_array(F.map_entries(c)).alias(c) if c in maps else F.col(c) for c in columns]
    one, two = old.tops().select(*fixed), new.tops().select(*fixed)
    same = one.alias("o").join(two.alias("n"), _equal(columns, "o", "n"), "full_outer")
    return same.where(F.col("o.file_id").isNull() | F.col("n.file_id").isNull()).isEmpty()


def changed_entries(old: StoredSnapshot, new: StoredSnapshot) -> tuple[DataFrame, DataFrame]:
    """The entries of both snapshots that can be part of their difference: those of all directories whose digests differ, or
    that are in one of them alone, or that such a walk has had to list on the other side.

    A directory that moved is looked for on both sides before it counts as new or gone. Each round lists one level more, on
    both sides at once.
    """
    sides = [old, new]
    seen = [written(s.tops(), "seen") for s in sides]
    none = old.spark.createDataFrame([], "file_id long")
    listed = [none, none]
    while True:
        dirs = [s.where("is_dir").select("file_id", *DIGEST) for s in seen]
        both = dirs[0].alias("o").join(dirs[1].alias("n"), "file_id")
        differ = both.where(~_equal(DIGEST, "o", "n")).select("file_id")
        wanted = written(differ.union(listed[0]).union(listed[1]).distinct(), "wanted")

        def due(wanted: DataFrame) -> list[DataFrame]:
            return [written(d.select("file_id").join(wanted, "file_id", "left_semi").join(done, "file_id", "left_anti"), "due")
                    for d, done in zip(dirs, listed)]

        next_ = due(wanted)
        if all(d.isEmpty() for d in next_):
            # what is left on one side alone was created or deleted, or moved there: its entries are listed as well
            alone = [a.select("file_id").join(b, "file_id", "left_anti") for a, b in (dirs, reversed(dirs))]
            next_ = due(alone[0].union(alone[1]))
            if all(d.isEmpty() for d in next_):
                return seen[0], seen[1]
        for n, side in enumerate(sides):
            if not next_[n].isEmpty():
                seen[n] = written(seen[n].unionByName(side.listed(next_[n])), "seen")
                listed[n] = written(listed[n].union(next_[n]), "listed")


def stored_diff(old: StoredSnapshot, new: StoredSnapshot) -> DataFrame:
    """The same rows as :func:`snapshot_diff` of the two snapshots, from the directories that differ.

    Snapshots that were stored with different attributes have no comparable digests and are compared whole.
    """
    if old.attributes() != new.attributes():
        parts = old.entries().drop("bucket"), new.entries().drop("bucket")
    else:
        parts = changed_entries(old, new)
    return written(compare(*[p.drop(*DIGEST) for p in parts]), "diff")
