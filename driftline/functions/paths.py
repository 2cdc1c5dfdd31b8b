"""Column expressions over dataset paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# URI schemes that denote a cluster filesystem rather than a cloud store.
CLUSTER_SCHEMES = ["file", "hdfs", "hftp", "hsftp", "webhdfs", "swebhdfs"]


def strip_slash(path: Column) -> Column:
    """Drop trailing slashes; the root stays ``/``."""
    return F.regexp_replace(path, "(?<=.)/+$", "")


def add_slash(path: Column) -> Column:
    return F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))


def parent(path: Column) -> Column:
    """Directory holding ``path``; null for the root."""
    inner = F.regexp_extract(path, "^(.*/)[^/]+/*$", 1)
    return F.when(inner != "", strip_slash(inner))


def name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)/*$", 1)


def depth(path: Column) -> Column:
    """Number of segments; the root has none."""
    return F.size(F.filter(F.split(path, "/"), lambda part: part != ""))


def prefixes(path: Column, include_self: bool = True) -> Column:
    """Every containing path of ``path`` from the root down, as an array.

    ``/a/b`` gives ``[/, /a, /a/b]``. A path with no leading slash (``bucket/a``) starts at its first segment.
    """

    def joined(parts: Column) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.size(parts)),
                            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
        if not include_self:
            steps = F.filter(steps, lambda p: p != F.array_join(parts, "/"))
        return F.array_distinct(F.transform(steps, lambda p: F.when(p == "", F.lit("/")).otherwise(p)))

    # the split text is bound once, as the one element of an array: written out, it would be repeated at each use
    found = F.get(F.transform(F.array(F.split(strip_slash(path), "/")), joined), 0)
    return found if include_self else F.when(path.rlike("^/+$"), F.array().cast("array<string>")).otherwise(found)


def is_proper_ancestor(above: Column, below: Column) -> Column:
    """True when ``below`` lies strictly inside ``above``, by whole segments."""
    return below.startswith(add_slash(above)) & (F.length(below) > F.length(add_slash(above)))


def scheme(path: Column) -> Column:
    """URI scheme in lower case, empty for a bare path."""
    return F.lower(F.regexp_extract(path, "^([A-Za-z][A-Za-z0-9+.-]*):/", 1))


def is_cloud(path: Column) -> Column:
    """True for a URI whose scheme is not a cluster filesystem; a bare path is on the cluster."""
    return F.coalesce(~scheme(path).isin([*CLUSTER_SCHEMES, ""]), F.lit(False))


def uri_path(path: Column) -> Column:
    """The path part of a URI, or the path itself."""
    return F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", "")


def storage_place(path: Column) -> Column:
    """Where a dataset lies, comparable by segments: ``/<scheme>/<host>/<path>`` on a cloud store, ``/cluster/<path>``."""
    cloud = F.concat(F.lit("/"), scheme(path), F.lit("/"), F.regexp_replace(path, "^[^:]*:/*", ""))
    return strip_slash(F.when(is_cloud(path), cloud).otherwise(F.concat(F.lit("/cluster"), uri_path(path))))


def full_uri(endpoint: Column, dataset: Column) -> Column:
    """Dataset as a URI: cloud and already qualified datasets stay, bare paths get the cluster's endpoint."""
    bare = scheme(dataset) == ""
    return F.when(bare, F.concat(strip_slash(endpoint), dataset)).otherwise(dataset)


def execution_type(source: Column, target: Column, encrypted: Column, snapshottable: Column) -> Column:
    """FS, FS_HCFS, FS_SNAPSHOT or FS_HCFS_SNAPSHOT."""
    cloud = is_cloud(source) | is_cloud(target)
    snap = ~F.coalesce(encrypted, F.lit(False)) & F.coalesce(snapshottable, F.lit(False))
    return (F.when(cloud & snap, "FS_HCFS_SNAPSHOT").when(snap, "FS_SNAPSHOT")
            .when(cloud, "FS_HCFS").otherwise("FS"))


def database_at_cluster(database: Column, cluster: Column) -> Column:
    return F.concat(F.lower(database), F.lit("@"), cluster)


def tag_name(cluster: Column) -> Column:
    """Classification put on copied entities."""
    return F.concat(F.translate(cluster, "- ", "__"), F.lit("_replicated"))
