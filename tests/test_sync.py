"""Plans, snapshots and real copies of small trees."""

import os
import random
from datetime import datetime

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from driftline.plans import copying, digests, execute, ranges, snapshots
from driftline.plans.options import CopyOptions, cloud_preset, cluster_preset
from driftline.sources import files, trees
from driftline.sources.scratch import spread, spread_in_order, written

MANIFEST = "rel_path string, is_dir boolean, length long, block_size int, checksum string"
SNAPSHOT = "file_id long, parent_id long, name string, path string, is_dir boolean, checksum string"


def write(spark, root, contents):
    trees.write_files(spark.createDataFrame(list(contents.items()), "rel_path string, content string"), root)


def read(spark, root):
    return trees.with_checksums(trees.with_rel_path(trees.scan_tree(spark, [root]), "sync")).withColumn(
        "block_size", F.lit(1))


def tree(spark, root):
    return {r["rel_path"]: r["checksum"] for r in read(spark, root).where("not is_dir").collect()}


def test_options():
    good = dict(from_snapshot="a", to_snapshot="b")
    assert CopyOptions(sync=True, atomic=True).problems() == ["sync_with_atomic"]
    assert CopyOptions(delete_missing=True).problems() == ["delete_needs_sync_or_overwrite"]
    assert CopyOptions(overwrite=True, sync=True).problems() == ["overwrite_with_sync"]
    assert CopyOptions(skip_crc=True).problems() == ["skip_crc_needs_sync"]
    assert CopyOptions(append=True).problems() == ["append_needs_sync"]
    assert CopyOptions(sync=True, append=True, skip_crc=True).problems() == ["append_with_skip_crc"]
    assert CopyOptions(diff=True, **good).problems() == ["diff_needs_sync"]
    assert CopyOptions(sync=True, diff=True, from_snapshot=" ").problems() == ["diff_needs_two_snapshots"]
    assert CopyOptions(sync=True, diff=True, reverse_diff=True, **good).problems() == ["diff_with_reverse_diff"]
    assert cluster_preset().preserve == {"BLOCKSIZE", "PERMISSION", "USER", "GROUP"}
    assert cloud_preset().sync and not cloud_preset().preserve
    with pytest.raises(ValueError):
        cluster_preset(atomic=True)


@pytest.mark.parametrize("options, expected", [
    (CopyOptions(sync=True), "SKIP/same"), (CopyOptions(sync=True, preserve=frozenset({"BLOCKSIZE"})), "OVERWRITE/block_size"),
    (CopyOptions(), "SKIP/exists"), (CopyOptions(overwrite=True), "OVERWRITE/overwrite"),
    (CopyOptions(target_is_file=True), "OVERWRITE/overwrite")])
def test_null_checksum_counts_as_equal(spark, options, expected):
    src = spark.createDataFrame([("/f", False, 5, 1, "x")], MANIFEST)
    tgt = spark.createDataFrame([("/f", False, 5, 2, None)], MANIFEST)
    row = copying.plan_copy(src, tgt, options).first()
    assert f"{row['action']}/{row['reason']}" == expected


def test_append_needs_a_known_target_checksum(spark):
    src = spark.createDataFrame([("/f", False, 9, 1, "x"), ("/g", False, 9, 1, "y")], MANIFEST)
    tgt = spark.createDataFrame([("/f", False, 5, 1, None), ("/g", False, 5, 1, "p")], MANIFEST)
    prefixes = spark.createDataFrame([("/f", "p"), ("/g", "p")], "rel_path string, prefix_checksum string")
    plan = copying.plan_copy(src, tgt, CopyOptions(sync=True, append=True), prefixes)
    assert {r["rel_path"]: (r["action"], r["bytes"]) for r in plan.collect()} == {"/f": ("OVERWRITE", 9), "/g": ("APPEND", 4)}
    assert copying.append_candidates(src, tgt).count() == 2


def test_directories_and_clashes(spark):
    src = spark.createDataFrame([("/d", True, 0, 1, None), ("/x", True, 0, 1, None)], MANIFEST)
    tgt = spark.createDataFrame([("/x", False, 3, 1, "a")], MANIFEST)
    plan = copying.plan_copy(src, tgt, CopyOptions(overwrite=True))
    assert {r["rel_path"]: r["action"] for r in plan.collect()} == {"/d": "MKDIR", "/x": "ERROR"}
    with pytest.raises(ValueError):
        execute.execute_copy(plan, "/nowhere", "/nowhere", CopyOptions(overwrite=True))


def test_delete_missing_with_interleaved_names(spark):
    names = [f"/n{i}" for i in range(9)]
    src = spark.createDataFrame([(n, False, 1, 1, "") for n in names[::2]], MANIFEST)
    tgt = spark.createDataFrame([(n, False, 1, 1, "") for n in names] + [("/d", True, 0, 1, None), ("/d/a", False, 1, 1, ""),
                                ("/d2", False, 1, 1, ""), ("/x/.hidden", False, 1, 1, "")], MANIFEST)
    gone = copying.delete_missing(src, tgt, copying.DEFAULT_EXCLUDE)
    assert sorted(r["rel_path"] for r in gone.collect()) == sorted([*names[1::2], "/d", "/d2"])


def test_default_exclude(spark):
    paths = ["/a/b", "/a/.b", "/a/x_COPYING_", "/a/_temporary/0", "/u/.Trash/f", "/a/_temporary"]
    df = spark.createDataFrame([(p,) for p in paths], "rel_path string")
    assert [r[0] for r in copying.exclude_find(df, copying.DEFAULT_EXCLUDE).collect()] == ["/a/b"]


def test_attributes(spark):
    schema = ("rel_path string, is_dir boolean, replication int, permission string, acl array<string>, "
              "xattrs map<string,binary>, owner string")
    src = spark.createDataFrame([("/a", False, 2, "rwxr-xr-t", ["u"], {"raw.k": b"1", "user.k": b"2"}, "o"),
                                 ("/d", True, 2, "rwx", [], None, "o")], schema)
    tgt = spark.createDataFrame([("/a", False, 3, "rwxr-xr-x", ["u"], {"raw.k": b"1", "user.k": b"9"}, "o"),
                                 ("/d", True, 3, "rw-", [], {"user.k": b"1"}, "p")], schema)

    def found(*preserve, raw=False):
        return {r["rel_path"]: r["attributes"] for r in copying.attributes_to_fix(src, tgt, list(preserve), raw).collect()}

    assert found("REPLICATION") == {"/a": ["REPLICATION"]}
    assert found("PERMISSION") == {"/a": ["PERMISSION"], "/d": ["PERMISSION"]}
    # under ACL only the sticky bit of the permission counts
    assert found("ACL", "PERMISSION") == {"/a": ["PERMISSION"]}
    assert found("XATTR") == {"/a": ["XATTR"]}
    assert found(raw=True) == {}
    assert found("USER", "TIMES") == {"/a": ["TIMES"], "/d": ["USER", "TIMES"]}
    assert found() == {}


def random_tree(rng, size):
    """{id: (parent, name, is_dir, content)}; 0 is the root and not listed."""
    nodes, dirs = {}, [0]
    for i in range(1, size):
        is_dir = rng.random() < 0.4
        nodes[i] = (rng.choice(dirs), f"n{i}", is_dir, None if is_dir else f"c{i}")
        if is_dir:
            dirs.append(i)
    return nodes


def path_of(nodes, i):
    parent, name = nodes[i][:2]
    return (path_of(nodes, parent) if parent else "") + "/" + name


def below(nodes, top):
    kids = [i for i, n in nodes.items() if n[0] == top]
    return [top] + [j for k in kids for j in below(nodes, k)]


def changed(rng, nodes, fresh):
    new = dict(nodes)
    for _ in range(12):
        kind, i = rng.choice(["delete", "move", "move", "modify", "create", "swap"]), rng.choice(list(new) or [0])
        dirs = [0] + [j for j, n in new.items() if n[2]]
        if kind == "create":
            parent, is_dir = rng.choice(dirs), rng.random() < 0.5
            # sometimes with the old name of another entry, so that names are used again
            name = rng.choice([f"new{fresh}", "n1", "n2"])
            if all((n[0], n[1]) != (parent, name) for n in new.values()):
                new[fresh] = (parent, name, is_dir, None if is_dir else f"c{fresh}")
            fresh += 1
        elif i and kind == "delete":
            for j in below(new, i):
                del new[j]
        elif i and kind == "modify" and not new[i][2]:
            new[i] = (*new[i][:3], new[i][3] + "m")
        elif i and kind in ("move", "swap"):
            parent = rng.choice([j for j in dirs if j not in below(new, i)])
            name = rng.choice([new[i][1], f"r{i}", "n3"])
            if all((n[0], n[1]) != (parent, name) for n in new.values()):
                new[i] = (parent, name, *new[i][2:])
    return new


def snapshot(spark, nodes):
    rows = [(i, n[0], n[1], path_of(nodes, i), n[2], n[3]) for i, n in nodes.items()]
    return spark.createDataFrame(rows, SNAPSHOT)


@pytest.mark.parametrize("seed", range(6))
def test_moves_and_copies_make_the_new_tree(spark, seed):
    """Apply the plan in memory: renames and deletes by level, then the copy list; the result is the new tree."""
    rng = random.Random(seed)
    old = random_tree(rng, 40)
    new = changed(rng, old, 100)
    before, after = snapshot(spark, old), snapshot(spark, new)
    diff = snapshots.snapshot_diff(before, after)
    ops = snapshots.move_order(snapshots.sync_ops(diff, "/")).collect()
    place = {path_of(old, i): (n[2], n[3]) for i, n in old.items()}
    tmp = {}
    for level in range(max([o["out_level"] for o in ops], default=0), 0, -1):
        for o in ops:
            if o["out_level"] == level:
                moved = {p: v for p, v in place.items() if p == o["source"] or p.startswith(o["source"] + "/")}
                assert moved
                tmp[o["source"]] = {p[len(o["source"]):]: v for p, v in moved.items()}
                for p in moved:
                    del place[p]
    for o in sorted([o for o in ops if o["target"] is not None], key=lambda o: o["in_level"]):
        for rest, value in tmp[o["source"]].items():
            assert o["target"] + rest not in place
            place[o["target"] + rest] = value
    want = {path_of(new, i): (n[2], n[3]) for i, n in new.items()}
    copied = [r["path"] for r in snapshots.copy_list_from_diff(diff, after).collect()]
    assert len(copied) == len(set(copied))
    for p in copied:
        place[p] = want[p]
    assert place == want
    # nothing is copied that was there and merely moved
    same = {path_of(new, i) for i, n in new.items() if i in old and old[i][3] == n[3]}
    assert not same & set(copied)


@pytest.mark.parametrize("seed", [1, 3])
def test_difference_by_digests_is_the_whole_one(spark, tmp_path, seed):
    rng = random.Random(100 + seed)
    old = random_tree(rng, 60)
    new = changed(rng, old, 100)
    whole = sorted(map(repr, snapshots.snapshot_diff(snapshot(spark, old), snapshot(spark, new)).collect()))
    one, two = (digests.store(snapshot(spark, nodes), str(tmp_path / name), 7) for name, nodes in (("old", old), ("new", new)))
    assert sorted(map(repr, digests.stored_diff(one, two).collect())) == whole
    assert digests.unchanged(one, two) == (not whole)


def test_a_difference_reads_what_changed(spark, tmp_path):
    """Ten changes in a tree of 40 x 40 directories of 5 files: a few directories are listed, few buckets opened."""
    rng = random.Random(1)
    nodes = {}
    for a in range(40):
        nodes[1 + a] = (0, f"a{a}", True, None)
        for b in range(40):
            nodes[100 + 40 * a + b] = (1 + a, f"b{b}", True, None)
            for c in range(5):
                nodes[10_000 + 5 * (40 * a + b) + c] = (100 + 40 * a + b, f"c{c}", False, f"x{c}")
    new = dict(nodes)
    for n, i in enumerate(rng.sample(range(10_000, 18_000), 9)):
        if n % 3 == 0:
            del new[i]
        else:
            new[i] = (nodes[i][0], f"r{i}", False, nodes[i][3]) if n % 3 == 1 else (*nodes[i][:3], "changed")
    new[105] = (7, "moved", True, None)  # a directory with its files goes to another one
    before, after = snapshot(spark, nodes), snapshot(spark, new)
    one, two = digests.store(before, str(tmp_path / "old"), 100), digests.store(after, str(tmp_path / "new"), 100)
    rows = digests.changed_entries(one, two)
    assert all(r.count() < 700 for r in rows)
    found = digests.stored_diff(one, two)
    assert found.count() == 10
    assert sorted(map(repr, found.collect())) == sorted(map(repr, snapshots.snapshot_diff(before, after).collect()))
    assert not digests.unchanged(one, two) and digests.unchanged(one, digests.StoredSnapshot(spark, str(tmp_path / "old")))


def test_digests_of_other_attributes_are_not_compared(spark, tmp_path):
    tree = snapshot(spark, {1: (0, "a", True, None), 2: (1, "f", False, "x")})
    xattrs = tree.withColumn("xattrs", F.create_map(F.lit("k"), F.col("name"))).withColumn("owner", F.lit("me"))
    one, two = digests.store(tree, str(tmp_path / "old")), digests.store(xattrs, str(tmp_path / "new"))
    assert digests.unchanged(one, two) and digests.stored_diff(one, two).isEmpty()
    three = digests.store(xattrs.withColumn("xattrs", F.create_map(F.lit("k"), F.lit("other"))), str(tmp_path / "third"))
    assert not digests.unchanged(two, three) and digests.stored_diff(two, three).count() == 2
    empty = digests.store(tree.limit(0), str(tmp_path / "empty"))
    assert sorted(r["source"] for r in digests.stored_diff(empty, one).collect()) == ["/a"]


def test_wrong_time_order(spark):
    from datetime import datetime

    snap = snapshot(spark, {1: (0, "a", True, None)})
    with pytest.raises(ValueError):
        snapshots.sync_precheck(snap, snap, datetime(2001, 2, 1), datetime(2001, 1, 1))
    assert snapshots.sync_precheck(snap, snap, datetime(2001, 2, 1), datetime(2001, 1, 1), reverse=True)


def test_sync_of_real_trees(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    write(spark, src, {"/a/1": "one", "/a/2": "two and more", "/b/3": "", "/c": "same"})
    write(spark, dst, {"/a/2": "two", "/c": "same", "/old/x": "x", "/old/y": "y"})
    options = CopyOptions(sync=True, append=True, delete_missing=True)
    ours, theirs = read(spark, src), read(spark, dst)
    prefixes = copying.prefix_checksums(copying.append_candidates(ours, theirs), src)
    plan = copying.plan_copy(ours, theirs, options, prefixes)
    gone = copying.delete_missing(ours, theirs)
    done = {r["rel_path"]: (r["action"], r["bytes"]) for r in execute.execute_copy(plan, src, dst, options, 3).collect()}
    assert done == {"/a": ("MKDIR", 0), "/b": ("MKDIR", 0), "/a/1": ("OVERWRITE", 3), "/a/2": ("APPEND", 9),
                    "/b/3": ("OVERWRITE", 0), "/c": ("SKIP", 0)}
    assert [tuple(r) for r in execute.execute_deletes(gone, dst).collect()] == [("/old", True)]
    # deleting again finds nothing and is no error
    missing = spark.createDataFrame([("/old",)], "rel_path string")
    assert [tuple(r) for r in execute.execute_deletes(missing, dst).collect()] == [("/old", False)]
    assert execute.verify_copy(ours, read(spark, dst)).isEmpty()
    again = copying.plan_copy(ours, read(spark, dst), options).where("not is_dir")
    assert [r["action"] for r in again.collect()] == ["SKIP"] * 4
    assert not (tmp_path / "dst" / execute.TMP_FOLDER).exists()


def test_append_after_a_partial_attempt(spark, tmp_path):
    """The target grew since the plan was made, as after a lost attempt: only the rest is added."""
    src, dst = tmp_path / "src", tmp_path / "dst"
    src.mkdir(), dst.mkdir()
    (src / "f").write_text("0123456789"), (dst / "f").write_text("0123456")
    (src / "g").write_text("0123456789"), (dst / "g").write_text("01x")
    plan = spark.createDataFrame([("/f", "APPEND", 10), ("/g", "APPEND", 10)], "rel_path string, action string, length long")
    done = execute.execute_copy(plan, str(src), str(dst), CopyOptions(sync=True, append=True), 2)
    assert {r["rel_path"]: r["bytes"] for r in done.collect()} == {"/f": 3, "/g": 10}
    assert (dst / "f").read_text() == (dst / "g").read_text() == "0123456789"


def test_unreadable_source(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    write(spark, src, {"/a": "a"})
    plan = spark.createDataFrame([("/a", "OVERWRITE", 1), ("/gone", "OVERWRITE", 5)], "rel_path string, action string, length long")
    done = execute.execute_copy(plan, src, dst, CopyOptions(sync=True, ignore_failures=True), 2)
    assert {r["rel_path"]: r["action"] for r in done.collect()} == {"/a": "OVERWRITE", "/gone": "FAIL"}
    counters = copying.copy_counters(done.withColumn("job", F.lit(1)), ["job"]).first()
    assert (counters["copied"], counters["failed"], counters["bytes_failed"]) == (1, 1, 5)
    with pytest.raises(Exception, match="missing"):
        execute.execute_copy(plan, src, dst, CopyOptions(sync=True), 2)


def large_file(tmp_path, size=100_000):
    src, dst = tmp_path / "src", tmp_path / "dst"
    src.mkdir(), dst.mkdir()
    data = random.Random(size).randbytes(size)
    (src / "big").write_bytes(data), (src / "small").write_bytes(b"x")
    return src, dst, data


@pytest.mark.parametrize("in_place", [True, False])
def test_a_large_file_goes_on_after_a_broken_copy(spark, tmp_path, in_place):
    src, dst, data = large_file(tmp_path)
    large = written(spark.createDataFrame([("/big", len(data))], "rel_path string, length long"), "large")
    parts = ranges.ranges_of(large, 1000)
    assert parts.count() == 100
    first = ranges.copy_ranges(parts.where("nth < 40"), str(src), str(dst), 1000, in_place=in_place)
    assert first.agg(F.sum("bytes")).first()[0] == 40_000
    # a range that an executor was lost over is written again
    again = ranges.copy_ranges(parts.where("nth BETWEEN 30 AND 49"), str(src), str(dst), 1000, in_place=in_place)
    assert again.agg(F.sum("bytes")).first()[0] == 10_000
    done = ranges.copy_large(large, str(src), str(dst), 1000, in_place=in_place).collect()
    assert [tuple(r) for r in done] == [("/big", "OVERWRITE", 100_000, 50_000, None)]
    assert (dst / "big").read_bytes() == data and list((dst / ranges.RANGE_FOLDER).iterdir()) == []
    # the task that puts it in place may run again
    assert ranges.Places(str(src), str(dst), 1000, in_place).parts("/big")[2].done() == {}


def test_ranges_are_spread_over_tasks(spark, tmp_path):
    src, dst, data = large_file(tmp_path)
    large = spark.createDataFrame([("/big", len(data))], "rel_path string, length long")
    dealt = spread(ranges.ranges_of(large, 1000), F.xxhash64("rel_path", "nth"))
    assert dealt.select(F.spark_partition_id()).distinct().count() >= 4


def test_ranges_of_many_files_share_no_folder(spark, tmp_path, monkeypatch):
    """A disk changes a folder for one task at a time, and each forced write waits for the disk: ranges are forced together."""
    src, dst = tmp_path / "src", tmp_path / "dst"
    src.mkdir(), dst.mkdir()
    for n in range(60):
        (src / f"f{n}").write_bytes(bytes([n]) * 250)
    alone = []
    monkeypatch.setattr(ranges.os, "fsync", alone.append)
    batch = pd.DataFrame({"rel_path": [f"/f{n}" for n in range(60)], "nth": 1, "start": 100, "size": 100})
    rows = pd.concat(ranges._copy_batches(str(src), str(dst), 100, False, False, None)([batch]))
    assert rows["bytes"].tolist() == [100] * 60 and rows["message"].isna().all() and not alone
    folders = list((dst / ranges.RANGE_FOLDER).iterdir())
    assert 10 < len(folders) <= 60 and all(p.is_file() for f in folders for p in f.iterdir())
    assert ranges.Places(str(src), str(dst), 100, None).parts("/f7")[2].done().keys() == {1}
    large = written(spark.createDataFrame([(f"/f{n}", 250) for n in range(60)], "rel_path string, length long"), "large")
    assert {r["bytes"] for r in ranges.copy_large(large, str(src), str(dst), 100).collect()} == {150}
    assert all((dst / f"f{n}").read_bytes() == bytes([n]) * 250 for n in range(60))


def test_a_range_that_is_broken_on_the_target_is_copied_again(spark, tmp_path, monkeypatch):
    src, dst, data = large_file(tmp_path)
    batch = pd.DataFrame({"rel_path": "/big", "nth": [0, 1], "start": [0, 50_000], "size": 50_000})
    real, bad = ranges.Parts.digest, [1]
    monkeypatch.setattr(ranges.Parts, "digest", lambda self, nth, *a: "x" * 32 if nth in bad and not bad.clear() else real(self, nth, *a))
    rows = pd.concat(ranges._copy_batches(str(src), str(dst), 50_000, False, False, None)([batch]))
    assert rows["bytes"].tolist() == [50_000] * 2
    parts = ranges.Places(str(src), str(dst), 50_000, None).parts("/big")[2]
    assert parts.done().keys() == {0, 1} and open(parts.whole, "rb").read() == data


def test_files_are_dealt_by_folder(spark, tmp_path):
    """Tasks that make files in the same folders would wait for each other."""
    rows = spark.range(4000).select(F.concat(F.lit("/"), F.col("id") % 40, F.lit("/"), F.col("id")).alias("rel_path"))
    dealt = spread_in_order(rows, "rel_path").select(F.substring_index("rel_path", "/", 2).alias("d"), F.spark_partition_id().alias("t"))
    tasks = dealt.select("t").distinct().count()
    assert tasks > 1 and dealt.distinct().count() < 40 + tasks


def test_a_source_that_changes_between_ranges(spark, tmp_path):
    src, dst, data = large_file(tmp_path)
    large = written(spark.createDataFrame([("/big", len(data))], "rel_path string, length long"), "large")
    ranges.copy_ranges(ranges.ranges_of(large, 1000).where("nth < 99"), str(src), str(dst), 1000)
    (src / "big").write_bytes(data[::-1])
    done = ranges.copy_large(large, str(src), str(dst), 1000).first()
    assert done["bytes"] == 100_000 and (dst / "big").read_bytes() == data[::-1]
    (src / "big").write_bytes(data[:50_000])
    with pytest.raises(Exception, match="ends before byte"):
        ranges.copy_large(large, str(src), str(dst), 50_000)
    failed = ranges.copy_large(large, str(src), str(dst), 50_000, ignore_failures=True).first()
    assert failed["action"] == "FAIL" and (dst / "big").read_bytes() == data[::-1]


def test_large_and_small_files_in_one_copy(spark, tmp_path):
    src, dst, data = large_file(tmp_path)
    plan = spark.createDataFrame([("/big", "OVERWRITE", len(data)), ("/small", "OVERWRITE", 1)], "rel_path string, action string, length long")
    done = execute.execute_copy(plan, str(src), str(dst), CopyOptions(overwrite=True), range_bytes=30_000)
    assert {r["rel_path"]: (r["action"], r["bytes"]) for r in done.collect()} == {"/big": ("OVERWRITE", 100_000), "/small": ("OVERWRITE", 1)}
    assert (dst / "big").read_bytes() == data and sorted(p.name for p in dst.iterdir()) == ["big", "small"]


def test_atomic_copy_needs_a_new_target(spark, tmp_path):
    src, dst = str(tmp_path / "src"), str(tmp_path / "dst")
    write(spark, src, {"/a/b": "x"})
    ours = read(spark, src)
    plan = copying.plan_copy(ours, ours.limit(0), CopyOptions(atomic=True))
    execute.execute_copy(plan, src, dst, CopyOptions(atomic=True))
    assert tree(spark, dst) == tree(spark, src)
    with pytest.raises(FileExistsError):
        execute.execute_copy(plan, src, dst, CopyOptions(atomic=True))


def test_moves_on_disk(spark, tmp_path):
    """A swap of two names, a move out of a deleted directory, and a move into a renamed one."""
    root = str(tmp_path / "t")
    write(spark, root, {"/a/f": "1", "/b/g": "2", "/dead/keep": "3", "/dead/x": "4"})
    ops = spark.createDataFrame([("RENAME", "/a", "/b"), ("RENAME", "/b", "/a"), ("RENAME", "/dead/keep", "/a/new/keep"),
                                 ("DELETE", "/dead", None)], "type string, source string, target string")
    counts = execute.execute_moves(snapshots.sync_ops(ops, root), root)
    assert {r["type"]: r["moved"] for r in counts.collect()} == {"RENAME": 3, "DELETE": 1}
    assert sorted(tree(spark, root)) == ["/a/g", "/a/new/keep", "/b/f"]


def test_moves_of_a_tree_named_by_a_uri(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    write(spark, root, {"/a/x": "1", "/a/y": "2", "/b/z": "3"})
    ops = spark.createDataFrame([("RENAME", "/a", "/c"), ("DELETE", "/b/z", None)], "type string, source string, target string")
    counts = execute.execute_moves(snapshots.sync_ops(ops, root), root)
    assert {r["type"]: r["moved"] for r in counts.collect()} == {"RENAME": 1, "DELETE": 1}
    assert sorted(tree(spark, root)) == ["/c/x", "/c/y"]


def test_files_of_several_roots_are_dealt_once(spark, tmp_path):
    roots, contents = [str(tmp_path / "one"), f"file://{tmp_path}/two"], {f"/d{i % 3}/{i}": "x" * i for i in range(20)}
    found = trees.write_files(spark.createDataFrame(list(contents.items()), "rel_path string, content string"), roots)
    assert sorted(r["rel_path"] for r in found.collect()) == sorted(contents)
    assert tree(spark, roots[0]) == tree(spark, roots[1]) and len(tree(spark, roots[0])) == 20


def test_checksums_are_read_once_and_not_joined(spark, tmp_path):
    write(spark, str(tmp_path / "t"), {"/d/a": "1", "/b": ""})
    found = trees.with_checksums(trees.with_rel_path(trees.scan_tree(spark, [str(tmp_path / "t")]), "sync"))
    assert "Join" not in found._jdf.queryExecution().toString()
    (tmp_path / "t/b").unlink()  # what was read stands
    sums = {"/d": None, "/d/a": "c4ca4238a0b923820dcc509a6f75849b", "/b": "d41d8cd98f00b204e9800998ecf8427e"}
    assert {r["rel_path"]: r["checksum"] for r in found.collect()} == sums


def test_a_small_copy_is_split_over_the_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(execute, "LEAST_TASK_BYTES", execute.FILE_COST_BYTES)
    src, dst = str(tmp_path / "s"), str(tmp_path / "t")
    write(spark, src, {f"/d/{i}": "x" * i for i in range(40)})
    ours = read(spark, src)
    done = execute.execute_copy(copying.plan_copy(ours, ours.limit(0), CopyOptions()), src, dst, CopyOptions())
    assert len({r["f"] for r in done.select(F.input_file_name().alias("f")).collect()}) > 1
    assert execute.verify_copy(ours, read(spark, dst)).isEmpty()


def test_listing_a_missing_root(spark, tmp_path):
    assert trees.scan_tree(spark, [str(tmp_path / "none")]).isEmpty()
    with pytest.raises(Exception, match="no path matches"):
        trees.scan_globs(spark, [str(tmp_path / "none*")])


def test_globs(tmp_path):
    for name in ("a1", "a2", "b1"):
        (tmp_path / name / "sub").mkdir(parents=True)
    found = files.expand(f"{tmp_path}/{{a,b}}1/su?") + files.expand(f"{tmp_path}/a[2]")
    assert [f.removeprefix(str(tmp_path)) for f in found] == ["/a1/sub", "/b1/sub", "/a2"]


def test_entries_of_one_directory_are_described_by_several_tasks(spark, tmp_path):
    """Reading the attributes of a large directory must not be left to the task that lists it."""
    write(spark, str(tmp_path / "t"), {f"/one/{i}": "x" * i for i in range(200)})
    os.utime(tmp_path / "t/one/7", ns=(1_700_000_000_123_456_789, 1_600_000_000_987_654_321))
    found = trees.scan_tree(spark, [str(tmp_path / "t")])
    here = found.where("not is_dir").select("*", F.spark_partition_id().alias("part"), F.input_file_name().alias("file")).collect()
    assert sorted(r["length"] for r in here) == list(range(200))
    assert len({r["file"] for r in here}) > 1
    seven = next(r for r in here if r["path"].endswith("/one/7"))
    assert (seven["mtime"], seven["atime"].year) == (datetime(2020, 9, 13, 12, 26, 40, 987654), 2023)
    facts = os.stat(tmp_path / "t/one/7")
    assert (seven["owner"], seven["group"], seven["permission"], seven["block_size"], seven["replication"], seven["xattrs"]) == (
        str(facts.st_uid), str(facts.st_gid), "rw-r--r--", facts.st_blksize, 1, {})


def test_files_that_vanish_while_they_are_listed(tmp_path):
    (tmp_path / "f").write_text("x")
    row = (str(tmp_path), str(tmp_path), f"{tmp_path}/f", False, 1, 5_999)
    gone = (*row[:2], f"{tmp_path}/gone", *row[3:])
    batch = pa.RecordBatch.from_pylist([dict(zip(trees._FOUND, r)) for r in (gone, row)])
    made = next(trees._describe([batch])).to_pylist()
    assert [(r["path"], r["length"], r["mtime"]) for r in made] == [(f"{tmp_path}/f", 1, datetime(1970, 1, 1, 0, 0, 0, 5))]


def test_lone_file_root(spark, tmp_path):
    path = tmp_path / "f"
    path.write_text("x")
    found = trees.scan_tree(spark, [str(path)])
    assert [r["rel_path"] for r in trees.with_rel_path(found, "copy", True).collect()] == ["/f"]
    assert [r["rel_path"] for r in trees.with_rel_path(found, "copy", False).collect()] == [""]
    assert [r["rel_path"] for r in trees.with_rel_path(found, "sync", True, target_is_file=True).collect()] == [""]


def test_retry_waits_and_gives_up():
    calls = []

    def broken():
        calls.append(1)
        raise OSError("busy")

    with pytest.raises(OSError):
        files.retried(broken, retries=2, wait=0.001)
    assert len(calls) == 3


def test_duplicate_paths(spark):
    df = spark.createDataFrame([("/x", "/a/x"), ("/x", "/b/x"), ("/y", "/a/y")], "rel_path string, path string")
    assert [tuple(r) for r in copying.duplicate_paths(df).collect()] == [("/x", 2, "/a/x", "/b/x")]
