"""An index of log files: a search opens only the blocks that can hold what it looks for.

A file is cut into blocks of whole records. The index has a row per block: where it lies in the (unpacked) file, the number
of its first record, its times, and a Bloom filter of the ``KEY[value]`` marks in its records' first lines. It is a table
beside the log files; only files that are new or have changed are indexed again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.operators.logs import PART_LINES, SEARCH_KEYS, matching_records, mentions
from driftline.sources import files
from driftline.sources.scratch import spread, written

#: about so many bytes of a file make a block; a longer record is a block of its own
BLOCK_BYTES = 1 << 20
#: bits of a filter per mark, and bits that a mark sets: about one block in 400 is opened in vain
BITS, HASHES = 16, 4
INDEX = ("file string, length long, modified timestamp, block long, start long, size long, first_record long, n_records long, "
         "low string, high string, bits long, filter binary")
FOUND = "file string, record long, part long, first string, time string, level string, message string, text string"

_START = re.compile(rb"(?:\A|(?<=[\r\n]))(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})[^\S\r\n]+(\w+)[^\S\r\n]+([^\r\n]*)")
_MARK = re.compile(rb"(?=((?:" + "|".join(SEARCH_KEYS).encode() + rb")\[[^\]]*\]))")
_LINE = re.compile(r"\r\n|\n|\r")


def _places(mark: str) -> list[int]:
    digest = hashlib.md5(mark.encode()).digest()
    return [int.from_bytes(digest[4 * n:4 * n + 4], "big") for n in range(HASHES)]


def _filter(marks: set[bytes]) -> tuple[int, bytes]:
    bits = 1 << max(6, (BITS * len(marks) - 1).bit_length())
    held = bytearray(bits // 8)
    for mark in marks:
        for place in _places(mark.decode("utf-8", "replace")):
            held[place % bits // 8] |= 1 << place % 8
    return bits, bytes(held)


def _may_hold(mark: str) -> Column:
    """Whether a block's filter has all bits of a mark."""
    found = F.lit(True)
    for place in _places(mark):
        at = F.lit(place) % F.col("bits")
        byte = F.conv(F.hex(F.substring("filter", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        found = found & (F.call_function("getbit", byte, (at % 8).cast("int")) == 1)
    return found


def blocks_of(fs, path: str, block_bytes: int) -> Iterator[tuple[int, bytes]]:
    """Whole records of a file, in blocks, with their place in it; what stands before the first record belongs to none."""
    with fs.open_input_stream(path, compression="gzip" if path.endswith(".gz") else None, buffer_size=1 << 16) as stream:
        held, at, begun = bytearray(), 0, False
        while True:
            more = stream.read(block_bytes)
            held += more
            # a start is known to be one only with its whole line, so what comes after the last line end waits
            whole = max(held.rfind(b"\n"), held.rfind(b"\r")) + 1 if more else len(held)
            starts = [m.start() for m in _START.finditer(bytes(held[:whole]))]
            if not begun and starts:
                del held[:starts[0]]
                at, starts, begun = at + starts[0], [s - starts[0] for s in starts], True
            elif not begun and more:
                at += whole
                del held[:whole]
            if begun and not more and held:
                yield at, bytes(held)
            if not more:
                return
            if begun and len(starts) > 1 and starts[-1] >= block_bytes // 2:
                yield at, bytes(held[:starts[-1]])
                at += starts[-1]
                del held[:starts[-1]]


def _index_batches(block_bytes: int):
    def run(batches):
        for batch in batches:
            for path, length, modified in zip(batch["file"], batch["length"], batch["modified"]):
                fs, place = files.open_root(path)
                rows, record = [], 1
                for number, (start, data) in enumerate(blocks_of(fs, place, block_bytes)):
                    found = list(_START.finditer(data))
                    times = [m[1].decode() for m in found]
                    marks = {mark[1] for m in found for mark in _MARK.finditer(m[3])}
                    rows.append((path, length, modified, number, start, len(data), record, len(found), min(times), max(times), *_filter(marks)))
                    record += len(found)
                # a file without records is known by a row without a block
                rows = rows or [(path, length, modified, 0, 0, 0, 1, 0, None, None, 64, bytes(8))]
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in INDEX.split(", ")])

    return run


def list_logs(spark: SparkSession, folder: str, prefix: str = "") -> DataFrame:
    """``file, length, modified`` of the log files in a folder (or pattern of folders); no file is opened."""
    found = spark.read.format("binaryFile").load(folder).where(F.col("_metadata.file_name").startswith(prefix))
    return found.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def update_index(logs: DataFrame, index: str, block_bytes: int = BLOCK_BYTES) -> int:
    """Add to the index the files of ``logs`` (:func:`list_logs`) that it lacks in their present state; returns how many."""
    spark = logs.sparkSession
    new = logs
    if _there(spark, index):
        new = logs.join(spark.read.schema(INDEX).parquet(index).select("file", "length", "modified").distinct(),
                        ["file", "length", "modified"], "left_anti")
    new = written(new, "new-logs")
    count = new.count()
    if count:
        made = spread(new, F.xxhash64("file")).mapInPandas(_index_batches(block_bytes), INDEX)
        made.write.mode("append").parquet(index)
    return count


def _there(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def blocks_to_open(logs: DataFrame, index: str, wanted: dict[str, str], start: datetime, end: datetime) -> DataFrame:
    """The blocks of ``logs``, in their present state, whose times overlap and whose filter hits any wanted ``KEY[value]``."""
    mentions(F.lit(""), wanted)  # refuses keys that cannot be searched
    held = logs.sparkSession.read.schema(INDEX).parquet(index)
    low, high = start.strftime("%Y-%m-%d %H:%M:%S"), end.strftime("%Y-%m-%d %H:%M:%S")
    hit = F.lit(False)
    for key, value in wanted.items():
        # a mark ends at its first bracket, whatever the value looked for has behind it
        hit = hit | _may_hold(f"{key.upper()}[{value}]".split("]")[0] + "]")
    near = held.where((F.col("high") >= low) & (F.col("low") <= high) & (F.col("n_records") > 0) & hit)
    # an index that was added to by two attempts of a job has a block twice
    return near.join(logs, ["file", "length", "modified"], "left_semi").select("file", "block", "start", "size", "first_record").distinct()


def _record_batches(part_lines: int):
    def run(batches):
        for batch in batches:
            for path, start, size, first in zip(batch["file"], batch["start"], batch["size"], batch["first_record"]):
                fs, place = files.open_root(path)
                data = read_block(fs, place, int(start), int(size))
                found = list(_START.finditer(data))
                rows = []
                for n, (one, end) in enumerate(zip(found, [m.start() for m in found[1:]] + [len(data)])):
                    lines = _LINE.split(data[one.start():end].decode("utf-8", "replace"))
                    lines = lines[:-1] if lines[-1] == "" else lines
                    for part in range(0, len(lines), part_lines):
                        head = [m.decode("utf-8", "replace") for m in one.groups()] if not part else [None] * 3
                        rows.append((path, first + n, part // part_lines, lines[0] if not part else None, *head, "\n".join(lines[part:part + part_lines])))
                yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FOUND.split(", ")])

    return run


def read_block(fs, path: str, start: int, size: int) -> bytes:
    """A range of the unpacked file; a plain file is read from there on, a packed one up to its end."""
    if not path.endswith(".gz"):
        return b"".join(files.chunks(fs, path, start, size))
    with fs.open_input_stream(path, compression="gzip") as stream:
        while start:
            skipped = len(stream.read(min(start, BLOCK_BYTES)))
            if not skipped:
                break
            start -= skipped
        return stream.read(size)


def records_of(blocks: DataFrame, part_lines: int = PART_LINES) -> DataFrame:
    """The records of blocks, as :func:`assemble_log_records` gives them; each block is read on its own."""
    dealt = spread(blocks, F.xxhash64("file", "start"))
    return dealt.mapInPandas(_record_batches(part_lines), FOUND)


def search_index(logs: DataFrame, index: str, wanted: dict[str, str], start: datetime, end: datetime, n: int | None = None) -> DataFrame:
    """Records whose first line mentions a wanted key and whose time lies within whole-second bounds, the newest ``n`` or all.

    The same records as :func:`matching_records` finds among all, but only blocks that can hold one are opened. ``logs``
    must be in the index (:func:`update_index`).
    """
    found = matching_records(records_of(blocks_to_open(logs, index, wanted, start, end)), wanted, start, end)
    return found if n is None else found.orderBy(F.desc("time"), F.desc("file"), F.desc("record")).limit(n)
