"""Log records and their search."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.operators.ordering import fold, placed

# Fixed value: what the first line of a record looks like: time, level, message.
RECORD_START = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})\s+(\w+)\s+(.*)$"
# Keys a log search may ask for.
SEARCH_KEYS = ["POLICYNAME", "POLICYID", "INSTANCEID", "REQUEST_ID"]


# lines of a record that are put into one row
PART_LINES = 10_000


def assemble_log_records(lines: DataFrame, order: list[str], part_lines: int = PART_LINES) -> DataFrame:
    """(file, record, part, first, time, level, message, text): lines put together to records.

    A line with the record prefix starts a record and the lines after it belong to it; lines before the first one are
    left out. ``order`` orders the lines of a file. A large file is cut across partitions, see ``fold``. A record of more than
    ``part_lines`` lines comes in several rows, parts 0, 1 and so on; only part 0 has ``first`` and what is read from it.
    The lines themselves are placed, since places in text files need not be the same when they are read again.
    """
    starts = F.col("line").rlike(RECORD_START)
    rows = placed(lines.withColumn("__starts", starts), ["file"], order)
    counted = fold(rows, ["file"], order, {"record": ("sum", F.col("__starts").cast("bigint")),
                                           "__nth": ("sum", F.lit(1).cast("bigint"))})
    begun = fold(counted, ["file"], order, {"__begun": ("max", F.when(F.col("__starts"), F.col("__nth")))})
    part = F.floor((F.col("__nth") - F.col("__begun")) / part_lines).cast("bigint")
    whole = F.sort_array(F.collect_list(F.struct(*order, "line")))
    records = begun.where("record > 0").groupBy("file", "record", part.alias("part")).agg(
        F.max(F.when(F.col("__starts"), F.col("line"))).alias("first"),
        F.array_join(F.transform(whole, lambda r: r["line"]), "\n").alias("text"))
    return records.select(
        "file", "record", "part", "first",
        F.regexp_extract("first", RECORD_START, 1).alias("time"),
        F.regexp_extract("first", RECORD_START, 2).alias("level"),
        F.regexp_extract("first", RECORD_START, 3).alias("message"), "text")


def mentions(message: Column, wanted: dict[str, str]) -> Column:
    """Whether ``KEY[value]`` of any wanted key stands in the message, letter for letter.

    An unknown key is an error, and so is a search for nothing, which would match everything.
    """
    if not wanted:
        raise ValueError(f"a log search needs one of {SEARCH_KEYS}")
    if unknown := [key for key in wanted if key.upper() not in SEARCH_KEYS]:
        raise ValueError(f"cannot search logs by {unknown}; use one of {SEARCH_KEYS}")
    found = F.lit(False)
    for key, value in wanted.items():
        found = found | F.contains(message, F.lit(f"{key.upper()}[{value}]"))
    return found


def matching_records(records: DataFrame, wanted: dict[str, str], start: datetime, end: datetime) -> DataFrame:
    """Records (their first parts) whose first line mentions a wanted key and whose time lies within whole-second bounds.

    Times are compared as text, so a record with milliseconds within the last second lies outside.
    """
    low, high = start.strftime("%Y-%m-%d %H:%M:%S"), end.strftime("%Y-%m-%d %H:%M:%S")
    found = records.where((F.col("time") >= low) & (F.col("time") <= high))
    return found.where(mentions(F.col("message"), wanted))


def search_logs(records: DataFrame, wanted: dict[str, str], start: datetime, end: datetime, n: int) -> DataFrame:
    """The newest ``n`` matching records over all files; the further parts of a long one are found by file and record."""
    found = matching_records(records, wanted, start, end)
    return found.orderBy(F.desc("time"), F.desc("file"), F.desc("record")).limit(n)
