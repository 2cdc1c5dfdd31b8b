"""Rotated log files."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.functions.times import moment

LINE_ORDER = ["block", "nth"]


def time_range(start: datetime | None, end: datetime | None, now: datetime,
               frequency_seconds: int = 3600) -> tuple[datetime, datetime]:
    """Defaults of a log search: up to now, from one period earlier; a reversed range becomes the last hour."""
    end = end or now
    start = start or end - timedelta(seconds=frequency_seconds)
    return (end - timedelta(hours=1), end) if start >= end else (start, end)


def read_logs(spark: SparkSession, folder: str, start: datetime, end: datetime, now: datetime,
              prefix: str = "") -> DataFrame:
    """Lines of the log files that overlap [start, end], plain or gzip: (file, name, block, nth, line).

    ``file`` is the whole path, since hosts may have files of one name; ``name`` is for display.

    A file carries its hour at the end of its name; the current file has none. The file filter is on file metadata, so
    files outside the range are never opened. ``block`` and ``nth`` order the lines of a file.
    """
    start, end = time_range(start, end, now)
    stem = F.regexp_replace(F.col("_metadata.file_name"), "\\.gz$", "")
    stamp = F.regexp_extract(stem, "\\.(\\d{4}-\\d{2}-\\d{2}-\\d{2})$", 1)
    current = F.lit(now.strftime("%Y-%m-%d-%H"))
    hour = F.when(stamp == "", current).otherwise(stamp)
    opens = F.to_timestamp_ntz(hour, F.lit("yyyy-MM-dd-HH"))
    closes = opens + F.expr("INTERVAL '1' HOUR")
    low, high = moment(start), moment(end)
    overlaps = (opens <= high) & (closes >= low)
    lines = spark.read.text(folder).where(overlaps & F.col("_metadata.file_name").startswith(prefix))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_name").alias("name"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("nth"),
        F.col("value").alias("line"),
    )
