"""Joins by order: each row with the last event that comes before it.

Rows and events are dealt by ranges of their order, so each side is shuffled once and no row is repeated. What holds at the
start of a range is the last event of the ranges before it: one row per range, carried over from an aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ranges per shuffle partition: they are dealt by hash, and many small ones come out even
RANGES = 8
#: rows that are looked at, per range, to find where ranges are cut
LOOKS = 16


def cuts_of(orders: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges`` - 1 values of the one string column that cut it into about equal parts, ascending.

    A random choice of ``ranges * LOOKS`` rows comes to the driver; where the cuts are changes no result.
    """
    chosen = sorted(r[0] for r in orders.orderBy(F.rand(7)).limit(ranges * LOOKS).collect())
    step = max(1, len(chosen) // ranges)
    return sorted(set(chosen[step::step])) if len(chosen) > ranges else []


def range_of(order: Column, cuts: list[str]) -> Column:
    """The number of cuts at or below ``order``, by binary search."""
    if not cuts:
        return F.lit(0)
    size = 1 << len(cuts).bit_length()
    table = F.array(*[F.lit(c) for c in cuts], *[F.lit(None).cast("string")] * (size - len(cuts)))
    steps = F.array(*[F.lit(1 << n) for n in reversed(range(len(cuts).bit_length()))])
    # null, beyond the last cut, is not at or below anything
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(table, low + step - 1) <= order, low + step).otherwise(low))


def last_event(rows: DataFrame, events: DataFrame, order: str, tie: str, event: str) -> DataFrame:
    """``rows`` with the column ``event`` of the last of ``events`` that comes before each, null where none does.

    Both have the columns ``order`` (a string that is not null) and ``tie`` (an integer, 0 or more or less, that decides
    among equal strings). ``events`` is read more than once and should be written.
    """
    spark = rows.sparkSession
    cuts = cuts_of(rows.select(order).union(events.select(order)), RANGES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    place = range_of(F.col(order), cuts)
    held = events.select(place.alias("__range"), F.col(order).alias("__order"), F.col(tie).alias("__tie"),
                         F.struct(F.col(event).alias("e")).alias("__event"))
    ends = held.groupBy("__range").agg(F.max_by("__event", F.struct("__order", "__tie")).alias("__event"))
    # at most one row per range
    every = spark.range(len(cuts) + 1).select(F.col("id").cast("int").alias("__range")).join(ends, "__range", "left")
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.select("__range", F.lit("").alias("__order"), F.lit(-(1 << 30)).alias("__tie"),
                           F.last("__event", ignorenulls=True).over(earlier).alias("__event"))
    wide = F.struct(*[F.col(c) for c in rows.columns])
    ours = rows.select(place.alias("__range"), F.col(order).alias("__order"), F.col(tie).alias("__tie"),
                       F.lit(None).cast(held.schema["__event"].dataType).alias("__event"), wide.alias("__row"))
    none = F.lit(None).cast(ours.schema["__row"].dataType).alias("__row")
    line = ours.unionByName(held.withColumn("__row", none)).unionByName(carried.withColumn("__row", none))
    before = Window.partitionBy("__range").orderBy("__order", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (line.withColumn("__last", F.last("__event", ignorenulls=True).over(before)).where("__row IS NOT NULL")
            .select("__row.*", F.col("__last.e").alias(event)))

