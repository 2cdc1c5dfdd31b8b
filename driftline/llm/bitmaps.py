"""A filter of fixed size: which of very many rows may have a partner, told before they are shuffled.

A set of keys becomes a bitmap of ``BITS`` bits, whatever its size, one bit per hash of a key. Rows whose bit is not set
have no partner for certain; the others may. The bitmap, one megabyte, is broadcast; with very many keys it lets more rows
through, never fewer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.names import every, fresh
from driftline.sources.scratch import written

BITS = 1 << 23


def _place(*key: Column) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS)) + 1


def bitmap(rows: DataFrame, *key: Column) -> DataFrame:
    """The bitmap of the keys of ``rows``, written: at most BITS / 32768 + 1 rows of 4096 bytes."""
    places = rows.select(_place(*key).alias("p"))
    return written(places.groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")), "bitmap")


def marked(df: DataFrame, bits: DataFrame, name: str, *key: Column) -> DataFrame:
    """``df`` with a boolean column ``name``: false where the key is in no row that made the bitmap."""
    bucket, held, place = (fresh(df, n) for n in ("bucket", "bits", "place"))
    table = F.broadcast(bits.select(F.col("bucket").alias(bucket), F.col("bits").alias(held)))  # BITS bits in all
    rows = df.withColumn(place, _place(*key))
    at = F.bitmap_bit_position(F.col(place))
    byte = F.conv(F.hex(F.substring(F.col(held), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.call_function("getbit", byte, (at % 8).cast("int")) == 1, F.lit(False))
    return (rows.join(table, F.bitmap_bucket_number(F.col(place)) == F.col(bucket), "left")
            .select(*every(df), hit.alias(name)))
