"""Orders, running totals, splits of a listing, and pages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftline.sources.scratch import written

FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def placed(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows range-partitioned by keys and order, written once so that partition numbers (``__part``) stay fixed."""
    ranged = df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id())
    return written(ranged, "placed")


def fold(rows: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]],
         inclusive: bool = True) -> DataFrame:
    """Running sum, max or min over rows of :func:`placed`; ``values`` maps each new column to (fold, expression).

    Each partition folds its own rows, and what earlier partitions add to a key is joined from a table with at most one
    row per partition. May be applied again to its own result.
    """
    given = rows.columns
    rows = rows.withColumns({f"__in_{new}": expr for new, (_, expr) in values.items()})
    group = [*keys, "__part"]
    totals = rows.groupBy(*group).agg(
        *[FOLDS[how](f"__in_{new}").alias(f"__sum_{new}") for new, (how, _) in values.items()])
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *group,
        F.row_number().over(Window.partitionBy(*keys).orderBy("__part")).alias("__nth"),
        *[FOLDS[how](f"__sum_{new}").over(before).alias(f"__carry_{new}") for new, (how, _) in values.items()],
    ).where("__nth > 1").drop("__nth")

    upto = Window.currentRow if inclusive else -1
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    local = rows.withColumns(
        {f"__here_{new}": FOLDS[how](f"__in_{new}").over(inside) for new, (how, _) in values.items()})
    # at most one key reaches into a partition from the left: the table has no more rows than there are partitions
    joined = local.join(F.broadcast(carry), group, "left")

    def total(new: str, how: str) -> Column:
        here, carried = F.col(f"__here_{new}"), F.col(f"__carry_{new}")
        if how == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(carried, F.lit(0))
        return F.greatest(here, carried) if how == "max" else F.least(here, carried)

    return joined.select(*given, *[total(new, how).alias(new) for new, (how, _) in values.items()])


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]],
            inclusive: bool = True) -> DataFrame:
    """Running sum, max or min per ``keys`` in ``order`` without one task ever holding a whole key.

    ``order`` must be unique within a key, and both must be the same whenever ``df`` is read. Only keys, order and values
    are placed and written (:func:`placed`, :func:`fold`); what comes out is joined back to the whole rows.
    """
    on = [*keys, *order]
    narrow = df.select(*on, *[expr.alias(f"__value_{new}") for new, (_, expr) in values.items()])
    folded = fold(placed(narrow, keys, order), keys, order,
                  {new: (how, F.col(f"__value_{new}")) for new, (how, _) in values.items()}, inclusive)
    found = folded.select(*[F.col(c).alias(f"__on_{c}") for c in on], *values)
    same = [F.col(c).eqNullSafe(F.col(f"__on_{c}")) for c in on]
    return df.join(found, same).drop(*[f"__on_{c}" for c in on])


def numbered(df: DataFrame, keys: list[str], order: list[str], into: str) -> DataFrame:
    """Row number from 1 per ``keys`` in ``order``, computed as in :func:`running`."""
    return running(df, keys, order, {into: ("sum", F.lit(1).cast("bigint"))})


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1,
                   rank: str | None = None) -> DataFrame:
    """First ``n`` rows of each key. The limit reaches below the shuffle, so a hot key sends few rows."""
    column = rank or "__rank"
    ranked = df.withColumn(column, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(column) <= n)
    return kept if rank else kept.drop(column)


def page(df: DataFrame, order_by: str, sort: str = "ASC", offset: int = 0, n: int = 10,
         tie: list[str] | None = None, allowed: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """One page of a listing; ties are broken by unique columns so that pages never overlap.

    ``cap`` is the caller's limit of rows per page, if there is one; more is an error.
    """
    if allowed is not None and order_by not in allowed:
        raise ValueError(f"cannot order by {order_by}; use one of {allowed}")
    word = sort.upper()
    if word not in ("ASC", "DESC"):
        raise ValueError(f"sort order must be ASC or DESC, not {sort}")
    first = F.col(order_by).asc_nulls_first() if word == "ASC" else F.col(order_by).desc_nulls_last()
    return df.orderBy(first, *(tie or [])).offset(max(offset, 0)).limit(page_size(n, cap))


def page_after(df: DataFrame, order_by: str, after: tuple | None, sort: str = "ASC", n: int = 10, tie: list[str] | None = None,
               allowed: list[str] | None = None, cap: int | None = None) -> DataFrame:
    """The page behind a row: the same pages as :func:`page` gives by offset, without sorting what came before.

    ``after`` is the cursor of the last row seen, its order value and then its ties (:func:`cursor`); None asks for the
    first page. The condition is a filter on the columns, which reaches the files, and the rest a top-n.
    """
    first = page(df, order_by, sort, 0, n, tie, allowed, cap)  # checks what is asked for
    if after is None:
        return first
    value, ties = after[0], list(zip(tie or [], after[1:]))
    if not ties or len(after) != len(tie or []) + 1:
        raise ValueError("a cursor holds the order value and a value of each tie column")
    behind, same = F.lit(False), F.lit(True)
    for name, held in ties:  # one tie after the other, in ascending order with nulls first
        column = F.col(name)
        behind = behind | (same & (column.isNotNull() if held is None else column > F.lit(held)))
        same = same & (column.isNull() if held is None else column == F.lit(held))
    key = F.col(order_by)
    if sort.upper() == "ASC":  # nulls first
        rest = (key.isNull() & behind) | key.isNotNull() if value is None else (key > F.lit(value)) | ((key == F.lit(value)) & behind)
    else:  # nulls last
        rest = key.isNull() & behind if value is None else (key < F.lit(value)) | key.isNull() | ((key == F.lit(value)) & behind)
    return page(df.where(rest), order_by, sort, 0, n, tie, allowed, cap)


def cursor(rows: DataFrame, order_by: str, tie: list[str], sort: str = "ASC") -> tuple | None:
    """The cursor of a page's last row, None for an empty page."""
    column = F.col(order_by)
    last = [column.desc_nulls_last() if sort.upper() == "ASC" else column.asc_nulls_first(), *[F.col(c).desc_nulls_last() for c in tie]]
    found = rows.select(order_by, *tie).orderBy(*last).head()
    return None if found is None else tuple(found)


def page_size(n: int | None, cap: int | None = None, default: int = 10) -> int:
    """Rows per page: the default for none or a non-positive number; more than the cap is an error."""
    size = n if n is not None and n > 0 else default
    if cap is not None and size > cap:
        raise ValueError(f"a page of {size} rows is over the limit of {cap}")
    return size


def sort_listing(manifest: DataFrame) -> DataFrame:
    return manifest.orderBy("rel_path")


def balance_by_bytes(manifest: DataFrame, n: int, at_least: int = 0) -> DataFrame:
    """Adds ``part``, from 0 to n-1: contiguous parts, in path order, of about total/n bytes each.

    ``at_least`` is the size a file counts for at the least, so that many empty files do not all fall into one part.
    """
    weight = F.greatest(F.col("length"), F.lit(at_least).cast("bigint"))
    total = manifest.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("total")).first()["total"]
    size = max(math.ceil(total / n), 1)
    before = running(manifest, [], ["rel_path"], {"__before": ("sum", weight)}, inclusive=False)
    return before.withColumn("part", F.floor(F.col("__before") / F.lit(size)).cast("bigint")).drop("__before")
