"""Join helpers for keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# adaptive execution splits what is still too large
SALTS = 8


def hot_join(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "inner",
             spread: Column | None = None, salts: int = SALTS) -> DataFrame:
    """Join where one key of ``fact`` may be hot: each key is spread over ``salts`` partitions.

    ``dim`` is repeated once per salt, so each fact row still meets each matching row exactly once. ``spread`` picks the
    salt of a fact row and should be unique per row; it defaults to the whole row. It is a value of the row, not a row
    number, so that a task that runs again deals its rows the same way. Valid for inner, left, left_semi and left_anti.

    ``dim`` grows with the input too and its files are far smaller than its rows in memory, so it is never broadcast: both
    sides are sorted and merged, which spills instead of holding ``dim`` once per salt in every executor.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot salt a {how} join")
    if spread is None:
        # maps have no hash
        spread = F.xxhash64(*[f.name for f in fact.schema if "map<" not in f.dataType.simpleString()])
    else:
        spread = F.xxhash64(spread)
    left = fact.withColumn("__salt", F.pmod(spread, F.lit(salts)).cast("int"))
    right = dim.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*on, "__salt"], how).drop("__salt")
