"""Chains of rows, each of which points to the next, followed by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.sources.scratch import written


def reached(heads: DataFrame, pointers: DataFrame) -> DataFrame:
    """The nodes (``node``) of all chains that start at ``heads``; ``pointers`` has (node, next), one row per node.

    Pointer doubling: a round adds what lies one jump behind the nodes found so far, then doubles the jumps, so a chain of
    n nodes takes log2(n) rounds of two joins, wherever its nodes lie. Chains of different heads must not meet, and none
    leads back to itself. Each round is written, so a lost executor repeats one round at most.
    """
    found = heads.select("node")
    jumps = written(pointers.select("node", "next"), "jumps")
    while not jumps.isEmpty():
        behind = found.join(jumps, "node").select(F.col("next").alias("node"))
        found = written(found.union(behind), "reached")
        second = jumps.select(F.col("node").alias("next"), F.col("next").alias("__over"))
        # a jump that leads over the end of its chain is gone
        jumps = written(jumps.join(second, "next").select("node", F.col("__over").alias("next")), "jumps")
    return found
