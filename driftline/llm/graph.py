"""Connected components of a table of links, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.sources.scratch import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of the links ``(a, b)``; a component is named by its smallest node.

    Each round a node takes the smallest label among its neighbours' and its own, and then the label of that label, until
    nothing changes. Minima are reduced before they are shuffled, so a node with very many links is no hot key; each
    round is written, so a lost executor repeats one round at most. Links may repeat, be given one way only or lead
    back to their node; rows with a null end are no links.
    """
    both = links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    # each node is its own neighbour, so its label is among those it sees
    ends = both.union(both.select("b", "a"))
    edges = written(ends.union(ends.select("a", F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "labels")
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("component").alias("__new"), F.max(F.when(F.col("a") == F.col("b"), F.col("component"))).alias("__old")))
        above = labels.select(F.col("node").alias("__new"), F.col("component").alias("__jump"))
        labels = written(near.join(above, "__new").select("node", "__old", F.least("__new", "__jump").alias("component")), "labels")
        if labels.where("component <> __old").isEmpty():
            return labels.select("node", "component")
