"""Exact top-k search with a vector-approximation file.

Vectors are kept in blocks, each with two parts: the approximation, one small cell number per component, and the exact
components. A search first scans only the approximations; the edges of a vector's cells bound its inner product with the
query from both sides. The k-th best lower bound over all vectors is a threshold that no result can fall below. Then each
task reads exact vectors in the order of their upper bounds, and stops as soon as its k-th exact score shows that nothing
further can be among the results.

The queries are a stated set; they meet the vectors block by block, at most ``QUERY_BLOCK`` of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.sources.scratch import written

#: queries that are broadcast together
QUERY_BLOCK = 4_096
#: vectors of a block
BLOCK = 1_024
CELLS = 64
#: exact vectors read at a time
READ = 128

SCORE = "query_id long, score long, vec_id long"


def scaled(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256) -> DataFrame:
    """``(vec_id, v)``: each component x as floor(scale * x), x taken as a double.

    Rows without an id or vector, and those with a null or non-finite component, take no part. An empty vector takes
    part; its score with any other empty vector is 0. Scores must fit a long.
    """
    x = F.transform(F.col(embedding), lambda c: F.floor(c.cast("double") * scale))
    good = F.forall(F.col(embedding), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return (table.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(good)
            .select(F.col(vec_id).cast("long").alias("vec_id"), x.cast("array<long>").alias("v")))


def edges(vectors: DataFrame, cells: int = CELLS) -> DataFrame:
    """Per dimension count and place the least and largest component over all vectors: what the cells divide evenly."""
    places = vectors.select(F.size("v").alias("dims"), F.posexplode("v").alias("place", "x"))
    return places.groupBy("dims", "place").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def _grid(ranges: list, cells: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per dimension count: the low edge of the first cell and the width of a cell, by place."""
    out = {}
    for dims in {r.dims for r in ranges}:
        own = sorted((r.place, r.low, r.high) for r in ranges if r.dims == dims)
        low = np.array([x[1] for x in own], np.int64)
        width = np.maximum(1, -(-(np.array([x[2] for x in own], np.int64) - low + 1) // cells))
        out[dims] = (low, width)
    return out


def build(vectors: DataFrame, cells: int = CELLS) -> tuple[DataFrame, dict]:
    """The approximation file, written, and its grid: rows ``(dims, ids, cells, exact)`` of up to ``BLOCK`` vectors."""
    grid = _grid(edges(vectors, cells).collect(), cells)  # one row per dimension
    kind = np.uint8 if cells <= 256 else np.uint16

    def pack(batches):
        for batch in batches:
            sizes = batch["v"].map(len).to_numpy()
            for dims in np.unique(sizes):
                rows = batch[sizes == dims].sort_values("vec_id")
                for start in range(0, len(rows), BLOCK):
                    part = rows.iloc[start:start + BLOCK]
                    exact = np.array(part["v"].tolist(), np.int64).reshape(len(part), dims)
                    low, width = grid.get(int(dims), (np.zeros(0, np.int64), np.ones(0, np.int64)))
                    yield pd.DataFrame({"dims": [int(dims)], "ids": [part["vec_id"].to_numpy(np.int64).tobytes()],
                                        "cells": [((exact - low) // width).astype(kind).tobytes()],
                                        "exact": [exact.tobytes()]})

    return written(vectors.mapInPandas(pack, "dims int, ids binary, cells binary, exact binary"), "vector-file"), grid


class Block:
    """One block of the file; exact vectors are looked at only by ``scores``."""

    def __init__(self, row, grid, kind):
        self.dims = int(row.dims)
        self.ids = np.frombuffer(row.ids, np.int64)
        low, width = grid.get(self.dims, (np.zeros(0), np.ones(0)))
        cells = np.frombuffer(row.cells, kind).reshape(len(self.ids), self.dims)
        # least and largest value that a cell's components can have
        self.low = (low + cells * width).astype(np.float64)
        self.high = self.low + (np.asarray(width) - 1)
        self.row = row

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each query's score with each vector, widened by what the arithmetic can be off."""
        plus, minus = np.maximum(queries, 0).astype(np.float64), np.minimum(queries, 0).astype(np.float64)
        lower = plus @ self.low.T + minus @ self.high.T
        upper = plus @ self.high.T + minus @ self.low.T
        most = np.maximum(np.abs(self.low), np.abs(self.high))
        slack = (plus - minus) @ most.T * (2.0 ** -50 * (self.dims + 1))
        slack[slack < 0.5] = 0  # sums of whole numbers this small are exact
        return lower - slack, upper + slack

    def scores(self, which: np.ndarray, query: np.ndarray) -> np.ndarray:
        exact = np.frombuffer(self.row.exact, np.int64).reshape(len(self.ids), self.dims)
        return exact[which] @ query


def _lower_bounds(file: DataFrame, shared, k: int) -> DataFrame:
    """Phase one: per task and query the k best lower bounds; it reads the approximations only."""

    def run(batches: Iterator[pd.DataFrame]):
        grid, kind, queries = shared.value
        best = {dims: np.full((len(ids), k), -np.inf) for dims, (ids, _) in queries.items()}
        for batch in batches:
            for row in batch.itertuples():
                block = Block(row, grid, kind)
                if block.dims not in queries:
                    continue
                ids, vectors = queries[block.dims]
                lower = block.bounds(vectors)[0]
                lower[block.ids[None, :] == ids[:, None]] = -np.inf
                both = np.concatenate([best[block.dims], lower], axis=1)
                best[block.dims] = -np.partition(-both, k - 1, axis=1)[:, :k]
        for dims, (ids, _) in queries.items():
            out = pd.DataFrame({"query_id": np.repeat(ids, k), "bound": best[dims].ravel()})
            yield out[np.isfinite(out["bound"])]

    return file.select("dims", "ids", "cells").mapInPandas(run, "query_id long, bound double")


def _exact(file: DataFrame, shared, thresholds, k: int) -> DataFrame:
    """Phase two: per task and query the k best exact scores of those that can still be results."""

    def run(batches: Iterator[pd.DataFrame]):
        grid, kind, queries = shared.value
        floors = thresholds.value
        found: dict[int, list[tuple[int, int]]] = {}
        for batch in batches:
            for row in batch.itertuples():
                block = Block(row, grid, kind)
                if block.dims not in queries:
                    continue
                ids, vectors = queries[block.dims]
                upper = block.bounds(vectors)[1]
                for n, query_id in enumerate(ids.tolist()):
                    best = found.get(query_id, [])
                    floor = max(floors.get(query_id, -np.inf), -best[-1][0] if len(best) == k else -np.inf)
                    open_ = np.flatnonzero((upper[n] >= floor) & (block.ids != query_id))
                    # best upper bound first, then the smaller id
                    open_ = open_[np.lexsort((block.ids[open_], -upper[n, open_]))]
                    for start in range(0, len(open_), READ):
                        part = open_[start:start + READ]
                        # a tie may still go to a smaller id, so only a smaller bound is certain
                        if len(best) == k and upper[n, part[0]] < -best[-1][0]:
                            break
                        read = zip((-block.scores(part, vectors[n])).tolist(), block.ids[part].tolist())
                        best = sorted([*best, *read])[:k]
                    found[query_id] = best
        out = [(query_id, -score, vec) for query_id, best in found.items() for score, vec in best]
        yield pd.DataFrame(out, columns=["query_id", "score", "vec_id"])

    return file.mapInPandas(run, SCORE)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, cells: int = CELLS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k vectors of largest inner product with each query, ties to smaller ids.

    ``vectors`` and ``queries`` are rows ``(vec_id, v)`` as ``scaled`` gives them. A query meets every vector of its own
    length but those that have its id; it has fewer than k results where there are fewer. Equal vectors tie. A row that
    is there twice can be a result twice; of several queries with one id the least vector counts. An empty table gives
    no rows. Queries are taken in blocks of ``QUERY_BLOCK``; each block is broadcast, scans the file twice and keeps
    k rows per query and task.
    """
    spark = vectors.sparkSession
    file, grid = build(vectors, cells)
    kind = np.uint8 if cells <= 256 else np.uint16
    parts = []
    # ids split the queries into ranges of at most QUERY_BLOCK; only these ranges are known to the driver
    numbered = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    total = numbered.count()
    cuts = ([] if total <= QUERY_BLOCK else
            numbered.approxQuantile("query_id", list(np.linspace(0, 1, 2 * total // QUERY_BLOCK + 2)[1:-1]), 0.0005))
    limits = [None, *sorted(set(cuts)), None]
    for low, high in zip(limits, limits[1:]):
        chosen = numbered
        if low is not None:
            chosen = chosen.where(F.col("query_id") > low)
        if high is not None:
            chosen = chosen.where(F.col("query_id") <= high)
        taken = chosen.toPandas()
        by_size = {int(d): (own["query_id"].to_numpy(np.int64), np.array(own["v"].tolist(), np.int64).reshape(len(own), int(d)))
                   for d, own in taken.groupby(taken["v"].map(len).astype(int))} if len(taken) else {}
        shared = spark.sparkContext.broadcast((grid, kind, by_size))
        near = Window.partitionBy("query_id").orderBy(F.col("bound").desc())
        bounds = (_lower_bounds(file, shared, k).withColumn("n", F.row_number().over(near)).where(f"n <= {k}")
                  .groupBy("query_id").agg(F.min("bound").alias("bound"), F.count("*").alias("n")).where(f"n = {k}"))
        floors = spark.sparkContext.broadcast({int(r.query_id): r.bound for r in bounds.collect()})
        best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        parts.append(_exact(file, shared, floors, k).withColumn("rank", F.row_number().over(best)).where(f"rank <= {k}"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, folder: str) -> DataFrame:
    vectors = scaled(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return search(vectors, vectors.where("vec_id % 50 = 0"))


ORACLE = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM p)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""
