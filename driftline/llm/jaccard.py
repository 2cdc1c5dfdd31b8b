"""N-gram Jaccard join with filters under several global token orders.

Documents are sets of five-word shingles; equal sets form one class. Two sets of Jaccard similarity 0.8 or more share, under
any order of all tokens, one of the first n - ceil(0.8 n) + 1 tokens of each. That holds for every order, so a pair is a candidate only if
it shares prefix tokens under all of them:

- order A puts the tokens of a fixed part of the hash range first, of those the ones that stand in a single class, then
  the others by how often they stand. Most documents have enough tokens of their own to fill the prefix: they are done.
- orders B and C are by two other hashes.
- order D, for the sets that are still open, counts all of their tokens: first those that no other component has, then the
  others by how often they stand.

Candidates that have no common prefix tokens under one of the orders fall, the rest is verified on the whole sets. Where
many sets share prefix tokens they are not paired with one another at first, but with one of them, the pivot of the token;
sets that this brings into one component need no further links, and only sets of different components that share a
prefix token stay open. What is left at the end is paired. A pair must pass the positional filter: its first common token
stands early enough in both for the overlap that the sizes call for.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.llm import shingles
from driftline.llm.bitmaps import bitmap, marked
from driftline.llm.graph import components
from driftline.llm.memory import give_back
from driftline.llm.names import every, fresh
from driftline.sources.scratch import written

PERCENT = 80
#: share of the hash range whose tokens order A puts first
FIRST = 0.3


def prefix_length(n: np.ndarray | int):
    """How many first tokens of a set of n hold one of each set that it is similar to: n - ceil(0.8 n) + 1."""
    return n - (PERCENT * n + 99) // 100 + 1


def _order(tokens: np.ndarray, seed: int) -> np.ndarray:
    return shingles.mix(tokens ^ np.uint64(0x9E3779B97F4A7C15 * seed % (1 << 64)))


def _first(tokens: np.ndarray, seed: int, count: int) -> np.ndarray:
    """The first ``count`` tokens under the order of this seed."""
    if count >= len(tokens):
        return tokens
    return tokens[np.argpartition(_order(tokens, seed), count - 1)[:count]]


def signature(tokens: np.ndarray) -> int:
    """Names a set: equal sets have equal names."""
    parts = np.array([_order(tokens, 4).sum(dtype=np.uint64), len(tokens)], np.uint64)
    parts[1:] *= np.uint64(0xD6E8FEB86659FD93)
    return int(shingles.mix(parts.sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0])


def sets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document ``doc_id, sig, n, t, tokens``: the name and size of its set, how many tokens lie in the first part
    of the hash range, and those tokens (with the next ones, where they are fewer than the prefix). ``sig`` is null for an empty set."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    limit = np.uint64(min(int(FIRST * 2 ** 64), 2 ** 64 - 1))

    def run(batches):
        for batch in batches:
            out = []
            for tokens in shingles.sets(batch["text"].tolist()):
                n = len(tokens)
                if not n:
                    out.append((None, 0, 0, []))
                    continue
                place = _order(tokens, 1)
                inside = place < limit
                t = int(inside.sum())
                kept = tokens[inside] if t >= prefix_length(n) else _first(tokens, 1, int(prefix_length(n)))
                out.append((signature(tokens), n, t, kept.view(np.int64)))
            # a nullable integer column keeps the names exact
            made = pd.DataFrame(out, columns=["sig", "n", "t", "tokens"])
            made["sig"] = pd.array([x[0] for x in out], dtype="Int64")
            made.insert(0, "doc_id", pd.array(batch["doc_id"], dtype="Int64") if batch["doc_id"].dtype.kind != "i" else batch["doc_id"].to_numpy())
            yield made
            give_back()

    return rows.mapInPandas(run, "doc_id long, sig long, n long, t long, tokens array<long>")


def prefixes(named: DataFrame) -> DataFrame:
    """Order A's prefix tokens that two classes share: ``(token, sig, n, pos, own)``, only of classes that have any.

    ``pos`` is the token's place in the ordered set, or 0 where only a lower bound is at hand; ``own`` is the share of the
    counted tokens that no other class has.
    """
    rows = named.where("sig IS NOT NULL").select("sig", F.explode("tokens").alias("token"))
    shared = (rows.groupBy("token").agg(F.min("sig").alias("a"), F.max("sig").alias("b"), F.count("*").alias("often"))
              .where("a <> b").select("token", "often"))
    posts = written(rows.join(shared, "token").distinct(), "shared-tokens")
    # the part of a token's hash is found again from its class: tokens outside the first part come only from classes that
    # have fewer than a prefix inside, and of those every listed token is in the prefix
    classes = (named.where("sig IS NOT NULL").groupBy("sig").agg(F.max("n").alias("n"), F.max("t").alias("t"))
               .withColumn("p", F.expr(f"n - ({PERCENT} * n + 99) div 100 + 1")))
    counts = posts.groupBy("sig").agg(F.count("*").alias("s")).join(classes, "sig")
    # room: what the tokens of a single class leave of the prefix; where t < p the whole list is the prefix
    room = counts.withColumns({"room": F.expr("CASE WHEN t < p THEN s ELSE p - (t - s) END"),
                               "before": F.expr("CASE WHEN t < p THEN NULL ELSE t - s END"),
                               "own": F.expr("(greatest(t, p) - s) / greatest(t, p)")}).where("room > 0")
    rarest = Window.partitionBy("sig").orderBy("often", "token")
    return (posts.join(room.select("sig", "n", "room", "before", "own"), "sig").withColumn("nth", F.row_number().over(rarest))
            .where("nth <= room").select("token", "sig", "n", F.expr("coalesce(before + nth - 1, 0)").alias("pos"), "own"))


def members(docs: DataFrame, named: DataFrame, posts: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(sig, n, b, c, tokens)`` of every class in ``posts``: its prefixes under orders B and C and its whole set."""
    wanted = posts.select("sig").distinct()
    # any one document of a class has its set
    chosen = named.join(wanted, "sig", "left_semi").groupBy("sig").agg(F.min("doc_id").alias("__id")).select("__id").distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # most texts have no part in this and are left out before the shuffle
    some = marked(texts, bitmap(chosen, F.col("__id")), "some", F.col("doc_id")).where("some")
    rows = some.join(chosen, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("text")

    def run(batches):
        for batch in batches:
            out = []
            for tokens in shingles.sets(batch["text"].tolist()):
                if len(tokens):
                    p = int(prefix_length(len(tokens)))
                    out.append((signature(tokens), len(tokens), *(_first(tokens, seed, p).view(np.int64) for seed in (2, 3)), tokens.view(np.int64)))
            yield pd.DataFrame(out, columns=["sig", "n", "b", "c", "tokens"])
            give_back()

    made = rows.mapInPandas(run, "sig long, n long, b array<long>, c array<long>, tokens array<long>")
    return made.join(wanted, "sig", "left_semi").dropDuplicates(["sig"])


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """The pairs ``(x, y)`` whose sets are similar: first the filters under orders B and C, then the exact sizes."""
    side = lambda one: whole.select(*[F.col(c).alias(f"{one}_{c}") for c in ("n", "b", "c", "tokens")], F.col("sig").alias(one))
    common = F.size(F.array_intersect("x_tokens", "y_tokens"))
    return (pairs.join(side("x"), "x").join(side("y"), "y")
            .where(F.arrays_overlap("x_b", "y_b") & F.arrays_overlap("x_c", "y_c"))
            .where(100 * common >= PERCENT * (F.col("x_n") + F.col("y_n") - common)).select("x", "y"))


#: the length filter; and the positional one: what is left of each set from the common token on must hold the overlap
MAY_MATCH = (f"100 * least(xn, yn) >= {PERCENT} * greatest(xn, yn) AND "
             f"({100 + PERCENT}) * least(xn - xp, yn - yp) >= {PERCENT} * (xn + yn)")


def opened(posts: DataFrame, comps: DataFrame | None) -> DataFrame | None:
    """The postings, with ``comp``, of tokens that sets of more than one component share; None if there are none."""
    labelled = posts.withColumn("comp", F.col("sig")) if comps is None else posts.join(
        comps.withColumnRenamed("node", "sig"), "sig", "left").select(*posts.columns, F.coalesce("component", "sig").alias("comp"))
    mixed = labelled.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b")
    left = written(labelled.join(mixed.select("token"), "token", "left_semi"), "open-prefixes")
    return None if left.isEmpty() else left


def whole_prefixes(open_posts: DataFrame, whole: DataFrame) -> DataFrame:
    """Order D's prefix tokens of the open sets that two components share, as ``prefixes`` gives them.

    Sets that are still to be linked share an open token, so all of them are here, and tokens that only one
    component has cannot be in common with a set that is still to be linked.
    """
    sets_ = open_posts.select("sig", "comp").distinct().join(whole.select("sig", "n", "tokens"), "sig")
    rows = sets_.select("sig", "comp", F.explode("tokens").alias("token"))
    shared = (rows.groupBy("token").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("often"))
              .where("a <> b").select("token", "often"))
    posts = written(rows.select("sig", "token").join(shared, "token"), "whole-tokens")
    sizes = whole.select("sig", "n")
    counts = posts.groupBy("sig").agg(F.count("*").alias("s")).join(sizes, "sig").withColumns({
        "room": F.expr(f"s - ({PERCENT} * n + 99) div 100 + 1"), "own": F.expr("(n - s) / n")}).where("room > 0")
    rarest = Window.partitionBy("sig").orderBy("often", "token")
    return (posts.join(counts, "sig").withColumn("nth", F.row_number().over(rarest))
            .where("nth <= room").select("token", "sig", "n", F.expr("n - s + nth - 1").alias("pos"), "own"))


def _side(posts: DataFrame, one: str) -> list:
    return [F.col(c).alias(f"{one}{to}") for c, to in (("sig", ""), ("n", "n"), ("pos", "p"), ("comp", "c"))]


def _paired(pairs: DataFrame) -> DataFrame:
    return pairs.where(f"xc <> yc AND {MAY_MATCH}").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def links(posts: DataFrame, whole: DataFrame) -> DataFrame:
    """Links ``(a, b)`` between classes, enough of them to connect every two classes that are similar."""
    posts, whole = written(posts, "prefixes"), written(whole, "sets")
    found, comps = posts.select(F.col("sig").alias("x"), F.col("sig").alias("y")).limit(0), None
    for turn in ("A", "D", "all"):
        left = opened(posts, comps)
        if left is not None and turn == "D":
            posts = written(whole_prefixes(left, whole), "prefixes")
            left = opened(posts, comps)
        if left is None:
            break
        x = left.select("token", *_side(left, "x"))
        if turn == "all":
            pairs = _paired(x.join(left.select("token", *_side(left, "y")), "token").where("x < y"))
        else:
            # the set with the least of its own: copies that were changed apart all resemble it
            best = F.min(F.struct("own", F.xxhash64("sig").alias("h"), *_side(left, "y"))).alias("p")
            pivot = left.groupBy("token").agg(best).select("token", "p.y", "p.yn", "p.yp", "p.yc")
            pairs = _paired(x.join(pivot, "token"))
        found = found.union(written(verified(pairs, whole), "links"))
        comps = components(found.select(F.col("x").alias("a"), F.col("y").alias("b"))) if turn != "all" else None
    return found.select(F.col("x").alias("a"), F.col("y").alias("b"))


def join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row ``doc_id, n_shingles, component_id``: the size of its set and the smallest id that links lead to.

    Null and empty texts and texts without words have the empty set, which is linked with nothing: each is its own
    component. Documents with equal sets are linked, repeated rows too. Rows with a null id take part; they get the
    component's smallest id that is not null (null if there is none). An empty table has no rows.
    """
    named = written(sets(docs, text, doc_id), "named-sets")
    posts = written(prefixes(named), "prefixes")
    whole = members(docs, named, posts, text, doc_id)
    of_class = components(links(posts, whole)).withColumnRenamed("node", "sig")
    rows = named.select("doc_id", "sig", "n")
    classes = (rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min("doc_id").alias("least"))
               .join(of_class, "sig", "left").select("sig", "least", F.coalesce("component", "sig").alias("component")))
    names = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = classes.join(names, "component").select("sig", "component_id")
    return rows.join(lookup, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return join(spark.read.parquet(f"{folder}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each component: the one with the smallest id, then with the smallest hash of its text.

    Rows are told apart by id and text, so an id may stand in several rows with different texts, or be null: such a row is
    a document like any other, and goes only if another of its component stays (a null id is larger than all others). A
    row that is there twice is one document. Rows without words stay.
    """
    key = fresh(docs, "row")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    named = join(rows.select(F.col(key), "text"), doc_id=key).select(F.col("doc_id").alias(key), "component_id")
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(key).alias("k"))).alias("least")
    kept = named.distinct().join(rows.select(key, "doc_id"), key).groupBy("component_id").agg(least).select(F.col("least.k").alias(key))
    return rows.join(kept, key, "left_semi").dropDuplicates([key]).select(*every(docs))
