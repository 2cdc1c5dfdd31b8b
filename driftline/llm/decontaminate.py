"""Benchmark decontamination: item-sized windows of the documents against the items, by SimHash.

Windows. The shingles of a window are counted, their order is not: a window may hold an item's parts in any order. All
places are therefore open to a window as long as an item that has a five-word shingle in common with the document. A window
of n shingles and an item of m come up to a similarity of 0.8 only if 0.8 / 1.8 * (n + m) places of the window hold a shingle of
the item; the others are passed over. Items of fewer than five words are looked up among the runs of as many words.

Search. Every item and window has a 128-bit SimHash of its weighted shingles. Fingerprints are cut into 16 blocks of a
byte; two within radius 16 * (r + 1) - 1 agree up to r bits in at least one block. Joining the windows' bytes with all bytes within r
bits of an item's byte therefore finds every pair within the radius.

Verification. Candidates are compared exactly: the weighted Jaccard similarity of the shingle multisets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm import shingles
from driftline.llm.memory import give_back
from driftline.llm.names import every, fresh

SIMILARITY = 0.8
BITS, BYTE = 128, 8
#: bits that one byte of two fingerprints may differ in; the radius is BITS / BYTE * (SLACK + 1) - 1 = 47 bits. At a
#: similarity of 0.8 fingerprints differ in 19 bits on average, with a deviation of 4.
SLACK = 2
RADIUS = BITS // BYTE * (SLACK + 1) - 1
#: items whose shingles are broadcast together
ITEM_BLOCK = 50_000
#: places whose windows are fingerprinted from the same running sums
RUN = 4_096

_LANES = np.arange(1, BITS // 64 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
_NEAR = [np.array([x for x in range(256) if bin(x).count("1") <= r], np.uint8) for r in range(9)]


def signs(hashes: np.ndarray) -> np.ndarray:
    """Per hash BITS signs, -1 or 1."""
    lanes = shingles.mix(hashes[:, None] + _LANES[None, :])
    bits = np.unpackbits(lanes.astype("<u8").view(np.uint8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a multiset of shingles, as bytes; a shingle weighs as often as it stands."""
    return np.packbits(signs(hashes).sum(axis=0) > 0)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of hashes."""
    values, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(where[:len(a)], minlength=len(values)), np.bincount(where[len(a):], minlength=len(values))
    return float(np.minimum(x, y).sum() / max(1, np.maximum(x, y).sum()))


def _items(rows: list) -> dict:
    """Items by shingle: sorted shingles with the items that have them and how often, and per item its words, shingles and
    bytes; items of fewer than ``shingles.SIZE`` words by their number of words, too."""
    hashes, counts = shingles.words([r.text for r in rows])
    marks, made = shingles.of_words(hashes, counts)
    parts = np.split(marks, np.cumsum(made)[:-1]) if len(rows) else []
    prints = np.stack([fingerprint(p) for p in parts]) if parts else np.zeros((0, BITS // BYTE), np.uint8)
    owner = np.repeat(np.arange(len(rows)), made)
    order = np.lexsort((owner, marks))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(marks[order]) != 0) | (np.diff(owner[order]) != 0)
    first = order[first]
    short = {}
    for size in range(1, shingles.SIZE):
        which = np.flatnonzero(counts == size)
        if len(which):
            runs, _ = shingles.of_words(hashes[np.repeat(counts == size, counts)], counts[which], size)
            by_run = np.argsort(runs, kind="stable")
            short[size] = runs[by_run], which[by_run]
    return {"ids": [r.item_id for r in rows], "words": counts, "parts": parts, "prints": prints, "marks": marks[first],
            "owner": owner[first], "short": short, "low": np.isin(np.arange(1 << 20), marks & np.uint64((1 << 20) - 1))}


def _near_items(prints: np.ndarray) -> list[dict[int, np.ndarray]]:
    """The multi-index: per byte place the items for which a byte is within SLACK bits of theirs."""
    out = []
    for place in range(prints.shape[1]):
        near: dict[int, list[int]] = {}
        for item, byte in enumerate(prints[:, place]):
            for flip in _NEAR[SLACK]:
                near.setdefault(int(byte ^ flip), []).append(item)
        out.append({byte: np.array(found) for byte, found in near.items()})
    return out


def _found(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places ``(in values, in known)`` with equal hashes; ``known`` is sorted."""
    left = np.searchsorted(known, values, side="left")
    found = np.searchsorted(known, values, side="right") - left
    return np.repeat(np.arange(len(values)), found), np.repeat(left - (np.cumsum(found) - found), found) + np.arange(int(found.sum()))


def _windows(marks: np.ndarray, count: int, items: dict) -> dict[int, np.ndarray]:
    """Per number of words the starts, ascending, of the windows of a text with ``count`` words and shingles ``marks`` that
    can come up to SIMILARITY with an item."""
    some = np.flatnonzero(items["low"][marks & np.uint64((1 << 20) - 1)])
    at, hit = _found(marks[some], items["marks"])
    if not len(at):
        return {}
    at, owner = some[at], items["owner"][hit]
    sizes = np.unique(np.minimum(items["words"][owner], count))
    # the larger multiset bounds the similarity, so most of an item must stand somewhere in the text
    order = np.argsort(owner, kind="stable")
    at, owner = at[order], owner[order]
    edges = np.append(np.flatnonzero(np.diff(owner, prepend=-1)), len(owner))
    out: dict[int, list[np.ndarray]] = {}
    for low, high in zip(edges, edges[1:]):
        whole = len(items["parts"][owner[low]])
        if high - low < SIMILARITY * whole:
            continue
        places = at[low:high]
        for size in sizes.tolist():
            made = max(1, size - shingles.SIZE + 1)
            if min(made, whole) < SIMILARITY * max(made, whole):
                continue
            need = math.ceil(SIMILARITY / (1 + SIMILARITY) * (made + whole) - 1e-9)
            if len(places) < need:
                continue
            # the starts from which so many places in a row are reached
            first, last = places[:len(places) - need + 1], places[need - 1:]
            begin, stop = np.maximum(last - made + 1, 0), np.minimum(first, len(marks) - made) + 1
            begin, room = begin[stop > begin], (stop - begin)[stop > begin]
            if len(begin):
                out.setdefault(size, []).append(np.repeat(begin - (np.cumsum(room) - room), room) + np.arange(int(room.sum())))
    return {size: np.unique(np.concatenate(starts)) for size, starts in out.items()}


def _prints(marks: np.ndarray, starts: np.ndarray, made: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(start, fingerprint)`` of the windows of ``made`` shingles at ``starts``, ascending, by running sums."""
    low = 0
    while low < len(starts):
        high = int(np.searchsorted(starts, starts[low] + RUN, side="right"))
        part, low = starts[low:high], high
        sums = np.zeros((int(part[-1] - part[0]) + made + 1, BITS), np.int32)
        np.cumsum(signs(marks[part[0]:part[-1] + made]), axis=0, out=sums[1:])
        yield from zip(part.tolist(), np.packbits(sums[part - part[0] + made] - sums[part - part[0]] > 0, axis=1))


def _hits(marks: np.ndarray, count: int, items: dict, index: list) -> list[tuple[int, int, int, float]]:
    """``(item, start, words, similarity)`` of all windows of one text that come up to SIMILARITY, by start."""
    out = []
    for size, starts in _windows(marks, count, items).items():
        made = max(1, size - shingles.SIZE + 1)
        for start, print_ in _prints(marks, starts, made):
            near = [index[place].get(int(byte)) for place, byte in enumerate(print_)]
            near = [n for n in near if n is not None]
            if not near:
                continue
            candidates = np.unique(np.concatenate(near))
            apart = np.unpackbits(items["prints"][candidates] ^ print_, axis=1).sum(axis=1)
            for item in candidates[apart <= RADIUS]:
                part = items["parts"][item]
                # the larger multiset bounds the similarity
                if min(len(part), made) < SIMILARITY * max(len(part), made):
                    continue
                value = similarity(marks[start:start + made], part)
                if value >= SIMILARITY:
                    out.append((int(item), start, size, value))
    return sorted(out, key=lambda hit: hit[1:3])


def _short_hits(hashes: np.ndarray, counts: np.ndarray, items: dict) -> dict[int, list[tuple[int, int, int, float]]]:
    """Per text ``(item, start, words, 1)`` of the first place of each item of fewer than ``shingles.SIZE`` words."""
    out: dict[int, list] = {}
    for size, (known, owner) in items["short"].items():
        runs, made = shingles.of_words(hashes, counts, size)
        at, hit = _found(runs, known)
        ends = np.cumsum(made)
        text = np.searchsorted(ends, at, side="right")
        _, first = np.unique(text * len(items["ids"]) + owner[hit], return_index=True)
        for i, place, item in zip(text[first].tolist(), at[first].tolist(), owner[hit[first]].tolist()):
            out.setdefault(i, []).append((item, place - int(ends[i] - made[i]), size, 1.0))
    return out


def find(docs: DataFrame, benchmark: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``(keys, item_id, start_word, n_words, similarity)``: the best window of each document and item, first of equals.

    ``keys`` name columns that tell documents apart; rows with equal keys are searched each on their own and give one row
    each. Null and empty texts, and items without words, give nothing; a text or item of fewer than five words is one
    shingle, and such an item is found wherever its words stand in a row. Items without an id are left out. Items are
    broadcast ``ITEM_BLOCK`` at a time; documents are neither shuffled nor collected, and a text of any length is searched
    whole by the task that reads it. Other columns, of any name, are left out.
    """
    spark = docs.sparkSession
    rows = docs.select(*keys, F.col(text).alias("__text"))
    kinds = [f for f in rows.schema.fields if f.name in keys]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kinds),
                        "item_id long, start_word long, n_words long, similarity double"])
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.count()
    cuts = items.approxQuantile("item_id", list(np.linspace(0, 1, 2 * total // ITEM_BLOCK + 2)[1:-1]), 0.0005) if total > ITEM_BLOCK else []
    limits, parts = [None, *sorted(set(cuts)), None], []
    for low, high in zip(limits, limits[1:]):
        chosen = items if low is None else items.where(F.col("item_id") > low)
        chosen = chosen if high is None else chosen.where(F.col("item_id") <= high)
        shared = spark.sparkContext.broadcast(_items(chosen.orderBy("item_id").collect()))

        def run(batches, shared=shared):
            items = shared.value
            index = _near_items(items["prints"])
            for batch in batches:
                texts, found = batch["__text"].tolist(), []
                for begin, stop in shingles.blocks(texts):
                    hashes, counts = shingles.words(texts[begin:stop])
                    marks, made = shingles.of_words(hashes, counts)
                    # texts of a block without any shingle of an item are passed over at once
                    some = items["low"][marks & np.uint64((1 << 20) - 1)]
                    ends = np.cumsum(made)
                    short = _short_hits(hashes, counts, items)
                    owners = {*np.searchsorted(ends, np.flatnonzero(some), side="right").tolist(), *short}
                    for i in sorted(owners):
                        best: dict[int, tuple] = {}
                        for item, start, size, value in [*_hits(marks[ends[i] - made[i]:ends[i]], int(counts[i]), items, index), *short.get(i, [])]:
                            if item not in best or value > best[item][2]:
                                best[item] = (start, size, value)
                        found += [(begin + i, items["ids"][item], *best[item]) for item in sorted(best)]
                if found:
                    out = batch[keys].iloc[[f[0] for f in found]].reset_index(drop=True)
                    for n, name in enumerate(("item_id", "start_word", "n_words", "similarity"), 1):
                        out[name] = [f[n] for f in found]
                    yield out
                give_back()

        parts.append(rows.mapInPandas(run, schema))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def query(spark: SparkSession, folder: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    return find(docs, benchmark, ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a benchmark item; the found ones go whole.

    Rows are told apart by id and text: of several rows with one id, or without one, only those that hold an item go. Items
    count by their text, so one without an id counts as well.
    """
    key = fresh(docs, "row")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    items = spark.read.parquet(f"{folder}/benchmark.parquet").select(F.xxhash64("text").alias("item_id"), "text").distinct()
    found = find(rows, items, [key]).select(key).distinct()
    return rows.join(found, key, "left_anti").select(*every(docs))
