"""Packing of token sequences into rows of one width, written as binary id matrices.

A sequence longer than a row is cut into pieces of a full row and one rest; nothing is lost. The pieces of a block are
placed best-fit-decreasing: longest first, each into the open row with the least room that still holds it, which a
segment tree over capacities finds. Blocks are bounded parts of the input partitions, so nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 2_048
#: sequences and ids that are packed together
BLOCK_SEQUENCES, BLOCK_IDS = 8_192, 8_000_000
#: matrix rows handed on at once
ROWS = 512

SCHEMA = ("shard int, row long, n_ids int, ids binary, position_ids binary, cu_seqlens array<int>, seqs array<long>, "
          "pieces array<int>, doc_ids array<long>")


class Capacities:
    """A segment tree over the capacities 0 .. ``most``: which of them some open row has."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._change(capacity, 1)

    def _change(self, capacity: int, by: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += by
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return ``(capacity, row)`` of the least capacity of at least ``need``; None if there is none."""
        count, node = self.count, self.leaves + need
        if not count[node]:
            # up to the first right neighbour that has anything, then down to its least
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node *= 2
                if not count[node]:
                    node += 1
        capacity = node - self.leaves
        self._change(capacity, -1)
        return capacity, self.rows[capacity].pop()


def best_fit_decreasing(lengths: list[int], width: int) -> list[list[int]]:
    """The pieces of each row. Equal lengths keep their order, so the same block is always packed alike."""
    rows: list[list[int]] = []
    room = Capacities(width)
    for piece in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        found = room.take(lengths[piece])
        if found is None:
            found = width, len(rows)
            rows.append([])
        capacity, row = found
        rows[row].append(piece)
        room.add(capacity - lengths[piece], row)
    return rows


def _pack_block(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int, kind, pad: int):
    """Per row: its ids, its pieces as (sequence, piece number, length); ``flat`` holds all ids of the block."""
    pieces = []
    for seq, (start, length) in enumerate(zip(starts.tolist(), lengths.tolist())):
        # an empty sequence is one piece of no ids
        pieces += [(seq, n, start + at, min(width, length - at)) for n, at in enumerate(range(0, length or 1, width))]
    for row in best_fit_decreasing([p[3] for p in pieces], width):
        ids, positions = np.full(width, pad, kind), np.zeros(width, np.uint16 if width <= 65_536 else np.uint32)
        ends = [0]
        for seq, _, start, length in (pieces[p] for p in row):
            ids[ends[-1]:ends[-1] + length] = flat[start:start + length]
            positions[ends[-1]:ends[-1] + length] = np.arange(length)
            ends.append(ends[-1] + length)
        yield ids, positions, ends, [pieces[p] for p in row]


def pack(docs: DataFrame, ids: str = "ids", doc_id: str = "doc_id", width: int = WIDTH, pad: int = 0,
         vocabulary: int = 65_536) -> DataFrame:
    """Packed rows of the sequences in column ``ids``: an array of ids, or binary of which each byte is an id.

    Each row has ``ids`` and ``position_ids`` (little-endian matrices rows of ``width`` numbers; ids take 2 bytes if
    ``vocabulary`` allows, else 4; positions start anew with each segment, padding has ``pad`` and 0), the cumulative
    segment lengths ``cu_seqlens``, and per segment the sequence's number, the piece's number in it and its ``doc_id``.

    Null and empty sequences are one segment of no ids. Repeated rows and null ids of documents are sequences of their
    own, told apart by their number (partition and place, the same whenever the same files are read). An empty table has no rows.
    """
    kind = np.dtype("<u2") if vocabulary <= 65_536 else np.dtype("<u4")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids"))

    def run(batches):
        shard = TaskContext.get().partitionId()
        row_number = seq_number = 0
        for batch in batches:
            column = batch.column(1)
            offsets = _offsets(column)
            flat = (np.frombuffer(column.buffers()[2], np.uint8) if pa.types.is_binary(column.type) and len(column) and column.buffers()[2]
                    else np.asarray(column.flatten()) if not pa.types.is_binary(column.type) else np.zeros(0, np.uint8))
            names = batch.column(0)
            start = 0
            while start < batch.num_rows:
                stop = int(np.searchsorted(offsets[1:, 1], offsets[start, 0] + BLOCK_IDS, side="right"))
                stop = min(max(start + 1, stop), start + BLOCK_SEQUENCES, batch.num_rows)
                here = offsets[start:stop]
                own = names.slice(start, stop - start).to_pylist()
                made = _pack_block(flat, here[:, 0], here[:, 1] - here[:, 0], width, kind, pad)
                for part in _chunks(made, ROWS):
                    first = (shard << 40) + seq_number
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([shard] * len(part), pa.int32()),
                        "row": pa.array(range(row_number, row_number + len(part)), pa.int64()),
                        "n_ids": pa.array([x[2][-1] for x in part], pa.int32()),
                        "ids": pa.array([x[0].tobytes() for x in part], pa.binary()),
                        "position_ids": pa.array([x[1].tobytes() for x in part], pa.binary()),
                        "cu_seqlens": pa.array([x[2] for x in part], pa.list_(pa.int32())),
                        "seqs": pa.array([[first + p[0] for p in x[3]] for x in part], pa.list_(pa.int64())),
                        "pieces": pa.array([[p[1] for p in x[3]] for x in part], pa.list_(pa.int32())),
                        "doc_ids": pa.array([[own[p[0]] for p in x[3]] for x in part], pa.list_(pa.int64()))})
                    row_number += len(part)
                seq_number += stop - start
                start = stop

    return rows.mapInArrow(run, SCHEMA)


def _chunks(items, size: int):
    part = []
    for item in items:
        part.append(item)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def _offsets(column: pa.Array) -> np.ndarray:
    """Start and end of each row in the flat values; a null row ends where it starts."""
    valid = np.asarray(column.is_valid())
    if pa.types.is_binary(column.type):
        # offsets of the whole buffer, from this slice's first row on
        raw = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
        return np.stack([raw[:-1], np.where(valid, raw[1:], raw[:-1])], axis=1)
    sizes = np.where(valid, np.diff(np.asarray(column.offsets, np.int64)), 0)
    ends = np.cumsum(sizes)
    return np.stack([ends - sizes, ends], axis=1)


def unpack(packed: DataFrame, vocabulary: int = 65_536) -> DataFrame:
    """``(seq, doc_id, ids)``: the sequences that were packed, whole again."""
    kind = np.dtype("<u2") if vocabulary <= 65_536 else np.dtype("<u4")

    def run(batches):
        for batch in batches:
            out = {"seq": [], "doc_id": [], "piece": [], "ids": []}
            for row in batch.to_pylist():
                ids, ends = np.frombuffer(row["ids"], kind), row["cu_seqlens"]
                for n, (seq, piece, doc) in enumerate(zip(row["seqs"], row["pieces"], row["doc_ids"])):
                    for name, value in zip(out, (seq, doc, piece, ids[ends[n]:ends[n + 1]].astype(np.int32))):
                        out[name].append(value)
            yield pa.RecordBatch.from_pydict({"seq": pa.array(out["seq"], pa.int64()), "doc_id": pa.array(out["doc_id"], pa.int64()),
                                              "piece": pa.array(out["piece"], pa.int32()), "ids": pa.array(out["ids"], pa.list_(pa.int32()))})

    pieces = packed.mapInArrow(run, "seq long, doc_id long, piece int, ids array<int>")
    parts = F.array_sort(F.collect_list(F.struct("piece", "ids")))
    return pieces.groupBy("seq", "doc_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def write(packed: DataFrame, folder: str) -> None:
    """The packed rows as Parquet, one folder per shard range that Spark's tasks write; a failed task leaves nothing."""
    packed.write.parquet(folder)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as its UTF-8 bytes, packed."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return pack(docs.select("doc_id", F.col("text").cast("binary").alias("ids")))
