import random

import numpy as np
import pytest
from cases import documents, plain

from driftline.llm import packing


def test_best_fit_decreasing_against_a_plain_search():
    make = random.Random(1)
    for _ in range(300):
        width = make.choice([1, 5, 16, 100])
        lengths = [make.randint(0, width) for _ in range(make.randint(0, 60))]
        rows = packing.best_fit_decreasing(lengths, width)
        assert sorted(i for row in rows for i in row) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in row) <= width for row in rows)
        room = []
        for length in sorted(lengths, reverse=True):
            if fit := [r for r in room if r >= length]:
                room.remove(min(fit))
                room.append(min(fit) - length)
            else:
                room.append(width - length)
        assert len(room) == len(rows)


@pytest.mark.parametrize("width, block", [(7, 3), (64, 8_192), (2_048, 8_192)])
def test_round_trip_of_arrays(spark, monkeypatch, width, block):
    monkeypatch.setattr(packing, "BLOCK_SEQUENCES", block)
    make = random.Random(width)
    rows = [(n, [make.randrange(50_000) for _ in range(make.choice([0, 1, 5, 7, 8, 200]))]) for n in range(60)] + [(60, None), (None, [1, 2]), (3, [9])]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, ids array<int>").repartition(3), width=width, pad=50_000)
    got = packing.unpack(packed).collect()
    assert sorted((str(r.doc_id), r.ids) for r in got) == sorted((str(i), ids or []) for i, ids in rows)
    for row in packed.collect():
        ids, positions = np.frombuffer(row.ids, "<u2"), np.frombuffer(row.position_ids, "<u2")
        assert len(ids) == len(positions) == width and row.cu_seqlens[-1] == row.n_ids <= width
        assert (ids[row.n_ids:] == 50_000).all()
        assert positions[:row.n_ids].tolist() == [p for a, b in zip(row.cu_seqlens, row.cu_seqlens[1:]) for p in range(b - a)]


def test_awkward_documents_as_bytes(spark):
    docs = documents(spark)
    packed = packing.pack(docs.selectExpr("*", "CAST(text AS BINARY) AS body"), ids="body")
    got = packing.unpack(packed).collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(i), (t or "").encode()) for i, t in plain(docs))
    assert packing.pack(documents(spark, empty=True).selectExpr("doc_id", "CAST(text AS BINARY) AS ids")).collect() == []


def test_large_vocabularies(spark):
    packed = packing.pack(spark.createDataFrame([(1, [70_000, 5])], "doc_id long, ids array<int>"), width=4, vocabulary=100_000)
    assert packing.unpack(packed, vocabulary=100_000).head().ids == [70_000, 5]


def test_files(spark, tmp_path):
    packing.write(packing.pack(spark.createDataFrame([(1, [1, 2, 3])], "doc_id long, ids array<int>"), width=2), f"{tmp_path}/packed")
    assert packing.unpack(spark.read.parquet(f"{tmp_path}/packed")).head().ids == [1, 2, 3]
