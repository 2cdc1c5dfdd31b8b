import math
import random

import pytest

from driftline.llm import vector_search


def brute(rows, queries, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in good:
        if queries(q):
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def search(spark, rows, every, k=5, **more):
    vectors = vector_search.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3))
    return sorted(map(tuple, vector_search.search(vectors, vectors.where(f"vec_id % {every} = 0"), k, **more).collect()))


def floats(values):
    import numpy as np

    return [float(np.float32(v)) for v in values]


@pytest.mark.parametrize("cells, block, queries", [(64, 1_024, 4_096), (4, 16, 5), (300, 16, 4_096)])
def test_against_brute_force(spark, monkeypatch, cells, block, queries):
    monkeypatch.setattr(vector_search, "BLOCK", block)
    monkeypatch.setattr(vector_search, "QUERY_BLOCK", queries)
    monkeypatch.setattr(vector_search, "READ", 3)
    make = random.Random(cells)
    rows = [(n, floats(make.gauss(0, 1) for _ in range(8))) for n in range(150)]
    rows += [(n, rows[0][1]) for n in range(200, 260)]  # one vector very often: ties go to the smaller id
    rows += [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (None, rows[1][1]), (310, [1.0, 2.0]), (320, []), (330, [])]
    assert search(spark, rows, 10, cells=cells) == brute(rows, lambda q: q % 10 == 0, 5)


def test_fewer_than_k(spark):
    rows = [(0, [1.0]), (1, [2.0]), (2, [-3.0])]
    assert search(spark, rows, 1) == brute(rows, lambda q: True, 5)
    assert search(spark, [], 1) == []
    assert search(spark, [(0, [1.0])], 1) == []


def test_large_components(spark):
    make = random.Random(3)
    rows = [(n, floats(make.choice([1e6, -1e6, 3.0, 2e5]) * make.random() for _ in range(4))) for n in range(60)]
    assert search(spark, rows, 7) == brute(rows, lambda q: q % 7 == 0, 5)


def test_repeated_rows(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])]
    assert search(spark, rows, 2, k=3) == [(0, 1, 1, 131072), (0, 2, 1, 131072), (0, 3, 2, 65536), (2, 1, 1, 131072), (2, 2, 1, 131072), (2, 3, 0, 65536)]
