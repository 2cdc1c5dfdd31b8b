import contextlib
import hashlib
import io
import random
import re
import tracemalloc

import numpy as np
import pytest
from cases import documents, plain, prose
from pyspark.sql import functions as F

from driftline.llm import repeats


def brute(rows):
    docs = set(rows)  # a row repeated in full is the same document
    counts = {}
    for _, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - 399):
            counts[data[i:i + 400]] = counts.get(data[i:i + 400], 0) + 1
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 399):
            if counts[data[i:i + 400]] > 1:
                gone[i:i + 400] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=repr)


def removed(docs, **more):
    rows = repeats.remove(docs, **more).select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).alias("gone"), F.size("spans").alias("s"),
                                               F.sha2("kept", 256).alias("h")).collect()
    return sorted(map(tuple, rows), key=repr)


def texts():
    make = random.Random(6)
    shared = [prose(n, 120) for n in range(6)]
    out = []
    for n in range(40):
        parts = [prose(50 + n, make.randint(0, 60))]
        for _ in range(make.randint(0, 2)):
            piece = make.choice(shared)
            a = make.randrange(0, 300)
            parts += [piece[a:a + make.randint(350, 700)], prose(900 + make.randrange(99), make.randint(0, 20))]
        out.append("".join(parts))
    out += ["a" * 1500, "ab" * 400 + "x" + "ab" * 260, "q" * 399, "q" * 400, None, "", out[0] + "zz" + out[0], "é" * 300]
    return list(enumerate(out))


@pytest.mark.parametrize("hot, range_bytes", [(20_000, 24_000_000), (20_000, 20_000), (2, 20_000), (0, 24_000_000)])
def test_against_brute_force(spark, monkeypatch, hot, range_bytes):
    monkeypatch.setattr(repeats, "RANGE_BYTES", range_bytes)
    rows = texts()
    assert removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=hot) == brute(rows)


def shuffled_texts(df):
    """The exchanges of a plan that move texts."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return [found for found in re.findall(r"\) Exchange\nInput[^:]*: \[(.*)\]", out.getvalue()) if "data#" in found]


def test_no_text_is_shuffled_for_hot_cores(spark, monkeypatch):
    """With hot cores, which only larger tables have, all texts with a partner went through one more shuffle."""
    plans = {}
    written = repeats.written
    monkeypatch.setattr(repeats, "written", lambda df, purpose: plans.__setitem__(purpose, df) or written(df, purpose))
    monkeypatch.setattr(repeats, "PARTS", 7)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = texts()
        assert removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=2) == brute(rows)
        assert shuffled_texts(plans["hot-parts"]) == []
        assert len(shuffled_texts(plans["repeats"])) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_cores_of_repeated_rows_and_rows_without_id(spark):
    rows = texts()
    rows += rows[:20] + [(None, text) for _, text in rows[10:30]] + [(0, text) for _, text in rows[5:15]]
    assert removed(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=2) == brute(rows)


def test_awkward_documents(spark):
    docs = documents(spark)
    assert removed(docs) == brute(plain(docs))
    assert removed(documents(spark, empty=True)) == []


def test_small_blocks_and_runs(monkeypatch):
    data = "".join(t or "" for _, t in texts()).encode()
    whole = {(x, a, b) for _, xs, first, last, _ in repeats.segments([data]) for x, a, b in zip(xs.tolist(), first.tolist(), last.tolist())}
    monkeypatch.setattr(repeats, "BLOCK", 1_000)
    parts = {(x, w) for _, xs, first, last, _ in repeats.segments([data]) for x, a, b in zip(xs.tolist(), first.tolist(), last.tolist()) for w in range(a, b + 1)}
    assert parts == {(x, w) for x, a, b in whole for w in range(a, b + 1)}
    assert len(parts) == len(data) - 399


def test_hashing_takes_bounded_memory():
    """An executor's memory is shared by the JVM and all workers: hashing 2 MB at once took 150 MB."""
    data = np.random.default_rng(1).integers(97, 123, 3_000_000, np.uint8).tobytes()
    tracemalloc.start()
    try:
        for _ in repeats.segments([data]):
            pass
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()


def test_loser_tree_merges_and_knows_prefixes():
    make = random.Random(8)
    for k in range(1, 9):
        words = [bytes(make.choice(b"ab") for _ in range(make.randint(0, 12))) for _ in range(60)]
        runs = [sorted(set(words[i::k])) for i in range(k)]
        coded = [repeats.front_coded([repeats.Suffix(w, b"", [(1, 1, 1)]) for w in run], 0) for run in runs]
        got = list(repeats.LoserTree([repeats.decoded(c) for c in coded]))
        assert [s.ahead for s, _ in got] == sorted(w for run in runs for w in run)
        for (a, _), (b, n) in zip(got, got[1:]):
            assert n == repeats.common(a.ahead, b.ahead, 0)


def test_removed_spans():
    assert repeats.removed_spans([(500, 510), (0, 3), (403, 403), (2, 2)]) == [(0, 910)]
    assert repeats.removed_spans([(500, 510), (0, 3)]) == [(0, 403), (500, 910)]
    assert repeats.removed_spans([]) == []
