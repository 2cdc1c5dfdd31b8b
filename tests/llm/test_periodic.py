import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import documents

from driftline.llm import periodic


def runs_of(words):
    """All runs, for each period by looking at all places: (start, period, length)."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(words[i:i + q] == words[i:i + d] * (q // d) for d in range(1, q) if q % d == 0):
                found.append((i, q, length))
            i = max(j, i + 1)
    return sorted(found)


def expected(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    runs = runs_of(words)
    gone = {i for s, q, length in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[2] / r[1], r[0], r[1])) if runs else None
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), best and best[0], best and best[2], best and best[1], best and 1000 * best[2] // best[1],
            sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def changed(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 or not n:
        return text
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[i] if i < a else words[a + (i - a) % p] for i in range(n))


def random_text(make):
    words = []
    while len(words) < make.randint(0, 300):
        kind = make.random()
        if kind < 0.4:
            words += [make.choice("abcdefgh") for _ in range(make.randint(1, 20))]
        else:
            unit = [make.choice("ab" if kind < 0.7 else "abcdefgh") for _ in range(make.randint(1, 30))]
            words += (unit * 12)[:make.randint(1, 9 * len(unit))]
    return make.choice([" ", "\n", " \t "]).join(words)


def test_fragments_cover_all_runs_whatever_the_tiles():
    make = random.Random(7)
    for core in (16, 32, 64, 1 << 15):
        for _ in range(120):
            text = random_text(make)
            words = text.split()
            codes = periodic.cut_words(pa.array([text]))[0]
            places = {}
            for low, high, first, begin, until, end in periodic.tiles_of(len(words), core) if len(words) >= 6 else []:
                part = np.array([[low, high, 0, begin - first, until - first, end - first]])
                for _, q, s, e in periodic.solve(codes[first:end], part):
                    places.setdefault(q, set()).update(range(s + first, e + first))
            runs = []
            for q, held in places.items():
                for i in sorted(held):
                    if i - 1 not in held:
                        j = i
                        while j in held:
                            j += 1
                        runs.append((i, q, j - i + q))
            assert sorted(runs) == runs_of(words)


def test_words():
    texts = ["a  b\tc", None, "", " x", "x ", "é é y", "\x0b\x0c\r\n", "a"]
    codes, counts = periodic.cut_words(pa.array(texts).slice(1))
    assert counts.tolist() == [0, 0, 1, 1, 3, 0, 1]
    assert codes.tolist() == [0, 0, 1, 1, 2, 3]


@pytest.mark.parametrize("core", [64, periodic.CORE])
def test_random_documents(spark, core):
    make = random.Random(core)
    rows = [(n, random_text(make)) for n in range(150)] + [(1, "x y"), (None, "a " * 40), (None, "a " * 40), (3, "b " * 9), (500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((tuple(r) for r in periodic.digest(docs, core).collect()), key=repr)
    assert found == sorted((expected(*row) for row in rows), key=repr)


def test_awkward_documents(spark):
    docs = documents(spark)
    runs = periodic.find(docs)
    out = periodic.collapse(periodic.with_runs(docs, runs))
    assert sorted(out.columns) == sorted([*docs.columns, "runs", "collapsed"])
    rows = out.collect()
    assert len(rows) == docs.count()
    for row in rows:
        if len(row.text or "") < 10_000:
            assert hashlib.sha256(row.collapsed.encode()).hexdigest() == expected(0, row.text)[-1]
    assert periodic.digest(documents(spark, empty=True)).collect() == []


def test_long_documents_in_many_tiles(spark):
    make = random.Random(4)
    unit = [str(make.random()) for _ in range(9_000)]
    texts = [" ".join((unit * 5)[:44_000]), "z " * 100_000, " ".join([*unit, *unit[:3] * 20_000, *unit])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(tuple(r[c] for c in ("doc_id", "start", "length", "period")) for r in periodic.find(docs).collect())
    assert found == [(0, 0, 44_000, 9_000), (1, 0, 100_000, 1), (2, 9_000, 60_003, 3)]


def test_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = [(r.doc_id, changed(r.doc_id, r.text)) for r in docs if len(r.text or "") < 12_000]
    found = {r.doc_id: tuple(r) for r in periodic.query(spark, folder).collect()}
    assert len(found) == len(docs)
    assert {found[i] for i, _ in short} == {expected(i, t) for i, t in short}
    assert sum(r[1] for r in found.values()) > 10
