"""Shingles, benchmark decontamination, the Jaccard join and components, against brute force."""

import random
import re
from collections import Counter

import pytest
from cases import documents, plain, prose
from pyspark.sql import functions as F

from driftline.llm import bitmaps, decontaminate, graph, jaccard, shingles

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute(text):
    words = WORD.findall((text or "").encode().translate(LOWER))
    return [tuple(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [tuple(words)] if words else []


def edited(text, seed, changes):
    make, words = random.Random(seed), text.split()
    for _ in range(changes):
        words[make.randrange(len(words))] = "z" + str(make.randrange(10 ** 6))
    return " ".join(words)


def test_shingles(spark):
    texts = [t for _, t in plain(documents(spark))] + ["a b", "a b c d e", "A B c d e f", "e d c b a", "\x0b\x0c x\x1cy \x85z"]
    marks, made = shingles.of_words(*shingles.words(texts))
    names, at = {}, 0
    for text, n in zip(texts, made):
        own = brute(text)
        assert len(own) == n
        for shingle, mark in zip(own, marks[at:at + n].tolist()):
            assert names.setdefault(shingle, mark) == mark
        at += n
    assert len(set(names.values())) == len(names)
    assert [len(s) for s in shingles.sets(texts)] == [len(set(brute(t))) for t in texts]


def components_of(texts):
    sets = {i: frozenset(brute(t)) for i, t in texts}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in sets.items():
        for j, y in sets.items():
            if j < i and x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_copies():
    make = random.Random(9)
    texts, line = [], prose(77, 30)
    for n in range(12):
        original = prose(100 + n, make.choice([6, 9, 20, 60, 200]))
        texts.append(original)
        for k in range(make.randint(0, 6)):
            texts.append(edited(original, 1000 * n + k, make.randint(0, 1 + len(original.split()) // 40)))
        texts.append(line + " " + prose(200 + n, 25))  # many share a passage, none is similar
    chain = prose(50, 200).split()
    for n in range(10):  # each is similar to the next, the ends are not
        texts.append(" ".join(chain[4 * n:4 * n + 120]))
    texts += ["one two three", "One  two three", "one two", "", None, prose(5, 3)]
    make.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("first", [0.05, 0.3, 1.0])
def test_jaccard_join_against_brute_force(spark, monkeypatch, first):
    monkeypatch.setattr(jaccard, "FIRST", first)
    texts = near_copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == components_of(texts)


def test_jaccard_join_of_awkward_documents(spark):
    docs = documents(spark)
    rows = jaccard.join(docs).collect()
    assert len(rows) == docs.count()
    named = {r.doc_id: r.component_id for r in rows if r.doc_id is not None}
    assert named == {i: {2: 1, 3: 1, 8: 7}.get(i, i) for i in named}
    assert {r.component_id for r in rows if r.doc_id is None} == {None}
    assert jaccard.join(documents(spark, empty=True)).collect() == []


def test_near_duplicate_stage(spark):
    docs = documents(spark)
    kept = jaccard.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 5, 6, 7, 9, 10, 11, 12, 13, 14, 15]
    # two of the three rows without an id are copies of one another: one of them stays, as of any group
    assert sorted(r.text is None for r in kept.collect() if r.doc_id is None) == [False, True]
    assert jaccard.stage(spark, documents(spark, empty=True), "").count() == 0


def test_bitmap_lets_every_partner_through(spark):
    rows = spark.range(2000).selectExpr("IF(id = 7, NULL, id) AS k", "id AS place")
    keys = rows.where("k % 10 = 3 OR k IS NULL")
    found = bitmaps.marked(rows, bitmaps.bitmap(keys, F.col("k")), "some", F.col("k"))
    assert found.columns == ["k", "place", "some"] and found.count() == 2000
    assert found.where("some AND (k % 10 = 3 OR k IS NULL)").count() == 201
    assert found.where("some").count() < 210
    assert bitmaps.marked(rows, bitmaps.bitmap(keys.limit(0), F.col("k")), "some", F.col("k")).where("some").count() == 0


def test_components(spark):
    make = random.Random(4)
    links = [(make.randrange(300), make.randrange(300)) for _ in range(180)] + [(5, 5), (None, 3), (7, None)] + [(1000 + i, 1001 + i) for i in range(70)]
    links += [(2000, 2000 + i) for i in range(100)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        if a is not None and b is not None:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in list(up)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def leaks(docs, items):
    found = {}
    for i, text in docs:
        own = brute(text)
        for item, body in items:
            want = brute(body)
            size = len(want)
            best = max((sum((a & b).values()) / sum((a | b).values()) for b in [Counter(want)] for s in range(max(1, len(own) - size + 1))
                        for a in [Counter(own[s:s + size])] if own and want), default=0)
            if best >= 0.8:
                found[i, item] = best
    return found


def test_decontamination_against_brute_force(spark):
    make = random.Random(2)
    items = [(n, prose(300 + n, make.randint(14, 60))) for n in range(15)] + [(90, "two words"), (91, ""), (92, None), (None, prose(1, 20))]
    docs = []
    for n in range(60):
        body = prose(500 + n, make.randint(0, 150)).split()
        if n % 2:
            piece = edited(items[n % 15][1], n, n % 3)
            body[len(body) // 2:len(body) // 2] = piece.upper().replace("Ä", "ä").replace("É", "é").split()
        docs.append((n, " ".join(body)))
    docs += [(100, "Two  WORDS"), (101, None), (102, ""), (103, items[0][1]), (103, items[0][1])]
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    known = [(i, t) for i, t in items if i is not None and t]
    want = leaks(dict(docs).items(), known)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len(want) + 1  # the repeated row is searched on its own
    assert len(want) > 15


def test_decontamination_finds_parts_in_any_order(spark):
    make = random.Random(6)
    items = [(n, prose(800 + n, make.randint(20, 60))) for n in range(8)]
    docs = []
    for n in range(48):
        words, around = items[n % 8][1].split(), prose(900 + n, 60).split()
        half, kind = len(words) // 2, n // 8
        # halves swapped, thirds turned round, words put in between, the item said twice, halves apart, all of it at the end
        piece = [words[half:] + words[:half], words[2 * half // 3:] + words[:2 * half // 3], words[:half] + ["zz"] + words[half:],
                 words + words, words[:half] + around[:20] + words[half:], words[half:] + words[:half]][kind]
        docs.append((n, " ".join((around[:30] if kind < 5 else around) + piece + (around[30:] if kind < 5 else []))))
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    want = leaks(docs, items)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(got) == len(want) and {n // 8 for n, _ in want} >= {0, 1, 2, 3, 5}


def test_decontamination_finds_short_items_inside_documents(spark):
    items = [(1, "two words"), (2, "Four short words here"), (3, "alone"), (4, "two words"), (5, prose(11, 20))]
    docs = [(1, prose(12, 30) + " two WORDS " + prose(13, 30) + " two words"), (2, "so four short words here"), (3, "words two four short"),
            (4, "alone"), (5, "Four short"), (6, prose(11, 20) + " alone"), (7, "")]
    got = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity) for r in got) == [
        (1, 1, 30, 2, 1.0), (1, 4, 30, 2, 1.0), (2, 2, 1, 4, 1.0), (4, 3, 0, 1, 1.0), (6, 3, 20, 1, 1.0), (6, 5, 0, 20, 1.0)]


def test_decontamination_of_awkward_documents(spark):
    items = spark.createDataFrame([(1, prose(2, 40))], "item_id long, text string")
    docs = documents(spark)
    rows = decontaminate.find(docs, items, ["doc_id"]).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 2, 3]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find(docs, none, ["doc_id"]).collect() == []
    assert decontaminate.find(documents(spark, empty=True), items, ["doc_id"]).collect() == []


def test_decontamination_stage(spark, tmp_path):
    spark.createDataFrame([(1, prose(2, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = documents(spark)
    kept = decontaminate.stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert kept.count() == docs.count() - 4 and not {1, 2, 3} & {r.doc_id for r in kept.collect()}


def test_many_items_are_taken_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BLOCK", 4)
    items = [(n, prose(300 + n, 20)) for n in range(15)]
    docs = spark.createDataFrame([(n, t) for n, t in items], "doc_id long, text string")
    got = decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"]).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(n, n) for n in range(15)]
