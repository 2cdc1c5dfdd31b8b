import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
from cases import documents
from pyspark.sql import functions as F

from driftline.llm import language_id

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    found = language_id.query(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id")
    for row in found.select("doc_id", "held_out").collect():
        assert row.held_out == (zlib.crc32(str(row.doc_id).encode()) % 3 == 1)
    assert found.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).head()[0] > 0.97
    assert found.where("score < 0 OR score > 1").count() == 0


def test_awkward_documents(spark):
    docs = documents(spark)
    prototypes = language_id.train(docs)
    assert [name for name, _ in prototypes] == ["en", "es", "fr", "ja"]  # no German document has a letter
    rows = language_id.predict(docs, prototypes).collect()
    assert len(rows) == docs.count()
    for row in rows:
        letters = any(c.isalpha() for c in row.text or "")
        assert (row.lang_pred == "und") == (not letters) and 0 <= row.score <= 1
        assert row.lang_pred != "und" or row.score == 0


def test_nothing_to_learn_from(spark):
    empty = documents(spark, empty=True)
    assert language_id.train(empty) == []
    assert language_id.predict(empty, []).collect() == []
    assert {r.lang_pred for r in language_id.predict(documents(spark), []).collect()} == {"und"}


def test_bundles_against_the_definition():
    profiles = language_id.Profiles(dimensions=64)
    texts = ["Äbc d", "", None, "x1y", "日本 語"]
    made, seen = profiles.bundles(texts)
    for text, vector, any_gram in zip(texts, made, seen):
        words = "".join(c.lower() if c.isalpha() else " " for c in text or "").split()
        want = np.zeros(64)
        for word in words:
            padded = f" {word} "
            for i in range(len(padded) - 2):
                a, b, c = (profiles.letter(ord(x)).astype(float) for x in padded[i:i + 3])
                want += np.roll(a, 2) * np.roll(b, 1) * c
        assert (vector == want).all() and any_gram == bool(words)


def test_pieces_and_blocks_do_not_matter(monkeypatch):
    text = "die und der " * 200
    whole, _ = language_id.Profiles(dimensions=32).bundles([text, "x y"])
    monkeypatch.setattr(language_id, "BLOCK_CHARS", 100)
    parts, _ = language_id.Profiles(dimensions=32).bundles([text, "x y"])
    assert (whole == parts).all()


def test_stage_keeps_clean_documents_and_all_columns(spark):
    docs = documents(spark)
    kept = language_id.stage(spark, docs, FOLDER)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert all(any(c.isalpha() for c in t) for t in texts)
    clean = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert language_id.stage(spark, clean, FOLDER).count() >= 0.995 * clean.count()
    assert language_id.stage(spark, documents(spark, empty=True), FOLDER).count() == 0


def test_foreign_scripts_go_and_short_clean_texts_stay(spark):
    make = random.Random(3)
    clean = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang").where("length(text) > 100")
    words = sorted({w for r in clean.limit(200).collect() for w in r.text.split() if len(w) > 3 and w.isalpha()})
    short = [(10 ** 9 + 3 * n, " ".join(make.sample(words, n % 3 + 1)), None) for n in range(60)]
    scripts = ["абвгдежзиклмнопрст", "αβγδεζηθικλμνξοπ", "的一是不了人我在有他这", "אבגדהוזחטיכלמנ", "कखगघचछजझ"]
    foreign = [(2 * 10 ** 9 + n, " ".join("".join(make.choice(scripts[n % 5]) for _ in range(make.randint(2, 9))) for _ in range(make.randint(1, 80))), None)
               for n in range(100)]
    mixed = [(3 * 10 ** 9, "клмн the of " * 20 + " ".join(words[:60]), None)]
    schema = "doc_id long, text string, lang string"
    docs = clean.unionByName(spark.createDataFrame(short + foreign + mixed, schema))
    kept = {r.doc_id for r in language_id.stage(spark, docs, FOLDER).collect()}
    assert {i for i, _, _ in short + mixed} <= kept and not kept & {i for i, _, _ in foreign}
    assert {r.doc_id for r in clean.collect()} <= kept


def test_letters_in_use(spark):
    rows = [("aBc" * 5000 + "я", "x"), ("ж" * 10 + "1 !", "y"), (None, "z"), ("q", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert [chr(c) for c in language_id.used_letters(docs)] == ["a", "b", "c", "ж"]
    share = docs.select(language_id.known_share(F.col("text"), [ord("a"), ord("ж")]).alias("s")).collect()
    assert [round(r.s, 3) for r in share[:2]] == [0.333, 1.0] and all(r.s is None or r.s != r.s or r.s == 0 for r in share[2:])


def test_a_batch_takes_bounded_memory():
    """An executor's memory is shared by the JVM and all workers: the vectors of 10,000 texts alone took 40 MB."""
    make = random.Random(5)
    words = ["".join(make.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(2_000)]
    texts = pa.array([" ".join(make.choices(words, k=150)) for _ in range(10_000)])
    profile, matrix = language_id.Profiles(), np.ones((2, language_id.DIMENSIONS))
    language_id._compared(texts[:10], profile, ["a", "b"], matrix, np.array([97]))
    tracemalloc.start()
    try:
        found = language_id._compared(texts, profile, ["a", "b"], matrix, np.array([97]))
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
    assert len(found) == len(texts)


def test_a_task_of_the_stage_has_one_worker(spark):
    """Each function over a column that stands alone takes a worker process of its own beside the task."""
    docs = spark.createDataFrame([(3, "the cat and the dog", "en"), (6, "der hund und", "de")], "doc_id long, text string, lang string")
    plan = language_id.stage(spark, docs, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
