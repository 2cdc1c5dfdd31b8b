import hashlib
import json
import random

import numpy as np
import pytest
from cases import documents
from tokenizers import Tokenizer

from driftline.llm import merge_rounds


@pytest.fixture(scope="module")
def source():
    return merge_rounds.vocabulary()


@pytest.fixture(scope="module")
def library(source):
    return Tokenizer.from_str(source)


def expected(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_awkward_documents(spark, source, library):
    docs = documents(spark)
    rows = merge_rounds.decode(merge_rounds.encode(docs, source), source).collect()
    assert sorted(rows[0].asDict()) == sorted(docs.columns)  # ids and decoded were there and are replaced
    assert len(rows) == docs.count()
    for row in rows:
        assert (row.ids, row.decoded) == expected(library, row.text or "")


def test_added_tokens_and_new_letters(spark, source, library):
    end = "<|endoftext|>"
    texts = [end, f"a {end} b", f"!!{end}{end}  ", f"<|endoftext{end}|>", "x  \n " + end + " y", "՘֋ aᲉb \U0003fc3f", "ſ½ ⅷ͸  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in merge_rounds.decode(merge_rounds.encode(df, source), source).collect():
        assert (row.ids, row.decoded) == expected(library, row.text)
    plain = Tokenizer.from_str(source)
    plain.encode_special_tokens = True
    for row in merge_rounds.encode(df, source, special=False).collect():
        assert row.ids == plain.encode(row.text, add_special_tokens=False).ids


def test_every_character(spark, source, library):
    """Letters, digits and white space are told as the library tells them, whatever the JVM's Unicode version."""
    points = [c for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = [" ".join(f"x{chr(c)}1{chr(c)}!{chr(c)}  {chr(c)}" for c in points[i:i + 64]) for i in range(0, len(points), 64)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    for row in merge_rounds.encode(df, source).collect():
        assert row.ids == library.encode(row.text, add_special_tokens=False).ids


def test_random_words(source, library):
    make = random.Random(5)
    words = ["".join(make.choice("abcdeths \n'éÄ9") for _ in range(make.randint(0, 80))) for _ in range(600)]
    words += ["a" * 5000, "the" * 300, "ab" * 2000 + "a", " " * 4000]
    model = merge_rounds.Model(source)
    assert model.rising
    for rising in (True, False):
        model.rising = rising
        flat, counts = model.merge([w.encode() for w in words])
        rows = np.split(flat, np.cumsum(counts)[:-1])
        bare = Tokenizer.from_str(source)
        bare.pre_tokenizer = type(bare.pre_tokenizer)(add_prefix_space=False, use_regex=False)
        assert [r.tolist() for r in rows] == [bare.encode(w, add_special_tokens=False).ids for w in words]


def test_merges_that_bring_up_earlier_pairs(source):
    """'ab' is made by a late merge, but 'ab'+'c' merges before it: then places merge one at a time."""
    letters = list(merge_rounds.byte_letters())
    told = json.loads(source)
    merges = [("ab", "c"), ("c", "b"), ("a", "b"), ("b", "b"), ("abc", "a")]
    made = [*letters, *dict.fromkeys(a + b for a, b in merges)]
    told["model"] |= {"vocab": {t: n for n, t in enumerate(made)}, "merges": [list(m) for m in merges]}
    told["added_tokens"] = []
    own = json.dumps(told)
    model, library = merge_rounds.Model(own), Tokenizer.from_str(own)
    assert not model.rising
    make = random.Random(3)
    words = ["".join(make.choice("abc") for _ in range(make.randint(1, 30))) for _ in range(400)]
    flat, counts = model.merge([w.encode() for w in words])
    assert [r.tolist() for r in np.split(flat, np.cumsum(counts)[:-1])] == [library.encode(w).ids for w in words]


def test_decoding_any_ids(spark, source, library):
    make = random.Random(9)
    rows = [([make.randrange(50_257) for _ in range(make.randint(0, 20))],) for _ in range(100)] + [(None,), ([50_256, 999_999, -1],)]
    for row in merge_rounds.decode(spark.createDataFrame(rows, "ids array<int>"), source).collect():
        known = None if row.ids is None else [i for i in row.ids if 0 <= i < 50_257]
        assert row.decoded == (None if known is None else library.decode(known, skip_special_tokens=False))


def test_digest_and_empty_table(spark, source, library):
    text = "Hello  world's <|endoftext|> é"
    row = merge_rounds.digest(spark.createDataFrame([(1, text)], "doc_id long, text string"), source).head()
    ids, decoded = expected(library, text)
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert merge_rounds.digest(documents(spark, empty=True), source).collect() == []


def test_the_memo_may_be_forgotten_at_any_time(source, library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(merge_rounds, "MEMO_WORDS", 3)
    encoder = merge_rounds.Encoder(source, True)
    for text in ("one two three four", "five one six", "two two two"):
        words = [text[a:b] for _, (a, b) in encoder.splitter.pre_tokenize_str(text)]
        assert encoder.ids(pa.array(words), np.array([0, len(words)]))[0].tolist() == library.encode(text).ids


def test_other_kinds_of_vocabulary_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        merge_rounds.Model(merge_rounds.vocabulary("word_bpe_49k.json"))


def test_whole_table(spark, source, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r for r in merge_rounds.query(spark, "/root/testdata/sf0.001").collect()}
    for row in docs.collect():
        ids, decoded = expected(library, row.text or "")
        assert (found[row.doc_id].n_tokens, found[row.doc_id].ids_sha256, found[row.doc_id].decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
