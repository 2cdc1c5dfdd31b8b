import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from cases import documents

from driftline.llm import bpe


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.tokenizer()


@pytest.fixture(scope="module")
def reference(tokenizer):
    ranks, pattern = tokenizer
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_awkward_documents(spark, tokenizer, reference):
    docs = documents(spark)
    coded = bpe.decode(bpe.encode(docs, *tokenizer), tokenizer[0]).collect()
    assert sorted(map(str, coded[0].asDict())) == sorted(docs.columns)  # ids and decoded were there and are replaced
    assert len(coded) == docs.count()
    for row in coded:
        text = row.text or ""
        assert row.ids == reference.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()


def test_empty_table(spark, tokenizer):
    assert bpe.digest(documents(spark, empty=True), *tokenizer).collect() == []


def test_digest(spark, tokenizer, reference):
    row = bpe.digest(spark.createDataFrame([(1, "Hello  world's")], "doc_id long, text string"), *tokenizer).head()
    ids = reference.encode_ordinary("Hello  world's")
    assert row.n_tokens == len(ids)
    assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert row.decoded_sha256 == hashlib.sha256(b"Hello  world's").hexdigest()


def test_random_words_in_both_ways_of_merging(tokenizer, reference, monkeypatch):
    make = random.Random(5)
    words = ["".join(make.choice("abcdeths \n'éÄ9") for _ in range(make.randint(1, 80))) for _ in range(500)]
    words += ["a" * 1000, "the" * 300]
    expected = [reference.encode_ordinary(w) for w in words]
    for stepped in (0, 64, 10_000):
        monkeypatch.setattr(bpe, "STEPPED", stepped)
        assert bpe.Encoder(*tokenizer).texts(words).to_pylist() == expected


def test_a_batch_of_new_words_takes_bounded_memory(tokenizer):
    """An executor's memory is shared by the JVM and all workers."""
    make = np.random.default_rng(1).integers(97, 123, (240_000, 10), np.uint8)
    words = [w.tobytes().decode() for w in make]
    batch = pa.RecordBatch.from_arrays([pa.array([words[i:i + 100] for i in range(0, len(words), 100)], pa.list_(pa.string()))], ["words"])
    encoder = bpe.Encoder(*tokenizer)
    tracemalloc.start()
    try:
        for part in bpe._parts(batch, batch.column(0)):
            rows = part.column(0)
            encoder.encode(rows.flatten(), bpe._offsets(rows))
        assert tracemalloc.get_traced_memory()[1] < 100e6
    finally:
        tracemalloc.stop()


def test_the_memo_may_be_forgotten_at_any_time(tokenizer, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_WORDS", 3)
    encoder = bpe.Encoder(*tokenizer)
    for text in ("one two three four", "five one six", "", "two two two"):
        assert encoder.texts([text]).to_pylist() == [reference.encode_ordinary(text)]


def test_merges_that_bring_up_lower_ranks():
    # 'bc' joins late, yet 'abc' has a lower rank than another 'bc' to the right
    ranks = {bytes([b]): 300 + b for b in range(256)} | {b"bc": 20, b"abc": 1, b"abcd": 0, b"cb": 21}
    own = tiktoken.Encoding("tiny", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    make = random.Random(3)
    words = ["".join(make.choice("abcd") for _ in range(make.randint(1, 30))) for _ in range(300)]
    for stepped in (0, 64):
        bpe.STEPPED, before = stepped, bpe.STEPPED
        try:
            assert bpe.Encoder(ranks, r"\S+|\s+").texts(words).to_pylist() == [own.encode_ordinary(w) for w in words]
        finally:
            bpe.STEPPED = before


def test_unknown_id(spark, tokenizer):
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([([70_000],)], "ids array<int>"), tokenizer[0]).collect()
