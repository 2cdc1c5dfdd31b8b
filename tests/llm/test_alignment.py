import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
import sentencepiece
from cases import documents
from tokenizers import Tokenizer

from driftline.llm import alignment, merge_rounds


@pytest.fixture(scope="module")
def models():
    return merge_rounds.vocabulary(), alignment.piece_model()


@pytest.fixture(scope="module")
def libraries(models):
    one = Tokenizer.from_str(models[0])
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_proto=models[1])


def tokens(libraries, text):
    """Ids and bytes of both sides, as the libraries give them."""
    one, two = libraries
    if not text:
        return []
    letters = merge_rounds.byte_letters()
    a = one.encode(" " + text, add_special_tokens=False)
    a = [(i, bytes(letters[c] for c in t)) for i, t in zip(a.ids, a.tokens)]
    b = [(i, bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode())
         for i in two.encode(text)]
    whole = (" " + text).encode()
    return [a, b] if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else []


def brute(libraries, text):
    """ids of A and B, links and cuts, by marking every byte with the token that covers it."""
    sides = tokens(libraries, text)
    if not sides:
        return [], [], [], []
    covers = [[n for n, (_, t) in enumerate(side) for _ in t] for side in sides]
    links = sorted(set(zip(*covers)))
    ends = [{sum(len(t) for _, t in side[:n + 1]): n for n in range(len(side))} if len(side) < 400 else None for side in sides]
    if None in ends:
        ends = []
        for side in sides:
            at, found = 0, {}
            for n, (_, t) in enumerate(side):
                found[at := at + len(t)] = n
            ends.append(found)
    cuts = [(ends[0][e], ends[1][e]) for e in sorted(set(ends[0]) & set(ends[1]))]
    return [i for i, _ in sides[0]], [i for i, _ in sides[1]], links, cuts


def expected(libraries, rows):
    found = [brute(libraries, text) for _, text in rows]
    counts = Counter(p for a, b, links, _ in found for p in {(a[i], b[j]) for i, j in links})
    most = {}
    for (a, _), n in counts.items():
        most[a] = max(n, most.get(a, 0))
    out = []
    for (doc_id, _), (a, b, links, cuts) in zip(rows, found):
        pairs = [(a[i], b[j]) for i, j in links]
        parts, at = [], (0, 0)
        for i, j in cuts:
            parts.append(",".join(map(str, a[at[0]:i + 1])) + "|" + ",".join(map(str, b[at[1]:j + 1])))
            at = i + 1, j + 1
        out.append((doc_id, len(a), len(b), len(cuts), len(links), sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs),
                    hashlib.sha256(";".join(parts).encode()).hexdigest() if a else ""))
    return sorted(out, key=repr)


def digest(df, models, **more):
    return sorted(map(tuple, alignment.digest(df, *models, **more).collect()), key=repr)


def texts(make, n):
    words = ["the", "cat", "<|endoftext|>", "<s>", "日本語", "½ⅷ", "naïve", " ", "  ", "\n\n", "\t", "x1y22", "…", "🙂", "ﬁ", "\0", "é"]
    return ["".join(make.choice(words) + make.choice(["", " ", " ", "  "]) for _ in range(make.randint(1, 60))) for _ in range(n)]


def test_links_and_cuts(spark, models, libraries):
    make = random.Random(2)
    rows = texts(make, 200) + [None, "", " ", "a▁b", "  lead", "trail  ", "՘ new letter", "x" * 3000, "word " * 900]
    df = spark.createDataFrame([(t,) for t in rows], "text string")
    for row in alignment.align(df, *models).collect():
        a, b, links, cuts = brute(libraries, row.text)
        assert (row.a_ids, row.b_ids) == (a, b)
        assert [tuple(p) for p in row.links] == links
        assert [tuple(p) for p in row.cuts] == cuts


@pytest.mark.parametrize("lane", [1, 7, 10_000])
def test_any_length_of_lanes(models, monkeypatch, lane):
    monkeypatch.setattr(alignment, "LANE", lane)
    plain, pieces = alignment.Plain(models[0]), alignment.Pieces(models[1])
    rows = [" " + t for t in texts(random.Random(4), 30)]
    words = [[t[a:b] for _, (a, b) in plain.splitter.pre_tokenize_str(t)] for t in rows]
    x = alignment.Alignment(plain, pieces, pa.array(words, pa.list_(pa.string())), pa.nulls(len(rows), pa.string()))
    links = sorted(zip(x.left.tolist(), x.right.tolist()))
    monkeypatch.setattr(alignment, "LANE", 256)
    y = alignment.Alignment(plain, pieces, pa.array(words, pa.list_(pa.string())), pa.nulls(len(rows), pa.string()))
    assert links == sorted(zip(y.left.tolist(), y.right.tolist())) and (x.a_cut == y.a_cut).all() and (x.b_cut == y.b_cut).all()


@pytest.mark.parametrize("hot", [3, alignment.HOT])
def test_digest(spark, models, libraries, hot):
    rows = [(n, t) for n, t in enumerate(texts(random.Random(hot), 80))] + [(None, "the cat"), (None, "the cat"), (5, None), (6, ""), (7, "a▁b")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(df, models, hot=hot) == expected(libraries, rows)


def test_awkward_documents(spark, models, libraries):
    docs = documents(spark)
    assert digest(docs, models) == expected(libraries, [(r.doc_id, r.text) for r in docs.collect()])
    assert digest(documents(spark, empty=True), models) == []
    out = alignment.align(docs, *models)
    assert sorted(out.columns) == sorted([*docs.columns, "a_ids", "b_ids", "links", "cuts"])


def test_a_model_that_is_not_segmented(models, monkeypatch):
    plain, pieces = alignment.Plain(models[0]), alignment.Pieces(models[1])
    assert pieces.segmented
    rows = [" " + t for t in texts(random.Random(8), 20)] + [""]
    words = pa.array([[t[a:b] for _, (a, b) in plain.splitter.pre_tokenize_str(t)] for t in rows], pa.list_(pa.string()))
    one = alignment.Alignment(plain, pieces, words, pa.nulls(len(rows), pa.string()))
    pieces.segmented = False
    two = alignment.Alignment(plain, pieces, words, pa.nulls(len(rows), pa.string()))
    assert one.b.tolist() == two.b.tolist() and one.b_rows.tolist() == two.b_rows.tolist()


def test_whole_table(spark, models, libraries):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert sorted(map(tuple, alignment.query(spark, folder).collect()), key=repr) == expected(libraries, rows)
