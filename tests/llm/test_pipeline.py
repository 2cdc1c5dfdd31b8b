import random
import re

import corpus_pipeline
from cases import documents, prose

from driftline.llm import bpe, decontaminate, jaccard, language_id

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_stages(spark, tmp_path):
    """Each stage against what its operator says of the rows it was given."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{name}")
        seen[name] = docs, spark.read.parquet(f"{tmp_path}/{name}")
        docs = seen[name][1]
        if name != "bpe":
            assert docs.columns == columns
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}
    before, after = seen["language_id"]
    assert ids(before) - ids(after) == {r.doc_id for r in before.collect() if not any(c.isalpha() for c in r.text or "")}
    before, after = seen["near_duplicates"]
    assert ids(after) == {r.component_id for r in jaccard.join(before).collect()}
    before, after = seen["decontamination"]
    leaked = ids(decontaminate.find(before, spark.read.parquet(f"{FOLDER}/benchmark.parquet"), ["doc_id"]))
    assert ids(after) == ids(before) - leaked and leaked
    before, after = seen["secrets"]
    assert ids(after) == ids(before)
    before, after = seen["bpe"]
    assert {tuple(r) for r in after.collect()} == {tuple(r) for r in bpe.digest(before, *bpe.tokenizer()).collect()}
    assert {tuple(r) for r in corpus_pipeline.run(spark, FOLDER).collect()} == {tuple(r) for r in after.collect()}


def test_awkward_documents(spark, tmp_path):
    for empty in (False, True):
        docs = documents(spark, empty)
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, docs, FOLDER).write.parquet(f"{tmp_path}/{empty}-{name}")
            docs = spark.read.parquet(f"{tmp_path}/{empty}-{name}")
        assert (docs.count() == 0) == empty


def jaccard_groups(rows):
    """Rows (id, text) in groups of links, by brute force."""
    def shingles_of(text):
        words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
        return {tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}

    sets = [shingles_of(text) for _, text in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            same = rows[i] == rows[j]
            if same or sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def test_near_duplicates_by_brute_force(spark):
    """Null ids, one id for several texts, copies under other ids, rows that are there twice."""
    make = random.Random(6)
    base = [prose(n, make.randint(3, 60)) for n in range(40)]
    near = [" ".join(w if k else "changed" for k, w in enumerate(t.split())) for t in base[:20]]
    ids = [None, None, 1, 2, 3, 4, 5]
    rows = [(make.choice(ids), t) for t in base + near + base[:10]] + [(7, ""), (7, None), (None, None), (7, "")]
    rows += rows[:3]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r.doc_id, r.text) for r in jaccard.stage(spark, docs, FOLDER).collect()]
    groups = {}
    for row, group in zip(rows, jaccard_groups(rows)):
        groups.setdefault(group, []).append(row)
    assert len(kept) == len(groups)
    for held in groups.values():
        (one,) = {row for row in held if row in kept}  # exactly one text of each group
        assert one[0] == min((r[0] for r in held if r[0] is not None), default=None)


def test_decontamination_by_row(spark, tmp_path):
    items = [prose(100 + n, 30) for n in range(4)]
    spark.createDataFrame([(1, items[0]), (None, items[1]), (2, items[2]), (2, items[3]), (3, None)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    leaked = [(i, f"{prose(n, 20)} {item} {prose(50 + n, 20)}") for n, (i, item) in enumerate(zip([None, 7, 8, 9], items))]
    clean = [(i, prose(200 + n, 80)) for n, i in enumerate([None, 7, 8, 9, 10])] + [(11, None), (12, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in leaked + clean + leaked[:1]],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    kept = decontaminate.stage(spark, docs, str(tmp_path)).collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in kept))) == sorted(map(repr, clean))


def test_five_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "bpe"]
    assert language_id.stage is corpus_pipeline.STAGES[0][1]
