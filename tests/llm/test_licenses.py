import re
import textwrap

from cases import documents

from driftline.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(text):
    low = (text or "").translate(LOWER)
    words = WORD.findall(low)
    places = [(i, label) for phrase, label in licenses.PHRASES.items() for i in range(len(words))
              if words[i:i + len(phrase.split())] == phrase.split()]
    labels, best = {label for _, label in places}, 0.0
    for label, body in licenses.TEMPLATES:
        want, long = set(licenses.template_words(body)), len(WORD.findall(body.lower()))
        if len(want & set(words)) < licenses.THRESHOLD * len(want) - 1e-9:
            continue
        most = max((len(want & set(words[i:i + long])) for i in range(len(words))), default=0)
        if most >= licenses.THRESHOLD * len(want) - 1e-9:
            labels.add(label)
            best = max(best, most / len(want))
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})), ",".join(sorted(labels)), best)


def check(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in licenses.scan(docs).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_against_brute_force(spark):
    check(spark, [
        "MIT License mit-license, MIT LICENSE", "the general  public\tlicense and Apache License", "public license", "license", "mit", "mitlicense",
        "mit licenses", "xmit license", "licensed under the APACHE license, version 2.0\nreleased under the mit license", "", None, " .,; ",
        "version 2.0 of the apache thing is licensed and under license", "All rights reserved.", "all   RIGHTS\nreserved", "é mit license é",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documents",
        "mit mit license license apache license apache", "WKX under the Mit LIcense released K"])


def test_wrapped_and_scattered_words(spark):
    """Notices wrapped to lines as they usually are, behind comment marks, far inside a text; the same words far apart."""
    wrap = lambda body, width, mark: f"\n{mark}".join(textwrap.wrap(body, width))
    bodies = [body for _, body in licenses.TEMPLATES]
    filler = [f"word{n}" for n in range(3000)]
    texts = [wrap(body, 40, " * ") for body in bodies]
    texts += [" ".join(filler[:n]) + "\n" + wrap(body, 25, "# ") + "\n" + " ".join(filler[n:]) for n, body in zip(range(30, 3000, 200), bodies)]
    texts += [" ".join(w + " " + " ".join(filler[40 * i:40 * i + 40]) for i, w in enumerate(body.split())) for body in bodies]
    texts += [" ".join(body.split()[:-3]) for body in bodies] + [" ".join(bodies), " ".join(reversed(" ".join(bodies).split()))]
    check(spark, texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {r.doc_id: r.score for r in licenses.scan(docs).collect()}
    assert all(score[i] == 1 for i in range(2 * len(bodies)))
    assert all(score[i] == 0 for i in range(2 * len(bodies), 3 * len(bodies)))


def test_awkward_documents(spark):
    docs = documents(spark)
    rows = licenses.scan(docs).collect()
    texts = [r.text for r in docs.collect()]
    assert sorted((r.n_words, r.n_base, r.labels) for r in rows) == sorted((b[0], b[1], b[5]) for b in map(brute, texts))
    assert licenses.scan(documents(spark, empty=True)).collect() == []


def test_plan_has_no_python(spark, capsys):
    licenses.scan(documents(spark)).explain()
    assert "Python" not in capsys.readouterr().out.replace("PythonRDD", "")
