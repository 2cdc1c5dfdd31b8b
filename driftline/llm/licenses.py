r"""License scans by an exact set-similarity join between text blocks and license templates.

The words of a template are its set. A text holds the template when somewhere, in as many words in a row as the template
has, at least ``threshold`` of the template's set stand, whatever lines they are wrapped to. Texts are cut into blocks of
twice the longest template's words, each beginning in the middle of the one before, so any such stretch lies in a block.
Words are ordered by how many documents hold them, rarest first:

- prefix filter: a block that holds ``need`` of a template's n words holds one of its n - need + 1 rarest;
- length filter: it has at least ``need`` distinct words;
- positional filter: a common word at places i and j of the two ordered sets leaves room for
  min(i, j) + 1 + min(words after i, words after j) common words, which must reach ``need``.

What is left is counted exactly, stretch by stretch. All of it is DataFrame work on the JVM; the templates, a fixed list,
are broadcast.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Usual wordings of license notices, with the labels they give.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
THRESHOLD = 0.9

NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PLACE = " (" + "|".join(p.removesuffix(" license") for p in PHRASES) + ") license(?= )"


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())))


def lowered(text: Column) -> Column:
    """A-Z in lower case; null is empty. No word of a phrase or template can come from another letter: the only one
    that ``lower`` turns into a letter of A-Z, the Kelvin sign, is set aside first."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))


def spaced(low: Column) -> Column:
    """The words, each after one space, with a space at the end; only spaces where there is no word."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(low, NO_WORD, " ")), F.lit(" "))


def _count(text: Column, char: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))).cast("long")


def _labels(found: Column) -> Column:
    names = F.create_map(*[F.lit(x) for phrase, label in PHRASES.items() for x in (phrase.removesuffix(" license"), label)])
    return F.transform(found, lambda x: names[x])


def base_places(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``n_base``, ``first_word``, ``last_word`` and ``found`` (the labels, one per place)."""
    words = spaced(lowered(F.col(text)))
    rows = docs.withColumn("__spaced", words)
    some = F.contains("__spaced", F.lit(" license "))
    found = F.when(some, F.regexp_extract_all("__spaced", F.lit(PLACE), F.lit(1))).otherwise(F.array().cast("array<string>"))
    # words before a place: the spaces before it, without the one that opens the text
    before = lambda much: F.when(some & F.col("__spaced").rlike(PLACE), _count(F.regexp_extract(
        "__spaced", f"(?s)^({much}){PLACE}", 1), " "))
    return (rows.withColumns({"n_words": F.when(F.trim("__spaced") == "", F.lit(0)).otherwise(_count(F.col("__spaced"), " ") - 1).cast("long"),
                              "found": _labels(found), "first_word": before(".*?"), "last_word": before(".*")})
            .withColumn("n_base", F.size("found").cast("long")).drop("__spaced"))


def all_words(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def blocks(docs: DataFrame, text: str, keys: list[str], step: int, one_of: list[str]) -> DataFrame:
    """``(keys, block, words)``: blocks of 2 * ``step`` words, ``step`` apart, that hold a word of ``one_of``."""
    some = F.array(*[F.lit(w) for w in one_of])
    words = docs.select(*keys, F.split(F.trim(spaced(lowered(F.col(text)))), " ").alias("all")).where(F.arrays_overlap("all", some))
    last = F.greatest(F.ceil((F.size("all") - step) / F.lit(step)), F.lit(1)).cast("int") - 1
    cut = words.select(*keys, "all", F.explode(F.sequence(F.lit(0), last)).alias("block"))
    return (cut.select(*keys, "block", F.slice("all", F.col("block") * step + 1, F.lit(2 * step)).alias("words"))
            .where(F.arrays_overlap("words", some)))


def rarest_first(docs: DataFrame, templates, text: str = "text") -> list[str]:
    """The words of all templates by the number of documents that hold them, then by name: a bounded list."""
    words = sorted({w for _, body in templates for w in template_words(body)})
    literal = F.array(*[F.lit(w) for w in words])
    held = docs.select(F.explode(F.array_intersect(F.split(spaced(lowered(F.col(text))), " "), literal)).alias("word"))
    counts = {row["word"]: row["count"] for row in held.groupBy("word").count().collect()}
    return sorted(words, key=lambda w: (counts.get(w, 0), w))


def matches(docs: DataFrame, keys: list[str], text: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(keys, block, label, template, containment)`` for every block that holds a template, at its best stretch.

    Null and empty texts have no blocks; repeated rows match each on their own and are told apart by ``keys`` only.
    """
    order = rarest_first(docs, templates, text)
    rank = {w: n for n, w in enumerate(order)}
    prefix_rows, rare = [], set()
    for number, (label, body) in enumerate(templates):
        words = sorted(template_words(body), key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(words) - 1e-9))
        rare.update(words[:len(words) - need + 1])
        prefix_rows += [F.struct(F.lit(w).alias("word"), F.lit(i).alias("i"), F.lit(number).alias("template"), F.lit(label).alias("label"),
                                 F.lit(need).alias("need"), F.lit(len(all_words(body))).alias("long"), F.array(*[F.lit(x) for x in words]).alias("of"))
                        for i, w in enumerate(words[:len(words) - need + 1])]
    spark = docs.sparkSession
    prefixes = spark.range(1).select(F.inline(F.array(*prefix_rows)))
    step = max(len(all_words(body)) for _, body in templates)
    held = (blocks(docs, text, keys, step, sorted(rare))
            # in the global order, as the first list is
            .select(*keys, "block", "words", F.size(F.array_distinct("words")).alias("size"),
                    F.array_intersect(F.array(*[F.lit(w) for w in order]), F.col("words")).alias("shared")))
    pairs = (held.select("*", F.posexplode("shared").alias("j", "word")).join(F.broadcast(prefixes), "word")
             .where("size >= need AND least(i, j) + 1 + least(size(of) - i, size(shared) - j) - 1 >= need"))
    common = F.size(F.array_intersect("of", "shared"))
    # a block meets a template once per shared prefix word: the least of them stands for the pair
    first = F.array_position("shared", F.col("word")) == F.array_min(F.transform(
        F.array_intersect(F.slice("of", 1, F.size("of") - F.col("need") + 1), F.col("shared")), lambda w: F.array_position("shared", w)))
    near = pairs.where(first & (common >= F.col("need"))).select(*keys, "block", "label", "template", "need", "long", "of", F.filter(
        F.transform("words", lambda w, at: F.struct(at.alias("at"), w.alias("w"))), lambda x: F.array_contains("of", x["w"])).alias("places"))
    stretch = F.expr("""array_max(transform(places, p -> size(array_distinct(transform(
        filter(places, q -> q.at >= p.at AND q.at < p.at + long), q -> q.w)))))""")
    return (near.withColumn("most", stretch).where("most >= need")
            .select(*keys, "block", "label", "template", (F.col("most") / F.size("of")).alias("containment")))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, the base places, ``labels`` and ``score``, the largest containment (0 if none).

    A null text is empty. Rows repeated in full get equal results, one each; so do rows with a null id. A text of any length
    is scanned whole, in blocks. Other columns, of any name, are left out. ``templates`` are (label, wording), a list that
    the driver holds and that is broadcast.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = rows.withColumn("__key", F.xxhash64("doc_id", "text"))
    held = matches(keyed, ["__key"], "text", templates, threshold)
    per_doc = held.groupBy("__key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    none = F.array().cast("array<string>")
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return base_places(keyed, "text").drop("text").join(per_doc, "__key", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", listed(F.col("found")).alias("base_labels"),
        listed(F.concat("found", F.coalesce("more", none))).alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"))


def query(spark: SparkSession, folder: str) -> DataFrame:
    return scan(spark.read.parquet(f"{folder}/documents.parquet"))


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


ORACLE = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
w AS (SELECT doc_id, low, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM d),
t AS (SELECT unnest([{", ".join(f"{{'label': '{label}', 'long': {len(all_words(body))}, 'words': {_sql_list(template_words(body))}}}" for label, body in TEMPLATES)}]) AS t),
near AS (SELECT doc_id, w.words AS words, t.label AS label, t.words AS tw, t.long AS long, ceil({THRESHOLD} * len(t.words) - 1e-9) AS need FROM w, t
  WHERE len(list_intersect(t.words, w.words)) >= ceil({THRESHOLD} * len(t.words) - 1e-9)),
best AS (SELECT doc_id, label, need, len(tw) AS size, list_max(list_transform(list_filter(range(1, len(words) + 1), lambda i: list_contains(tw, words[i])),
  lambda i: len(list_intersect(tw, words[i:i + long - 1])))) AS most FROM near),
held AS (SELECT doc_id, label, most * 1.0::DOUBLE / size AS c FROM best WHERE most >= need),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM held GROUP BY doc_id),
p AS (SELECT doc_id, len(words) AS n_words,
  list_filter(range(1, len(words)), lambda i: words[i] = 'mit' AND words[i + 1] = 'license') AS mit,
  list_filter(range(1, len(words)), lambda i: words[i] = 'apache' AND words[i + 1] = 'license') AS apache,
  list_filter(range(1, len(words) - 1), lambda i: words[i] = 'general' AND words[i + 1] = 'public' AND words[i + 2] = 'license') AS gpl FROM w),
b AS (SELECT *, list_concat(list_concat(mit, apache), gpl) AS places,
  list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS labels FROM p)
SELECT b.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  array_to_string(b.labels, ',') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, coalesce(more.labels, [])))), ','), '') AS labels,
  coalesce(more.best, 0.0::DOUBLE) AS score
FROM b LEFT JOIN more ON b.doc_id = more.doc_id
"""
