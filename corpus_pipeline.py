"""From raw documents to token ids: the stages of a training corpus, each over all that the stage before has kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.

1. language_id drops documents without letters and those most of whose letters no learned language uses.
2. near_duplicates keeps one document of each group linked by Jaccard similarity 0.8 of five-word shingles.
3. decontamination drops documents that hold a benchmark item.
4. secrets replaces secrets in the text by a mark.
5. bpe encodes the text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import bpe, decontaminate, jaccard, language_id, secrets
from driftline.sources.scratch import scratch_path


def _encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digest(docs, *bpe.tokenizer())


STAGES = [
    ("language_id", language_id.stage),
    ("near_duplicates", jaccard.stage),
    ("decontamination", decontaminate.stage),
    ("secrets", secrets.stage),
    ("bpe", _encoded),
]

#: SQL has no expression for language profiles or merges; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
