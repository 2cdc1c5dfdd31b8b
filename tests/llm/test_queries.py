"""The registered queries: against their SQL where there is one, else that they give a row per document or better."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from compare import connection, difference  # noqa: E402

from driftline.llm.queries import ORACLES, QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
PER_DOCUMENT = ["op4_repeated_bytes", "op5_language_id", "op6_byte_level_bpe", "op7_jaccard_join", "op9_secret_scan", "op1_license_scan",
                "op11_periodic_runs", "op12_token_alignment", "op13_merge_rounds_bpe"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connection(FOLDER), ORACLES[name]) is None


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_a_row_per_document(spark, name):
    ids = [r[0] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id").collect()]
    assert sorted(r["doc_id"] for r in QUERIES[name](spark, FOLDER).select("doc_id").collect()) == sorted(ids)


def test_every_operator_and_the_pipeline():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *(f"op{n}" for n in range(1, 14))}
