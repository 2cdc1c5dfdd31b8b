"""The queries of the operators in this folder, and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from driftline.llm import (
    alignment,
    bpe,
    decontaminate,
    jaccard,
    language_id,
    licenses,
    merge_rounds,
    packing,
    periodic,
    repeats,
    secrets,
    tool_calls,
    vector_search,
)

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_license_scan": licenses.query,
    "op2_tool_calls": tool_calls.query,
    "op3_benchmark_leaks": decontaminate.query,
    "op4_repeated_bytes": repeats.query,
    "op5_language_id": language_id.query,
    "op6_byte_level_bpe": bpe.query,
    "op7_jaccard_join": jaccard.query,
    "op8_token_packing": packing.query,
    "op9_secret_scan": secrets.query,
    "op10_exact_top_k": vector_search.query,
    "op11_periodic_runs": periodic.query,
    "op12_token_alignment": alignment.query,
    "op13_merge_rounds_bpe": merge_rounds.query,
}
ORACLES: dict[str, str] = {
    "op1_license_scan": licenses.ORACLE,
    "op9_secret_scan": secrets.ORACLE,
    "op10_exact_top_k": vector_search.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
