"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from paperloom.llm import op01_media, op02_bpe, op03_packing, op04_minhash, op05_cotraining, op06_substring, op07_language_id, op08_quality_rules, op09_secret_scan, op10_toxicity, op11_line_dedup, op12_importance, op13_lexical_search

QUERIES = {
    "op1_media": op01_media.query,
    "op2_bpe": op02_bpe.query,
    "op3_packing": op03_packing.query,
    "op4_minhash": op04_minhash.query,
    "op5_cotraining": op05_cotraining.query,
    "op6_substring": op06_substring.query,
    "op7_language_id": op07_language_id.query,
    "op8_quality_rules": op08_quality_rules.query,
    "op9_secret_scan": op09_secret_scan.query,
    "op10_toxicity": op10_toxicity.query,
    "op11_line_dedup": op11_line_dedup.query,
    "op12_importance": op12_importance.query,
    "op13_lexical_search": op13_lexical_search.query,
    # further results of the same operators
    "clips_media": op01_media.clips_query,
    "ablation_quality_rules": op08_quality_rules.ablation_query,
    "pages_language_id": op07_language_id.pages_query,
}
ORACLES = {
    "op6_substring": op06_substring.ORACLE,
    "op8_quality_rules": op08_quality_rules.ORACLE,
    "op9_secret_scan": op09_secret_scan.ORACLE,
    "op11_line_dedup": op11_line_dedup.ORACLE,
    "op13_lexical_search": op13_lexical_search.ORACLE,
    "ablation_quality_rules": op08_quality_rules.ABLATION_ORACLE,
}
