"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from netweave.llm import exact_dedup, html_extract, language_id, merge_dropout, packing, quality_rules, secret_scan, simhash_dedup, substring_dedup, toxicity

QUERIES = {
    "op1_pack": packing.op1,
    "op2_merge_dropout": merge_dropout.op2,
    "op3_simhash_dedup": simhash_dedup.op3,
    "op4_secret_scan": secret_scan.op4,
    "op5_quality_rules": quality_rules.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_toxicity": toxicity.op7,
    "op8_exact_dedup": exact_dedup.op8,
    "op9_html_extract": html_extract.op9,
    "op10_language_id": language_id.op10,
}

ORACLES = {"op4_secret_scan": secret_scan.ORACLE, "op5_quality_rules": quality_rules.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE}
