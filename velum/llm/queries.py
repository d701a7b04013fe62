"""Queries of this subpackage: name -> callable, and DuckDB SQL where SQL can express the operator."""

from __future__ import annotations

from velum.llm import bpe, decontamination, jaccard_join, language_id, line_dedup, near_dedup, periodic_runs, prefix_trie, quality_crf, quality_rules, sharding, substring_dedup, surrogates

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_line_dedup": line_dedup.query,
    "op3_sharding": sharding.query,
    "op4_quality_crf": quality_crf.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_language_id": language_id.query,
    "op7_surrogates": surrogates.query,
    "op8_decontamination": decontamination.query,
    "op9_bpe": bpe.query,
    "op10_near_dedup": near_dedup.query,
    "op11_jaccard_join": jaccard_join.query,
    "op12_periodic_runs": periodic_runs.query,
    "op13_prefix_trie": prefix_trie.query,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.ORACLE,
    "op3_sharding": sharding.ORACLE,
}
