"""The queries of this package, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import collocations, embedding_dedup, importance_resampling, language_id, lm_scoring, minhash_dedup, mixing, packing, quality_rules, sharding, suffix_dedup, token_counts, topk_search

QUERIES = {
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
    "op11_importance_resampling": importance_resampling.op11_importance_resampling,
    "op10_lm_scoring": lm_scoring.op10_lm_scoring,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_topk_search": topk_search.op2_topk_search,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_sharding": sharding.op7_sharding,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_language_id": language_id.op4_language_id,
    "op5_token_counts": token_counts.op5_token_counts,
}

ORACLE_SQL: dict[str, str] = {
    "op13_phrase_collocations": collocations.ORACLE_SQL,
    "op11_importance_resampling": importance_resampling.ORACLE_SQL,
    "op1_embedding_dedup": embedding_dedup.ORACLE_SQL,
    "op2_topk_search": topk_search.ORACLE_SQL,
}
