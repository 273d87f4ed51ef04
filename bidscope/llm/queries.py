"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import (ann, chat, filter_audit, language, mixing, ngram_join, packing, phrases, pii,
               quality, sharding, token_store, toxicity)

QUERIES = {
    "op1_ngram_jaccard_join": ngram_join.op1_ngram_jaccard_join,
    "op2_hash_prefix_forest": ann.op2_hash_prefix_forest,
    "op3_sampled_splitters": sharding.op3_sampled_splitters,
    "op4_ngram_toxicity": toxicity.op4_ngram_toxicity,
    "op5_pfair_mixing": mixing.op5_pfair_mixing,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_budgeted_windows": chat.op7_budgeted_windows,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_bootstrapped_contexts": pii.op9_bootstrapped_contexts,
    "op10_token_store": token_store.op10_token_store,
    "op11_zstd_language": language.op11_zstd_language,
    "op12_quotient_phrases": phrases.op12_quotient_phrases,
    "op13_filter_orders": filter_audit.op13_filter_orders,
}

ORACLE_SQL = {
    "op5_pfair_mixing": mixing.ORACLE,
    "op7_budgeted_windows": chat.ORACLE,
    "op8_quality_rules": quality.ORACLE,
    "op12_quotient_phrases": phrases.ORACLE,
    "op13_filter_orders": filter_audit.ORACLE,
}
