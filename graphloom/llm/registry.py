"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from . import exact_dedup, katz, language, line_dedup, nearest, ngram_join, packing, piece_codec, ranked_search, substring_dedup, token_counts, toxicity, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_language_id": language.op2_language_id,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_ngram_join": ngram_join.op4_ngram_join,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_sentencepiece": piece_codec.op7_sentencepiece,
    "op8_katz_scoring": katz.op8_katz_scoring,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_nearest": nearest.op10_nearest,
    "op11_whitening": whitening.op11_whitening,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_ranked_search": ranked_search.op13_ranked_search,
}
ORACLES = {"op3_exact_dedup": exact_dedup.ORACLE, "op5_substring_dedup": substring_dedup.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
