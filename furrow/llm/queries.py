"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from furrow.llm import digest_index, kneser_ney, lexical, near_dup, ngram_join, packing, pieces, prefix_trie, quality, tokens, toxicity, training_order, winnowing

QUERIES = {
    "op1_lm_scores": kneser_ney.op1_lm_scores,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_near_duplicates": near_dup.op4_near_duplicates,
    "op5_nbest_pieces": pieces.op5_nbest_pieces,
    "op6_quality_classifier": quality.op6_quality_classifier,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_fingerprints": winnowing.op8_fingerprints,
    "op9_training_order": training_order.op9_training_order,
    "op10_exact_dedup": digest_index.op10_exact_dedup,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
}

ORACLES = {"op10_exact_dedup": digest_index.ORACLE, "op11_lexical_search": lexical.ORACLE, "op13_prefix_trie": prefix_trie.ORACLE}
