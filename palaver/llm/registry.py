"""The queries of this folder and their check SQL."""

from __future__ import annotations

from palaver.llm import bpe_automaton, collocations, cross_polytope, html_extract, license_scan, merkle, ngram_join, packing, quality_rules, recompression, rule_ensemble, suffix_dedup, token_counts

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_bpe_automaton": bpe_automaton.op5_bpe_automaton,
    "op6_recompression": recompression.op6_recompression,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_cross_polytope": cross_polytope.op8_cross_polytope,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_quality_ensemble": rule_ensemble.op12_quality_ensemble,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op3_license_scan": license_scan.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op13_phrase_collocations": collocations.ORACLE,
}
