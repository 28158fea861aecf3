"""Queries of the corpus operators and their SQL, for the repository's entry point."""

from __future__ import annotations

import corpus_pipeline

from . import (
    decontamination,
    filter_audit,
    license_scan,
    mixing,
    ngram_jaccard,
    pii,
    prefix_trie,
    quality_classifier,
    quality_rules,
    sharding,
    substring_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard.op1_ngram_jaccard,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op7_decontamination": decontamination.op7_decontamination,
    "op5_mixing": mixing.op5_mixing,
    "op6_pii": pii.op6_pii,
    "op2_toxicity": toxicity.op2_toxicity,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op3_sharding": sharding.op3_sharding,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op4_quality_rules": quality_rules.ORACLE,
    "op11_license_scan": license_scan.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
