"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from quarry.llm import chat_format, conversation_trie, decontamination, late_partitions, license_scan, lm_scoring, near_dedup, packing, quality_classifier, quality_rules, tokens, url_filter, warc

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_quality_classifier": quality_classifier.op2_quality_classifier,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_warc": warc.op8_warc,
    "op9_lm_scoring": lm_scoring.op9_lm_scoring,
    "op10_packing": packing.op10_packing,
    "op11_late_partitions": late_partitions.op11_late_partitions,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}
ORACLES = {"op1_decontamination": decontamination.ORACLE, "op4_quality_rules": quality_rules.ORACLE, "op5_chat_format": chat_format.ORACLE, "op6_near_dedup": near_dedup.ORACLE, "op7_license_scan": license_scan.ORACLE, "op8_warc": warc.ORACLE, "op9_lm_scoring": lm_scoring.ORACLE, "op12_url_filter": url_filter.ORACLE, "op13_conversation_trie": conversation_trie.ORACLE}
