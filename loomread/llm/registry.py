"""Queries of this package and, where SQL can say the same, their SQL."""

from __future__ import annotations

from loomread.llm import chat, decontamination, licenses, nearest, pieces, rules, sharding, suffixes, warc, weighting

QUERIES = {
    "op1_context_weighting": weighting.op1_context_weighting,
    "op2_warc_segments": warc.op2_warc_segments,
    "op3_sentencepiece_nbest": pieces.op3_sentencepiece_nbest,
    "op4_quality_rules": rules.op4_quality_rules,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_minhash_forest": nearest.op6_minhash_forest,
    "op7_suffix_dedup": suffixes.op7_suffix_dedup,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_sharding": sharding.op10_sharding,
}

ORACLE_SQL = {
    "op2_warc_segments": warc.SQL_WARC,
    "op4_quality_rules": rules.SQL_RULES,
    "op5_license_scan": licenses.SQL_LICENSES,
    "op6_minhash_forest": nearest.SQL_NEAR,
    "op7_suffix_dedup": suffixes.SQL_REPEATS,
    "op8_decontamination": decontamination.SQL_DECONTAMINATION,
    "op10_sharding": sharding.SQL_SHARDING,
}
