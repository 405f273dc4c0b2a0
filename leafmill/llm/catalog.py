"""Queries of the ten operators, each over its whole table, and their SQL twins."""

from __future__ import annotations

from leafmill.llm import bpe, decontamination, embedding_dedup, jaccard_join, language, pii, quality, sharding, token_files, url_filter

QUERIES = {
    "op1_quality": quality.op1,
    "op2_sharding": sharding.op2,
    "op3_token_files": token_files.op3,
    "op4_byte_bpe": bpe.op4,
    "op5_url_filter": url_filter.op5,
    "op6_pii": pii.op6,
    "op7_embedding_dedup": embedding_dedup.op7,
    "op8_jaccard_join": jaccard_join.op8,
    "op9_decontamination": decontamination.op9,
    "op10_language": language.op10,
}

ORACLES: dict[str, str] = {
    "op5_url_filter": url_filter.ORACLE,
}
