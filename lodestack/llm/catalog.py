"""Queries of the corpus operators and the SQL that checks them.

The other operators have no SQL (hashing models, tokenizers, minwise hashes, exact repeats of
whole texts); tests/llm holds each against a brute-force version, a round trip or held-out rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, embedding, language_id, minhash, quality, sharding, substring, token_counts, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": substring.query,
        "op2_bpe_encode_decode": bpe.query,
        "op3_toxicity": toxicity.query,
        "op4_minhash_near_dedup": minhash.query,
        "op5_sharding": sharding.query,
        "op6_token_counts": token_counts.query,
        "op7_language_id": language_id.query,
        "op8_embedding_near_dedup": embedding.query,
        "op9_quality_classifier": quality.query,
        "op10_decontamination": decontaminate.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_sharding": sharding.sql(), "op8_embedding_near_dedup": embedding.sql()}
