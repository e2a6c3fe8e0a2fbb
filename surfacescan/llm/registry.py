"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, jaccard, language_model, mixing, mpeg, neighbours, packing, pii, quality, secrets, sharding, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.query,
        "op2_sharding": sharding.query,
        "op3_language_model": language_model.query,
        "op4_neighbours": neighbours.query,
        "op5_mpeg_audio": mpeg.query,
        "op6_chat": chat.query,
        "op7_packing": packing.query,
        "op8_jaccard_join": jaccard.query,
        "op9_quality": quality.query,
        "op10_mixing": mixing.query,
        "op11_vector_codes": vector_codes.query,
        "op12_collocations": collocations.query,
        "op13_personal": pii.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sharding": sharding.ORACLE,
        "op6_chat": chat.ORACLE,
        "op8_jaccard_join": jaccard.ORACLE,
        "op10_mixing": mixing.ORACLE,
        "op11_vector_codes": vector_codes.ORACLE,
        "op12_collocations": collocations.ORACLE,
    }
