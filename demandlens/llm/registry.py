"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from demandlens.llm import chat, counts, decontam, jaccard, language, lm, mixing, oracles, pii, repair, resample, simhash, store, transport

_QUERIES = {
    "op1_pseudonyms": pii.op1_pseudonyms,
    "op2_simhash_groups": simhash.op2_simhash_groups,
    "op3_token_store": store.op3_token_store,
    "op4_token_counts": counts.op4_token_counts,
    "op5_decontaminate": decontam.op5_decontaminate,
    "op6_lm_scores": lm.op6_lm_scores,
    "op7_quotation_threads": chat.op7_quotation_threads,
    "op8_transport_streams": transport.op8_transport_streams,
    "op9_language_id": language.op9_language_id,
    "op10_mix_sources": mixing.op10_mix_sources,
    "op11_repair_conversations": repair.op11_repair_conversations,
    "op12_resample": resample.op12_resample,
    "op13_jaccard_groups": jaccard.op13_jaccard_groups,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
