"""Registered corpus queries and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from listinglake.llm import cross_entropy, decontamination, lexical, licenses, merkle, mixing, near_dedup, packing, pseudonyms, quality, sharding, suffix_dedup, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_licenses": licenses.op2_licenses,
        "op3_sharding": sharding.op3_sharding,
        "op4_cross_entropy": cross_entropy.op4_cross_entropy,
        "op5_quality": quality.op5_quality,
        "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
        "op7_decontamination": decontamination.op7_decontamination,
        "op8_pseudonyms": pseudonyms.op8_pseudonyms,
        "op9_packing": packing.op9_packing,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_merkle": merkle.op11_merkle,
        "op12_search": lexical.op12_search,
        "op13_mixing": mixing.op13_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licenses": licenses.oracle(),
        "op10_url_filter": url_filter.oracle(),
        "op11_merkle": merkle.oracle(),
        "op12_search": lexical.oracle(),
        "op13_mixing": mixing.oracle(),
    }
