"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query name -> (module, function)
_QUERIES = {
    "op1_line_dedup": ("lines", "op1_line_dedup"),
    "op2_token_counts": ("token_counts", "op2_token_counts"),
    "op3_byte_bpe": ("bytebpe", "op3_byte_bpe"),
    "op4_quality": ("quality", "op4_quality"),
    "op5_packing": ("packing", "op5_packing"),
    "op6_license_scan": ("licenses", "op6_license_scan"),
    "op7_lz_fingerprint": ("lz", "op7_lz_fingerprint"),
    "op8_chat_format": ("chat", "op8_chat_format"),
    "op9_simhash": ("simhash", "op9_simhash"),
    "op10_embedding_near_dedup": ("embeddings", "op10_embedding_near_dedup"),
}

#: queries with SQL -> module that holds it as ORACLE_SQL
_ORACLES = {"op6_license_scan": "licenses", "op8_chat_format": "chat"}


def _call(module: str, function: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: getattr(import_module(f"tessera.llm.{module}"), function)(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _call(*where) for name, where in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: import_module(f"tessera.llm.{module}").ORACLE_SQL for name, module in _ORACLES.items()}
