"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from importlib import import_module

_QUERIES = {
    "op1_warc": "op01_warc",
    "op2_sentencepiece": "op02_sentencepiece",
    "op3_quality_classifier": "op03_quality_classifier",
    "op4_token_counts": "op04_token_counts",
    "op5_source_mix": "op05_source_mix",
    "op6_ngram_join": "op06_ngram_join",
    "op7_embedding_dedup": "op07_embedding_dedup",
    "op8_quality_rules": "op08_quality_rules",
    "op9_secret_scans": "op09_secret_scans",
    "op10_suffix_dedup": "op10_suffix_dedup",
}


def queries() -> dict:
    return {name: getattr(import_module(f"arbora.llm.{module}"), name) for name, module in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from arbora.llm import sql

    return {k: v for k, v in sql.ORACLES.items() if k in _QUERIES}
