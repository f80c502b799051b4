"""Queries of this subpackage and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, html_text, lines, minhash, mixing, packing, passages, periodic, pii, quality, topk, toxicity

MODULES = (toxicity, minhash, pii, html_text, quality, mixing, topk, bpe, lines, passages, packing, periodic, collocations)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
