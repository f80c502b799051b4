"""Registered queries: one Spark query per operator and, where SQL can express it, its check SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..derived import Tables

AREAS = ("text", "body", "chunking", "concepts", "similarity", "dedup", "graph", "scheduling", "analytics", "sources", "flows")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return _plain(self.build(Tables(spark, folder)))


def _plain(df: DataFrame) -> DataFrame:
    """Integers as long, so that both engines report the same column types."""
    small = (T.IntegerType, T.ShortType, T.ByteType)
    return df.select(*[
        F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, small) else F.col(f"`{f.name}`")
        for f in df.schema
    ])


def all_queries() -> list[Query]:
    out: list[Query] = []
    for area in AREAS:
        out += importlib.import_module(f"{__name__}.{area}").QUERIES
    names = [q.name for q in out]
    assert len(names) == len(set(names)), "duplicate query name"
    return out
