"""A training corpus from ``documents``: quality rules, line dedup, near-dedup, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lernwerk.llm import bpe, lines, minhash, mixing, quality
from lernwerk.llm.common import Shared, documents

#: Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality.stage),
    ("line_dedup", lines.stage),
    ("minhash_near_dedup", minhash.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: SuperMinHash groups, raking and BPE merges have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = Shared(spark)
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = shared.put(stage(spark, docs, sf_dir))
    return docs
