"""Mixing sources to target weights by iterative proportional fitting (operator 6).

Documents fall into cells of source, language and topic; the topic is a locality-sensitive group of its words (the
smallest word hash modulo ``TOPICS``), so near copies share it.  Target shares of each margin are its own shares
raised to a power (``POWERS``; 1 keeps them, 0 makes them equal) or given as shares.  Raking scales the cells' token
weights to one margin after the other until all three fit within ``TOLERANCE``, or until ``PATIENCE`` writes in a row
brought the margins no nearer (cells without documents may make targets impossible); ``margin_gap`` says by which
share the margins of a cell still miss.  A document is then kept with the probability
min(1, scale * raked / actual tokens of its cell), where the scale makes the expected tokens ``KEEP`` of all.

All is DataFrame work: one pass over the texts, then aggregates and joins over cells.  The cells are at most the
product of the three margins and never leave Spark.

Defined results: a null or empty text has no tokens and topic 0; null source or language is the value "(none)"; equal
rows share one draw; a cell without tokens is kept with the same scale as if its weight fitted; a margin without tokens
whose target is above 0 misses by 1; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.common import let
from .common import Shared, documents, row_key, small

TOPICS = 8
DIMS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.5}
KEEP = 0.5
SEED = 17
TOLERANCE = 1e-6
#: Rounds between two written tables, and how many of these may pass without the worst gap falling by a hundredth.
ROUNDS, PATIENCE = 4, 5


def _words(text: Column) -> Column:
    """(tokens, smallest hash) of the words of a text."""
    hashes = F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != ""), lambda w: F.xxhash64(w))
    return let(hashes, lambda h: F.struct(F.size(h).cast("long").alias("n_tokens"), F.array_min(h).alias("least")))


def labelled(docs: DataFrame, topics: int = TOPICS) -> DataFrame:
    """row (all columns), mix_source, mix_lang, mix_topic, mix_tokens and mix_draw (uniform in 0..1, from the row itself)."""
    none = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("(none)"))
    return docs.select(F.struct("*").alias("row"), "doc_id", "text", "source", "lang", _words(F.col("text")).alias("mix_words")).select(
        "row", none("source").alias("mix_source"), none("lang").alias("mix_lang"),
        F.coalesce(F.pmod("mix_words.least", F.lit(topics)), F.lit(0)).cast("long").alias("mix_topic"),
        F.col("mix_words.n_tokens").alias("mix_tokens"),
        (F.pmod(F.xxhash64(row_key(), F.lit(SEED)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("mix_draw"),
    )


def raked(cells: DataFrame, shared: Shared, powers: dict[str, float] = POWERS, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """cells(source, lang, topic, tokens) with ``fitted``, whose margins have the target shares, and ``margin_gap``.

    ``targets`` may give (value, share) for a margin instead of its power."""
    total = cells.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    now = cells.withColumn("fitted", F.col("tokens").cast("double"))
    for dim in DIMS:
        if targets and dim in targets:
            want = targets[dim].select(F.col("value").alias(dim), F.col("share").alias("raw"))
        else:
            want = cells.groupBy(dim).agg(F.sum("tokens").alias("t")).select(dim, F.when(F.col("t") > 0, F.pow(F.col("t") / F.lit(max(total, 1.0)), powers[dim])).otherwise(0.0).alias("raw"))
        norm = want.agg(F.sum("raw").alias("norm"))
        norm = norm.first()[0] or 1.0
        now = now.join(want.select(dim, (F.col("raw") / F.lit(norm) * F.lit(total)).alias(f"want_{dim}")), dim)
    now = shared.put(now.withColumn("margin_gap", F.lit(0.0)))
    best, idle = None, 0
    while idle < PATIENCE:
        after = now
        for _ in range(ROUNDS):
            gaps = []
            for dim in DIMS:
                have, want = F.sum("fitted").over(W.partitionBy(dim)), F.col(f"want_{dim}")  # over cells, of which there are few
                after = after.withColumn("have", have).withColumn(f"gap_{dim}", F.when(F.col("have") > 0, want / F.col("have") - 1).otherwise(F.when(want > 0, -1.0).otherwise(0.0)))
                after = after.withColumn("fitted", F.when(F.col("have") > 0, F.col("fitted") * (F.col(f"gap_{dim}") + 1)).otherwise(0.0))
                gaps.append(F.abs(F.col(f"gap_{dim}")))
            after = after.withColumn("margin_gap", F.greatest(*gaps))
        after = shared.put(after.select(now.columns))
        shared.drop(now)
        now = after
        worst = now.agg(F.max("margin_gap")).first()[0]
        if worst is None or worst < TOLERANCE:
            break
        idle = idle + 1 if best is not None and worst > 0.99 * best else 0
        best = worst if best is None else min(best, worst)
    return now.select(*DIMS, "tokens", "fitted", "margin_gap")


def calibrated(cells: DataFrame, shared: Shared, keep: float = KEEP, **kw) -> DataFrame:
    """(source, lang, topic, weight, probability, margin_gap) of each cell."""
    fitted = shared.put(raked(cells, shared, **kw).withColumn("weight", F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(1.0)))
    total = fitted.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    scale = keep
    while True:  # cells at probability 1 leave the rest to the others; each turn caps more cells or ends
        capped = F.col("weight") * F.lit(scale) >= 1
        full, rest = fitted.agg(F.sum(F.when(capped, F.col("tokens"))).cast("double"), F.sum(F.when(~capped, F.col("fitted")))).first()
        after = (keep * total - (full or 0.0)) / rest if rest else scale
        if after <= scale * (1 + 1e-12):
            break
        scale = after
    return shared.put(fitted.select(*DIMS, "weight", F.least(F.lit(1.0), F.col("weight") * F.lit(scale)).alias("probability"), "margin_gap"))


def cells_of(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic")).agg(F.sum("mix_tokens").alias("tokens"))


def drawn(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Labelled rows with weight, probability, margin_gap and kept."""
    of = small(cells.select(F.col("source").alias("mix_source"), F.col("lang").alias("mix_lang"), F.col("topic").alias("mix_topic"), "weight", "probability", "margin_gap"))
    return rows.join(of, ["mix_source", "mix_lang", "mix_topic"]).withColumn("kept", F.col("mix_draw") < F.col("probability"))


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept and margin_gap of every document."""
    shared = Shared(spark)
    rows = shared.put(labelled(documents(spark, folder)).withColumn("doc_id", F.col("row.doc_id").cast("long")).drop("row"))
    cells = calibrated(shared.put(cells_of(rows)), shared)
    return drawn(rows, cells).select(
        "doc_id", F.col("mix_source").alias("source"), F.col("mix_lang").alias("lang"), F.col("mix_topic").alias("topic"),
        F.col("mix_tokens").alias("n_tokens"), "weight", "probability", "kept", "margin_gap",
    )


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that the draw keeps."""
    shared = Shared(spark)
    rows = labelled(docs)
    cells = calibrated(shared.put(cells_of(rows)), shared)
    return drawn(rows, cells).where("kept").select("row.*")


QUERIES = {"op6_mixing": op6_mixing}
SQL: dict[str, str] = {}
