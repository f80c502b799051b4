"""Concept units: grouping of labelled chunks, reading time, binning, splitting (CPT1-CPT10).

Windows are partitioned by document.  All chunks of a document come from one text cell, so a window
never holds more than one row's worth of text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.common import let
from .body import LOADS
from .chunking import groups_of, pack
from .similarity import jaccard

# Labels that always open a unit, reading speeds, and pairs that must stay together.
OPENING_LABELS = ("NewTopic", "Introduction", "Conclusion", "Summary", "WrapUp")
LABEL_SPEEDS = {
    "Definition": 1.2, "Example": 1.1, "Theorem": 0.6, "Proof": 0.5,
    "Algorithm": 0.7, "Code": 0.8, "Exercise": 0.9, "Discussion": 1.0,
}
BAD_SPLITS = (("Definition", "Example"), ("Statement", "Proof"), ("Theorem", "Derivation"), ("Algorithm", "Pseudocode"))


def concept_groups(labels: DataFrame, max_group: int = 3, min_overlap: float = 0.2) -> DataFrame:
    """CPT1: ``labels`` with concept_order (1-based per document).

    A unit opens at an opening label, at a keyword overlap below ``min_overlap`` and after
    ``max_group`` chunks.  Three windows over one partitioning by document.
    """
    doc = W.partitionBy("doc_id").orderBy("chunk_order")
    before = F.lag("keywords").over(doc)
    shift = (F.size(before) > 0) & (F.size("keywords") > 0) & (jaccard(before, F.col("keywords")) < min_overlap)
    marked = labels.withColumn("_break", F.col("primary_label").isin(list(OPENING_LABELS)) | F.coalesce(shift, F.lit(False)))
    island = marked.withColumn("_island", F.sum(F.col("_break").cast("int")).over(doc.rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy("doc_id", "_island").orderBy("chunk_order"))
    opened = island.withColumn("_open", ((place - 1) % max_group == 0).cast("int"))
    order = F.sum("_open").over(doc.rowsBetween(W.unboundedPreceding, 0))
    return opened.withColumn("concept_order", order.cast("long")).drop("_break", "_island", "_open")


def top_keywords(keywords: Column, top: int) -> Column:
    """The most frequent entries of an array, ties in first-seen order."""
    def ranked(all_: Column) -> Column:
        counted = F.transform(F.array_distinct(all_), lambda k, i: F.struct(
            (-F.size(F.filter(all_, lambda x: x == k))).alias("n"), i.alias("i"), k.alias("k")))
        return F.transform(F.slice(F.array_sort(counted), 1, top), lambda s: s["k"])

    return let(keywords, ranked)


def concept_units(grouped: DataFrame, top: int = 5) -> DataFrame:
    """CPT2: one row per unit.  A unit has few chunks by construction, so its rows are collected."""
    members = grouped.groupBy("doc_id", "concept_order").agg(
        F.array_sort(F.collect_list(F.struct("chunk_order", "primary_label", "keywords", "word_count"))).alias("m")
    )
    rows = members.select(
        "doc_id", "concept_order",
        F.array_sort(F.array_distinct(F.transform("m", lambda x: x["primary_label"]))).alias("labels"),
        F.get("m", F.lit(0))["primary_label"].alias("first_label"),
        top_keywords(F.flatten(F.transform("m", lambda x: x["keywords"])), top).alias("top_keywords"),
        F.array_distinct(F.flatten(F.transform("m", lambda x: x["keywords"]))).alias("keywords"),
        F.aggregate("m", F.lit(0).cast("long"), lambda acc, x: acc + x["word_count"]).alias("word_count"),
        F.transform("m", lambda x: x["chunk_order"]).alias("chunk_orders"),
        F.transform("m", lambda x: x["primary_label"]).alias("chunk_labels"),
    )
    shown = F.when(F.size("top_keywords") > 0, F.array_join(F.slice("top_keywords", 1, 3), ", ")).otherwise(F.col("first_label"))
    title = F.concat(F.lit("Concept "), F.col("concept_order").cast("string"), F.lit(": "), shown)
    return rows.withColumn("title", F.substring(title, 1, 255)).drop("first_label")


def unit_text(grouped: DataFrame, chunks: DataFrame) -> DataFrame:
    """CPT3: the text of each unit, its chunks in order, with word and character counts."""
    joined = grouped.select("doc_id", "chunk_order", "concept_order").join(
        chunks.select("doc_id", "chunk_order", "chunk_text", "word_count"), ["doc_id", "chunk_order"]
    )
    return joined.groupBy("doc_id", "concept_order").agg(
        F.array_sort(F.collect_list(F.struct("chunk_order", "chunk_text"))).alias("m"), F.sum("word_count").alias("n_words")
    ).select(
        "doc_id", "concept_order", F.array_join(F.transform("m", lambda x: x["chunk_text"]), "\n\n").alias("unit_text"), "n_words",
    ).withColumn("n_chars", F.length("unit_text").cast("long"))


def reading_time(units: DataFrame, wpm: int = 200, factor: float = 1.3) -> DataFrame:
    """CPT4: ``units`` with reading_min from words and the mean speed of their labels; at least one minute."""
    speeds = F.create_map(*[F.lit(x) for pair in LABEL_SPEEDS.items() for x in pair])
    total = F.aggregate(
        "labels", F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(speeds, x), F.lit(1.0))
    )
    mean = F.when(F.size("labels") > 0, total / F.size("labels")).otherwise(F.lit(1.0))
    minutes = F.col("word_count") / (F.lit(float(wpm)) * mean) * F.lit(factor)
    return units.withColumn("reading_min", F.greatest(F.lit(1.0), minutes))


def length_flags(units: DataFrame, lo: float = 5.0, hi: float = 10.0) -> DataFrame:
    """CPT5: optimal, needs_split and combinable with the next unit of the document."""
    ahead = F.lead("reading_min").over(W.partitionBy("doc_id").orderBy("concept_order"))
    return units.select(
        "doc_id", "concept_order", "reading_min",
        F.col("reading_min").between(lo, hi).alias("optimal"),
        (F.col("reading_min") > hi).alias("needs_split"),
        F.coalesce(F.col("reading_min") + ahead < hi, F.lit(False)).alias("combinable"),
    )


def bin_by_time(units: DataFrame, cap: float = 10.0) -> DataFrame:
    """CPT6: ``units`` (doc_id, concept_order, reading_min) with bin_order; greedy, in document order.

    Two units pair up when their sum stays below ``cap``; a pair grows while its sum stays within it.
    """
    def joins(total: Column, members: Column, w: Column) -> Column:
        return F.when(members == 1, total + w < cap).otherwise((total < cap) & (total + w <= cap))

    docs = units.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("concept_order", "reading_min"))).alias("u"))
    cut = docs.withColumn("starts", pack(F.col("u"), lambda x: x["reading_min"], joins))
    bins = cut.select("doc_id", F.posexplode(groups_of(F.col("u"), F.col("starts"))).alias("bin", "g"))
    return bins.select("doc_id", (F.col("bin") + 1).cast("long").alias("bin_order"), F.explode("g").alias("x")).select(
        "doc_id", "bin_order", "x.concept_order", "x.reading_min", (F.col("x.reading_min") > cap).alias("needs_split")
    )


def split_long(units: DataFrame, cap: float = 10.0) -> DataFrame:
    """CPT7: halve over-long units near their middle until every part fits or is one chunk.

    Input: doc_id, concept_order, reading_min, chunk_orders and chunk_labels (arrays in chunk order).
    All halvings of a unit happen inside its row: each pass of the fold splits every over-long part, and
    2*log2(n)+2 passes are enough because a cut lies at most min(2, n/4) from the middle.
    """
    labels = F.col("chunk_labels")
    bad = [f"{a}>{b}" for a, b in BAD_SPLITS]

    def point(seg: Column) -> Column:
        n = seg["n"]
        mid = F.floor(n / 2).cast("int")
        reach = F.least(F.lit(2), F.floor(n / 4).cast("int"))
        offsets = F.array(*[F.lit(o) for o in (0, 1, -1, 2, -2)])
        fits = F.filter(F.transform(F.filter(offsets, lambda o: F.abs(o) <= reach), lambda o: mid + o), lambda p: (
            (p > 0) & (p < n)
            & ~F.concat(F.get(labels, seg["s"] + p - 1), F.lit(">"), F.get(labels, seg["s"] + p)).isin(bad)
        ))
        return F.coalesce(F.get(fits, F.lit(0)), F.greatest(F.lit(1), F.least(mid, n - 1)))

    def part(s: Column, n: Column, t: Column) -> Column:
        return F.struct(s.alias("s"), n.alias("n"), t.alias("t"))

    def split(seg: Column) -> Column:
        return F.when((seg["t"] > cap) & (seg["n"] > 1), let(point(seg), lambda p: F.array(
            part(seg["s"], p, seg["t"] * (p / seg["n"])),
            part(seg["s"] + p, seg["n"] - p, seg["t"] * ((seg["n"] - p) / seg["n"])),
        ))).otherwise(F.array(seg))

    first = F.array(part(F.lit(0), F.size("chunk_orders"), F.col("reading_min")))
    passes = F.sequence(F.lit(1), (F.ceil(F.log2(F.greatest(F.size("chunk_orders"), F.lit(1)))) * 2 + 2).cast("int"))
    parts = F.aggregate(passes, first, lambda acc, _: F.flatten(F.transform(acc, split)))
    rows = units.select("doc_id", "concept_order", "chunk_orders", "chunk_labels", F.posexplode(parts).alias("part", "p"))
    return rows.select(
        "doc_id", "concept_order", F.col("part").cast("long").alias("part"),
        F.slice("chunk_orders", F.col("p.s") + 1, F.col("p.n")).alias("chunk_orders"),
        F.slice("chunk_labels", F.col("p.s") + 1, F.col("p.n")).alias("chunk_labels"),
        F.col("p.t").alias("reading_min"),
    )


def merge_units(binned: DataFrame) -> DataFrame:
    """CPT8: one row per (doc_id, bin_order).  Input adds title, labels, word_count, reading_min,
    complexity, load and chunk_orders per unit.  Chunk links are kept, also for split units."""
    rank = F.array_position(F.array(*[F.lit(x) for x in LOADS]), F.col("load"))
    rank = F.when(rank == 0, F.lit(2)).otherwise(rank)
    merged = binned.groupBy("doc_id", "bin_order").agg(
        F.count("*").alias("n_units"),
        F.sum("word_count").alias("word_count"),
        F.sum("reading_min").alias("reading_min"),
        F.avg("complexity").alias("complexity"),
        F.max_by("load", F.struct(rank, -F.col("concept_order"))).alias("load"),
        F.min_by("title", "concept_order").alias("_title"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"),
        F.array_sort(F.flatten(F.collect_list("chunk_orders"))).alias("chunk_orders"),
    )
    combined = F.concat(
        F.lit("Combined Concept "), F.col("bin_order").cast("string"), F.lit(": "), F.array_join(F.slice("labels", 1, 3), ", ")
    )
    title = F.when(F.col("n_units") == 1, F.col("_title")).otherwise(combined)
    return merged.withColumn("title", F.substring(title, 1, 255)).drop("_title")


def related_prior(units: DataFrame, window: int = 3) -> DataFrame:
    """CPT9: the prior unit with the best label and keyword overlap among the last ``window``.

    Input: doc_id, concept_order, labels, keywords.  Lags over one window replace a range self-join.
    """
    doc = W.partitionBy("doc_id").orderBy("concept_order")
    terms = units.select(
        "doc_id", "concept_order",
        F.array_distinct(F.transform(F.concat("labels", "keywords"), F.lower)).alias("terms"),
    )
    for k in range(1, window + 1):
        terms = terms.withColumn(f"_t{k}", F.lag("terms", k).over(doc)).withColumn(f"_o{k}", F.lag("concept_order", k).over(doc))
    options = F.array(*[
        F.struct(jaccard(F.col("terms"), F.col(f"_t{k}")).alias("score"), F.col(f"_o{k}").alias("order")) for k in range(1, window + 1)
    ])
    best = terms.select("doc_id", "concept_order", F.array_max(F.filter(options, lambda s: s["score"] > 0)).alias("b"))
    return best.select(
        "doc_id", "concept_order", F.col("b.order").alias("prior_order"), F.coalesce("b.score", F.lit(0.0)).alias("score")
    )


def next_order(existing: DataFrame, new: DataFrame, order_col: str, sort_col: str) -> DataFrame:
    """CPT10: ``new`` rows numbered after the highest ``order_col`` of their document."""
    top = existing.groupBy("doc_id").agg(F.max(order_col).alias("_top"))
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(sort_col))
    return new.join(top, "doc_id", "left").withColumn(
        order_col, F.coalesce("_top", F.lit(0)).cast("long") + place
    ).drop("_top")
