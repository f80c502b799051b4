"""Document flows: the operators put together as DataFrame graphs (PIP1-PIP6).

Each flow is one lazily built plan; phases that several outputs read are checkpointed once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.text import clean_text, content_hash
from ..operators import chunking, communities, concepts, dedup, graph, similarity
from ..session import cut


@dataclass(frozen=True)
class Corpus:
    chunks: DataFrame
    edges: DataFrame
    communities: DataFrame
    parts: DataFrame
    skipped: DataFrame


def corpus(docs: DataFrame, lo: int = 100, hi: int = 800, tau: float = 0.60, stop_words: tuple[str, ...] | None = None) -> Corpus:
    """PIP1: text -> clean -> paragraph chunks -> TF-IDF (or term frequency) -> graph -> communities -> parts.

    Copies are dropped before chunking.  Documents whose vocabulary is empty fall back to plain term
    frequencies; those without a chunk are listed as skipped.
    """
    cleaned = docs.select("doc_id", clean_text(F.col("text")).alias("text")).withColumn("content_hash", content_hash(F.col("text")))
    narrow = cut(cleaned.select("doc_id", "content_hash"))
    first = narrow.where("content_hash <> ''").groupBy("content_hash").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    unique = cleaned.join(first, "doc_id", "left_semi").select("doc_id", "text")
    chunks = cut(chunking.pack_paragraphs(unique, lo, hi))
    rows = chunks.select("doc_id", F.col("chunk_order").alias("chunk"), F.col("chunk_text").alias("text"))
    weights = cut(similarity.tfidf(rows, stop_words=stop_words))
    plain = similarity.term_freq(rows.join(weights.select("doc_id").distinct(), "doc_id", "left_anti"))
    pairs = cut(similarity.sparse_cosine_pairs(weights.unionByName(plain), tau))
    nodes = chunks.select("doc_id", F.col("chunk_order").alias("node"))
    members = communities.modularity_communities(pairs, nodes)
    grouped = cut(communities.community_chunks(members, chunks))
    skipped = narrow.select("doc_id").join(chunks.select("doc_id").distinct(), "doc_id", "left_anti").join(first.withColumn("unique", F.lit(True)), "doc_id", "left").select(
        "doc_id", F.when(F.col("unique"), "too short").otherwise("copy or empty").alias("reason"))
    return Corpus(chunks, pairs, grouped, chunking.split_large(grouped), skipped)


def with_dedup(blocks: DataFrame, tau: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """PIP2: (surviving blocks, old-to-new map) for blocks with embedding, content_hash, created_at, objectives, segments."""
    pairs = cut(dedup.block_duplicates(blocks, tau))
    mapping = cut(dedup.merge_map(blocks, pairs))
    merged = dedup.merge_blocks(blocks, mapping)
    untouched = blocks.join(mapping.select("block_id"), "block_id", "left_anti").select(
        "block_id", F.lit(0).cast("long").alias("n_merged"), "segments",
        F.aggregate("segments", F.lit(0).cast("long"), lambda acc, s: acc + F.coalesce(s["duration_seconds"], F.lit(dedup.SEGMENT_SECONDS))).alias("total_duration"), "objectives")
    return untouched.unionByName(merged), mapping


def with_graph(blocks: DataFrame, vectors: DataFrame, known_edges: DataFrame, tau: float = 0.75) -> dict[str, DataFrame]:
    """PIP3: typed edges from embeddings merged into the known ones, graph summary and study orders."""
    pairs = similarity.dense_cosine_pairs(vectors, tau)
    edges, created = graph.upsert_edges(known_edges, graph.type_edges(pairs))
    edges = cut(edges)
    return {
        "edges": edges, "created": created, "summary": graph.graph_summary(blocks.select(F.col("block_id").alias("node")), edges),
        "study_order": graph.study_order(blocks, edges), "difficulty_order": graph.difficulty_order(blocks), "cluster_order": graph.cluster_order(blocks, edges),
    }


def cards(files: DataFrame, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """PIP4: (basic cards, counts per content type) of markdown files."""
    rows = chunking.basic_cards(chunking.folder_cards(files, compat))
    return rows, chunking.cards_by_type(rows)


def run_report(docs: DataFrame, result: Corpus) -> DataFrame:
    """PIP5: one row per document: the steps it passed, its counts and a message; failures stay with their document."""
    chunks = result.chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("word_count").alias("n_words"))
    edges = result.edges.groupBy("doc_id").agg(F.count("*").alias("n_edges"))
    groups = result.communities.groupBy("doc_id").agg(F.count("*").alias("n_communities"))
    out = docs.select("doc_id")
    for frame in (chunks, edges, groups, result.skipped):
        out = out.join(frame, "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("n_chunks", "n_words", "n_edges", "n_communities")}
    return out.select(
        "doc_id", *zero.values(), F.col("n_chunks").isNotNull().alias("success"),
        F.when(F.col("n_chunks") < 2, "too few chunks for communities").otherwise(F.coalesce("reason", F.lit("ok"))).alias("message"))


@dataclass(frozen=True)
class ConceptRun:
    units: DataFrame
    optimized: DataFrame
    revision: DataFrame


def concept_flow(labels: DataFrame, responses: DataFrame | None = None) -> ConceptRun:
    """PIP6: labels -> units -> reading time -> split and bin -> merged units -> revision unit.

    ``responses(doc_id, concept_order, reading_min, complexity, load)`` win over the rule-based time.
    Whole units bin in document order.  An over-long unit is a bin of its own; it is then halved, and its
    parts stay apart.  Bins and parts are numbered in document order.
    """
    units = concepts.reading_time(concepts.concept_units(concepts.concept_groups(labels)))
    if responses is None:
        timed = units.withColumn("complexity", F.lit(0.5)).withColumn("load", F.lit("medium"))
    else:
        r = responses.select("doc_id", "concept_order", F.col("reading_min").alias("_m"), "complexity", "load")
        timed = units.join(r, ["doc_id", "concept_order"], "left").withColumn("reading_min", F.coalesce("_m", "reading_min")).withColumn(
            "complexity", F.coalesce("complexity", F.lit(0.5))).withColumn("load", F.coalesce("load", F.lit("medium"))).drop("_m")
    timed = cut(timed)
    words = F.col("word_count") / F.size("chunk_orders")
    bins = cut(concepts.bin_by_time(timed.select("doc_id", "concept_order", "reading_min")).drop("reading_min"))
    parts = concepts.split_long(timed.select("doc_id", "concept_order", "reading_min", "chunk_orders", "chunk_labels"))
    rest = timed.select("doc_id", "concept_order", "title", "labels", "complexity", "load", words.alias("_w"))
    pieces = parts.join(rest, ["doc_id", "concept_order"]).join(bins, ["doc_id", "concept_order"])
    # a unit that needs no split is one part, so (bin, part) orders bins and the parts of split units alike
    at = F.dense_rank().over(W.partitionBy("doc_id").orderBy("bin_order", "part"))
    pieces = cut(pieces.select(
        "doc_id", "concept_order", at.cast("long").alias("bin_order"), "title", "labels", "complexity", "load",
        F.round(F.col("_w") * F.size("chunk_orders")).cast("long").alias("word_count"), "reading_min", "chunk_orders"))
    optimized = concepts.merge_units(pieces)
    keyed = optimized.select("doc_id", F.col("bin_order").alias("concept_order"), "labels", F.array().cast("array<string>").alias("keywords"))
    return ConceptRun(timed, optimized, concepts.related_prior(keyed))
