"""Connected components and communities (COM1-COM5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import Parts, cut


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """COM2: (node, component) with component the smallest node of each connected component.

    ``edges(src, dst)``, ``nodes(node)``.  Every round takes the smallest label among neighbours (an
    aggregate with map-side combine, so a hub costs one row per task) and then jumps to the label of
    the label, which halves chains.  Each round is cut by a checkpoint; it ends when nothing changes.
    """
    return _labelled(cut(edges.select("src", "dst").where("src <> dst")), nodes)


def _labelled(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rounds of ``components`` over ``links(src, dst)``, a written table without loops."""
    both = links.union(links.select("dst", "src"))        # read both ways, written once
    labels = both.groupBy("src").agg(F.least("src", F.min("dst")).alias("component")).withColumnRenamed("src", "node")
    labels = cut(labels)
    while True:
        near = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("component").alias("m"))
        lowered = labels.join(near.withColumnRenamed("src", "node"), "node", "left").select(
            "node", "component", F.least("component", F.coalesce("m", "component")).alias("low")
        )
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("lower"))
        moved = lowered.join(jump, "low", "left").select(
            "node", F.least("low", F.coalesce("lower", "low")).alias("component"),
            (F.least("low", F.coalesce("lower", "low")) < F.col("component")).alias("changed"),
        )
        moved = cut(moved)
        labels = moved.drop("changed")
        if moved.where("changed").isEmpty():
            break
    return nodes.select("node").distinct().join(labels, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def modularity_communities(edges: DataFrame, nodes: DataFrame, graph_key: str = "doc_id") -> DataFrame:
    """COM1: (graph_key, node, community) by greedy modularity of every graph at the same time.

    ``edges(graph_key, i, j)`` unweighted, ``nodes(graph_key, node)``.  A community is named by its smallest node.  Merging
    two communities gains 2m * E(u, v) - K(u) * K(v), an integer, so gains compare exactly; ties go to the pair with the
    smallest names.  In a round every community takes its best neighbour, and all pairs that chose each other merge at
    once: they share no community, and the best pair of a graph is always among them.  A graph is done when no merge gains.
    A link carries the degrees of its ends, so a round is one aggregate for the choice and one for the merged links,
    whatever the size of a graph; the rows of a large graph spread over its communities.
    """
    plain = edges.select(F.col(graph_key).alias("g"), F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b")).where("a < b").distinct()
    both = cut(plain.unionByName(plain.select("g", F.col("b").alias("a"), F.col("a").alias("b"))))
    doubled = both.groupBy("g").agg(F.count("*").alias("m2"))
    degree = both.groupBy("g", "a").agg(F.count("*").alias("k"))
    links = cut(
        both.join(doubled, "g").join(degree.withColumnRenamed("k", "ka"), ["g", "a"])
        .join(degree.select("g", F.col("a").alias("b"), F.col("k").alias("kb")), ["g", "b"]).withColumn("e", F.lit(1).cast("long"))
    )
    merges = Parts(edges.sparkSession)
    while True:
        gain = F.col("m2") * F.col("e") - F.col("ka") * F.col("kb")
        choice = F.max(F.struct(gain.alias("gain"), -F.least("a", "b"), -F.greatest("a", "b"), "b", (F.col("ka") + F.col("kb")).alias("k"))).alias("c")
        best = cut(links.where(gain > 0).groupBy("g", "a").agg(choice).select("g", "a", "c.b", "c.k"))
        mutual = best.where("a < b").join(best.select("g", F.col("b").alias("a"), F.col("a").alias("b")), ["g", "a", "b"])
        merged = merges.add(mutual)
        if merged.isEmpty():
            break
        moved = merged.select("g", F.explode(F.array("a", "b")).alias("c"), F.col("a").alias("to"), "k")
        going = links.join(merged.select("g").distinct(), "g", "left_semi")
        for end in ("a", "b"):
            step = moved.select("g", F.col("c").alias(end), F.col("to").alias("_to"), F.col("k").alias("_k"))
            going = going.join(step, ["g", end], "left").withColumn(end, F.coalesce("_to", end)).withColumn(f"k{end}", F.coalesce("_k", f"k{end}")).drop("_to", "_k")
        links = cut(going.where("a <> b").groupBy("g", "a", "b").agg(F.sum("e").alias("e"), *[F.max(c).alias(c) for c in ("m2", "ka", "kb")]))
    label = _last_names(merges.table().select("g", F.col("b").alias("node"), F.col("a").alias("community")))
    out = nodes.select(F.col(graph_key).alias("g"), "node").distinct().join(label, ["g", "node"], "left")
    return out.select(F.col("g").alias(graph_key), "node", F.coalesce("community", "node").alias("community"))


def _last_names(parent: DataFrame) -> DataFrame:
    """``parent(g, node, community)`` with the end of each node's chain; every round doubles the step."""
    now = cut(parent)
    while True:
        further = now.select("g", F.col("node").alias("community"), F.col("community").alias("_next"))
        step = cut(now.join(further, ["g", "community"], "left"))
        now = step.select("g", "node", F.coalesce("_next", "community").alias("community"))
        if step.where("_next is not null").isEmpty():
            return now


def community_chunks(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """COM3: communities with their ordered chunks, numbered by word count (largest first, then first chunk).

    ``members(doc_id, node, community)``, ``chunks(doc_id, chunk_order, chunk_text, word_count)``.  All
    chunks of a document come from one text cell, so the arrays are bounded by it.  A document with
    fewer than two chunks is one community.
    """
    joined = chunks.select("doc_id", "chunk_order", "chunk_text", "word_count").join(
        members.select("doc_id", F.col("node").alias("chunk_order"), "community"), ["doc_id", "chunk_order"], "left"
    ).withColumn("community", F.coalesce("community", "chunk_order"))
    grouped = joined.groupBy("doc_id", "community").agg(
        F.count("*").alias("n_chunks"), F.sum("word_count").alias("word_count"),
        F.array_sort(F.collect_list(F.struct("chunk_order", "chunk_text", F.col("word_count").alias("n_words")))).alias("chunks"),
    )
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("word_count"), "community"))
    return grouped.withColumn("community_id", (place - 1).cast("long")).select(
        "doc_id", "community_id", "community", "n_chunks", "word_count", "chunks",
        F.transform("chunks", lambda c: c["chunk_order"]).alias("chunk_ids"),
        F.array_join(F.transform("chunks", lambda c: c["chunk_text"]), "\n\n").alias("combined_text"),
    )


def community_stats(members: DataFrame, edges: DataFrame, method: str, tau: float, graph_key: str = "doc_id") -> DataFrame:
    """COM4: run metadata over all graphs."""
    sizes = members.groupBy(graph_key, "community").agg(F.count("*").alias("size"))
    a = sizes.agg(F.count("*").alias("n_communities"), F.round(F.coalesce(F.avg("size"), F.lit(0.0)), 6).alias("mean_size"), F.coalesce(F.max("size"), F.lit(0)).alias("largest"))
    b = edges.agg(F.count("*").alias("n_edges"))
    joined = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one").drop("one")
    return joined.withColumn("method", F.lit(method)).withColumn("tau", F.lit(float(tau)))


def pair_groups(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """COM5: groups from similar pairs; a node without a pair is its own group.

    Returns (group_id, n_members, n_pairs, mean_sim, max_sim); the member rows are those of ``components``.
    """
    # pairs may be all-pairs work: they are found once, for the rounds and for the totals
    links = cut(pairs.select(F.col("i").alias("src"), F.col("j").alias("dst"), "sim"))
    members = _labelled(links.select("src", "dst").where("src <> dst"), nodes)
    sizes = members.groupBy("component").agg(F.count("*").alias("n_members"))
    scored = links.join(members.withColumnRenamed("node", "src"), "src").groupBy("component").agg(
        F.count("*").alias("n_pairs"), F.avg("sim").alias("mean_sim"), F.max("sim").alias("max_sim")
    )
    return sizes.join(scored, "component", "left").select(
        F.col("component").alias("group_id"), "n_members", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "mean_sim", "max_sim"
    )
