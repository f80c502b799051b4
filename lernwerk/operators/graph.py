"""Knowledge graph: edges, metrics, study orders, path scores (GRF1-GRF17).

Edges are rows (src, dst, rel_type, confidence, similarity, strength).  Iterative operators run
DataFrame rounds that are cut by checkpoints and stop with an error, never with a partial answer.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import Parts, cut
from .communities import _labelled, components
from .ranking import SMALL, global_rank

# Symmetric relation types and difficulty ranks.
SYMMETRIC_TYPES = ("related", "compares_with")
DIFFICULTY_RANK = {"beginner": 1, "intermediate": 2, "advanced": 3}
DEFAULT_SECONDS = 420


def difficulty_rank(c: Column) -> Column:
    out = F
    for name, rank in DIFFICULTY_RANK.items():
        out = out.when(c == name, F.lit(rank))
    return out.otherwise(F.lit(2))


# --- edges ------------------------------------------------------------------------------------

def type_edges(pairs: DataFrame) -> DataFrame:
    """GRF1: typed edges from (i, j, sim)."""
    s = F.col("sim")
    return pairs.select(
        F.col("i").alias("src"), F.col("j").alias("dst"),
        F.when((s >= 0.80) & (s < 0.90), "builds_on").otherwise("related").alias("rel_type"),
        F.when(s >= 0.90, F.least(s, F.lit(0.95))).when(s >= 0.80, s * 0.9).otherwise(s * 0.8).alias("confidence"),
        s.alias("similarity"),
    )


def edge_strength(confidence: Column, similarity: Column) -> Column:
    """GRF2."""
    return confidence * 0.7 + similarity * 0.3


def upsert_edges(existing: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """GRF3: (all edges, created edges).  Known (src, dst, rel_type) keys are kept as they are;
    symmetric types also get the reverse edge.  Re-running creates nothing."""
    keys = ["src", "dst", "rel_type"]
    wanted = new.select(*keys, "confidence", "similarity").withColumn("strength", edge_strength(F.col("confidence"), F.col("similarity")))
    # an edge and its reverse meet under the same two ends, so the reverse is made after the shuffle and the known keys go along
    value = F.struct((-F.col("strength")).alias("n"), "confidence", "similarity", "strength")
    ahead = F.coalesce(F.col("src") <= F.col("dst"), F.lit(False))
    ends = [F.when(ahead, F.col("src")).otherwise(F.col("dst")).alias("lo"), F.when(ahead, F.col("dst")).otherwise(F.col("src")).alias("hi"), "rel_type", ahead.alias("ahead")]
    sent = wanted.select(*ends, value.alias("e"), F.lit(False).alias("known"))
    have = existing.select(*ends, F.lit(None).cast(sent.schema["e"].dataType).alias("e"), F.lit(True).alias("known"))
    met = sent.unionByName(have).groupBy("lo", "hi", "rel_type").agg(
        # the choice among equals is fixed by value
        F.min(F.when(F.col("ahead"), F.col("e"))).alias("on"), F.min(F.when(~F.col("ahead"), F.col("e"))).alias("back"),
        F.bool_or(F.col("known") & F.col("ahead")).alias("known_on"), F.bool_or(F.col("known") & ~F.col("ahead")).alias("known_back"))
    both_ways = F.col("rel_type").isin(list(SYMMETRIC_TYPES))

    def one(src: str, dst: str, given: str, mirrored: str, known: str) -> Column:
        # a given edge wins over a mirrored one
        edge = F.coalesce(F.col(given), F.when(both_ways, F.col(mirrored)))
        return F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.when(~F.col(known), edge).alias("e"))

    loop = F.col("lo").eqNullSafe(F.col("hi"))
    pair = F.array(one("lo", "hi", "on", "back", "known_on"), F.when(~loop, one("hi", "lo", "back", "on", "known_back")))
    created = met.select("rel_type", F.explode(pair).alias("d")).where(F.col("d.e").isNotNull()).select(
        "d.src", "d.dst", "rel_type", "d.e.confidence", "d.e.similarity", "d.e.strength")
    return existing.select(*keys, "confidence", "similarity", "strength").unionByName(created), created


def rebuild(existing: DataFrame, new: DataFrame, blocks: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """GRF4: replace all edges, or those leaving the blocks of ``docs(doc_id)``, by ``new``."""
    if docs is None:
        return upsert_edges(existing.limit(0), new)[0]
    scope = blocks.join(docs.select("doc_id"), "doc_id", "left_semi").select(F.col("block_id").alias("src"))
    return upsert_edges(existing.join(scope, "src", "left_anti"), new)[0]


def drop_weak(edges: DataFrame, min_conf: float = 0.3) -> DataFrame:
    """GRF5."""
    return edges.where(F.col("confidence") >= min_conf)


def fallback_edges(pairs: DataFrame, n: int = 5, tau: float = 0.3) -> DataFrame:
    """GRF6: the first ``n`` similar pairs in (i, j) order as related edges."""
    return pairs.where(F.col("sim") >= tau).orderBy("i", "j").limit(n).select(
        F.col("i").alias("src"), F.col("j").alias("dst"), F.lit("related").alias("rel_type"),
        F.col("sim").alias("confidence"), F.col("sim").alias("similarity"),
    )


#: Edges that a task counts triangles of, about, and the wedges it holds at once.
GROUP = 6_000_000
STRETCH = 1_000_000


# --- metrics ----------------------------------------------------------------------------------

def _simple(edges: DataFrame) -> DataFrame:
    """Distinct directed pairs; parallel edges of different types collapse."""
    return edges.select("src", "dst").distinct()


def mean_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row with mean_clustering of the undirected graph.

    Every edge points from the end with the lower (degree, id), so a hub that touches a third of all edges has few outgoing
    ones.  Nodes are dealt to colours, and a task gets the edges between three of them, about GROUP; it forms the
    wedges it needs itself, a stretch at a time, so none is shuffled.  An edge is sent once per colour.
    """
    plain = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct())
    ends = plain.select(F.col("a").alias("node")).union(plain.select(F.col("b").alias("node")))
    degree = ends.groupBy("node").agg(F.count("*").alias("d"))
    da, db = degree.toDF("a", "da"), degree.toDF("b", "db")
    directed = plain.join(da, "a").join(db, "b").select(
        F.when((F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b"))), F.struct(F.col("a").alias("u"), F.col("b").alias("v")))
        .otherwise(F.struct(F.col("b").alias("u"), F.col("a").alias("v"))).alias("e")
    ).select("e.u", "e.v")
    k = max(1, math.ceil(math.sqrt(9 * plain.count() / GROUP)))
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    third = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_c")
    sent = directed.select("u", "v", colour("u").alias("cu"), colour("v").alias("cv"), third)
    low, top = F.least("cu", "cv", "_c"), F.greatest("cu", "cv", "_c")
    mid = F.col("cu") + F.col("cv") + F.col("_c") - low - top
    keyed = sent.select("u", "v", "cu", "cv", ((low * k + mid) * k + top).alias("three"))
    kind = nodes.schema["node"].dataType.simpleString()
    corners = keyed.groupBy("three").applyInPandas(lambda pdf: _corners(pdf, k), f"node {kind}, t long").groupBy("node").agg(F.sum("t").alias("t"))
    share = degree.join(corners, "node", "left").select(
        F.when(F.col("d") > 1, 2.0 * F.coalesce("t", F.lit(0)) / (F.col("d") * (F.col("d") - 1))).otherwise(0.0).alias("c")
    )
    total = share.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("s"), F.lit(1).alias("one"))
    return total.join(nodes.agg(F.count("*").alias("n"), F.lit(1).alias("one")), "one").select(
        F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("mean_clustering")
    )


def _corners(pdf: pd.DataFrame, k: int) -> pd.DataFrame:
    """(node, t): the triangles at each node whose three colours of ``k`` are those of the task, of edges (u, v, cu, cv, three)."""
    ids = pd.Index(pd.unique(pd.concat([pdf["u"], pdf["v"]])))
    u, v = ids.get_indexer(pdf["u"]), ids.get_indexer(pdf["v"])
    colour = np.empty(len(ids), np.int64)
    colour[u], colour[v] = pdf["cu"], pdf["cv"]
    three, n = pdf["three"].iloc[0], len(ids)
    keys = np.sort(u * n + v)
    u, v = keys // n, keys % n
    first, t = np.searchsorted(u, np.arange(n + 1)), np.zeros(n, np.int64)
    sizes = (first[1:] - first[:-1])[v]                 # u -> v -> w, for every w
    ends, at = np.cumsum(sizes), 0
    while at < len(u):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + STRETCH, "right")))
        count = sizes[at:to]
        a, b = np.repeat(u[at:to], count), np.repeat(v[at:to], count)
        w = v[np.repeat(first[v[at:to]] - np.cumsum(count) + count, count) + np.arange(count.sum())]
        wanted = a * n + w
        met = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
        a, b, w = a[met], b[met], w[met]
        low, mid, top = np.sort(colour[np.stack([a, b, w])], axis=0)
        mine = (low * k + mid) * k + top == three
        for corner in (a, b, w):
            t += np.bincount(corner[mine], minlength=n)
        at = to
    some = t > 0
    return pd.DataFrame({"node": ids[some], "t": t[some]})


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF7: nodes, edges, density, weak components, whether acyclic, mean clustering; one row."""
    one = F.lit(1).alias("one")
    pairs = cut(_simple(edges))
    n = nodes.agg(F.count_distinct("node").alias("n_nodes"), one)
    m = pairs.agg(F.count("*").alias("n_edges"), one)
    wcc = _labelled(pairs.where("src <> dst"), nodes).agg(F.count_distinct("component").alias("n_weak_components"), one)
    inside = pairs.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    placed = depths(nodes.select("node").distinct(), inside).agg(F.count("*").alias("placed"), one)
    clustering = mean_clustering(nodes, pairs).withColumn("one", F.lit(1))
    joined = n.join(m, "one").join(wcc, "one").join(placed, "one").join(clustering, "one")
    return joined.select(
        "n_nodes", "n_edges",
        F.when(F.col("n_nodes") > 1, F.col("n_edges") / (F.col("n_nodes") * (F.col("n_nodes") - 1))).otherwise(0.0).alias("density"),
        "n_weak_components", (F.col("placed") == F.col("n_nodes")).alias("is_dag"), "mean_clustering",
    )


def scc(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF8: (node, scc) with scc the largest node of each strongly connected component.

    Rounds of trimming (a node without an incoming or outgoing edge is its own component), then
    forward colouring by the largest reaching node and a backward walk from every colour's root inside
    its colour.  Each round settles at least one component per colour.
    """
    left = cut(nodes.select("node").distinct())
    live = cut(_simple(edges).where("src <> dst"))
    done = Parts(nodes.sparkSession)
    while True:
        # trim until stable
        while True:
            inner = left.join(live.select(F.col("dst").alias("node")).distinct(), "node", "left_semi").join(
                live.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
            inner = cut(inner)
            if done.add(left.join(inner, "node", "left_anti").select("node", F.col("node").alias("scc"))).isEmpty():
                break
            left = inner
            live = cut(live.join(inner.toDF("src"), "src", "left_semi").join(inner.toDF("dst"), "dst", "left_semi"))
        if left.isEmpty():
            break
        colour = cut(left.select("node", F.col("node").alias("c")))
        while True:
            push = live.join(colour.toDF("src", "cs"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("cs").alias("m"))
            nxt = cut(colour.join(push, "node", "left").select(
                "node", F.greatest("c", F.coalesce("m", "c")).alias("c"), (F.coalesce("m", "c") > F.col("c")).alias("up")))
            colour = nxt.select("node", "c")
            if nxt.where("up").isEmpty():
                break
        same = cut(
            live.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst")
        )
        reached = cut(colour.where("node = c"))
        frontier = reached
        while True:
            back = same.join(frontier.toDF("dst", "c"), "dst").select(F.col("src").alias("node"), "c").distinct()
            frontier = cut(back.join(reached, "node", "left_anti"))
            if frontier.isEmpty():
                break
            reached = cut(reached.unionByName(frontier))
        done.add(reached.select("node", F.col("c").alias("scc")))
        left = cut(left.join(reached, "node", "left_anti"))
        live = cut(live.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi"))
    return done.table()


# --- orders -----------------------------------------------------------------------------------

#: Chains are contracted in every so many rounds.
CONTRACT = 4
#: Edges that one task may walk by itself.
LOCAL = 2_000_000


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer): the length of the longest path that ends in each node; nodes in or behind cycles are left out.

    ``nodes(node)`` distinct, ``edges(src, dst)`` between them, written; parallel edges count as one.  Every round settles the
    nodes without an open predecessor, and one task walks on from them through the nodes with the fewest open
    predecessors, as many as LOCAL edges allow.  Edges are read where they lie: a round writes rows per node.  So the rounds
    follow the edges over LOCAL, not the layers.  Where a walk hardly settles anything, what is left goes to ``_contracted``.
    """
    spark, zero = nodes.sparkSession, F.lit(0).cast("long")
    degree = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open"))
    state = cut(nodes.join(degree, "node", "left").select("node", F.coalesce("open", zero).alias("open"), zero.alias("w")))
    found = Parts(spark)
    while True:
        free = state.where("open = 0")
        if free.isEmpty():
            break
        near = state.where((F.col("open") > 0) & (F.col("open") <= LOCAL)).orderBy("open", "node").limit(SMALL)
        near = near.withColumn("_sum", F.sum("open").over(W.orderBy("open", "node"))).where(F.col("_sum") <= LOCAL).drop("_sum")
        part = cut(free.unionByName(near))
        asked = part.where("open > 0")
        met = edges.join(asked.select(F.col("node").alias("dst")), "dst").join(part.toDF("src", "_open", "_w"), "src")
        known = met.where("_open = 0").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("_n"), (F.max("_w") + 1).alias("_far"))
        start = asked.join(known, "node", "left").select(
            "node", F.col("node").alias("up"), F.lit(True).alias("own"), (F.col("open") - F.coalesce("_n", zero)).alias("open"), F.greatest("w", F.coalesce("_far", zero)).alias("w"))
        links = met.where("_open > 0").select(F.col("dst").alias("node"), F.col("src").alias("up"), F.lit(False).alias("own"), zero.alias("open"), zero.alias("w"))
        kind = nodes.schema["node"].dataType.simpleString()
        walked = start.unionByName(links).groupBy().applyInPandas(_walk, f"node {kind}, w long")
        done = found.add(free.select("node", "w").unionByName(walked))
        spent = edges.join(done.toDF("src", "_w"), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("_n"), (F.max("_w") + 1).alias("_far"))
        state = cut(state.join(done.select("node"), "node", "left_anti").join(spent, "node", "left").select(
            "node", (F.col("open") - F.coalesce("_n", zero)).alias("open"), F.greatest("w", F.coalesce("_far", zero)).alias("w")))
        n = asked.count()
        if n == SMALL and 20 * asked.join(done, "node", "left_semi").count() < n:
            break
    settled = found.table()
    if settled is None:
        return nodes.select("node", zero.alias("layer")).limit(0)
    out = settled.select("node", F.col("w").alias("layer"))
    return out if state.where("open = 0").isEmpty() else out.unionByName(_contracted(state, edges))


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, w) of the nodes that a walk over (node, up, own, open, w) settles; a node's own row tells its open predecessors."""
    own, links = pdf[pdf["own"]], pdf[~pdf["own"]]
    index = pd.Index(own["node"])
    src, dst = index.get_indexer(links["up"]), index.get_indexer(links["node"])
    by = np.argsort(src, kind="stable")
    dst, first = dst[by], np.searchsorted(src[by], np.arange(len(own) + 1))
    open_, far = own["open"].to_numpy().copy(), own["w"].to_numpy().copy()
    done = now = np.flatnonzero(open_ == 0)
    while len(now):
        counts = first[now + 1] - first[now]
        at = np.repeat(first[now] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        np.subtract.at(open_, dst[at], 1)
        np.maximum.at(far, dst[at], np.repeat(far[now] + 1, counts))
        reached = np.unique(dst[at])
        now = reached[open_[reached] == 0]
        done = np.concatenate([done, now])
    return pd.DataFrame({"node": index[done], "w": far[done]})


def _contracted(state: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, layer) of the nodes of ``state(node, open, w)`` outside cycles, w being the longest path to them so far.

    A node with one open predecessor hangs on it at a known distance; such chains are contracted by pointer doubling, a node
    whose predecessors are all known hangs on the start (null), and parallel edges that contraction leaves keep the
    longest.  Every round settles the nodes whose predecessors are all known, every CONTRACT-th one all chains too,
    however long: the rounds follow the junctions on a path, not its nodes.
    """
    kind = dict(edges.dtypes)["src"]
    inside = edges.select("src", "dst").join(state.select(F.col("node").alias("src")), "src", "left_semi").join(state.select(F.col("node").alias("dst")), "dst", "left_semi")
    start = state.where("open = 0 or w > 0").select(F.lit(None).cast(kind).alias("src"), F.col("node").alias("dst"), "w")
    open_ = cut(inside.distinct().withColumn("w", F.lit(1).cast("long")).unionByName(start))
    hung, nth = Parts(edges.sparkSession), 0
    while True:
        contract = nth % CONTRACT == 0
        single = open_.groupBy("dst").agg(F.count("*").alias("n"), F.first("src").alias("head"), F.first("w").alias("w"))
        single = single.where("n = 1" if contract else "n = 1 and head is null")
        settled = hung.add(single.select(F.col("dst").alias("node"), "head", "w"))
        if settled.isEmpty():
            if contract:
                break
            nth += -nth % CONTRACT
            continue
        nth += 1
        settled = _hang(settled) if contract else settled
        known = settled.select(F.col("node").alias("src"), F.col("head").alias("_head"), F.col("w").alias("_w"))
        rest = open_.join(settled.select(F.col("node").alias("dst")), "dst", "left_anti").join(known, "src", "left")
        moved = rest.select(F.when(F.col("_w").isNull(), F.col("src")).otherwise(F.col("_head")).alias("src"), "dst", (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"))
        open_ = cut(moved.groupBy("src", "dst").agg(F.max("w").alias("w")))
    return _hang(hung.table()).where("head is null").select("node", F.col("w").alias("layer"))


def _hang(table: DataFrame) -> DataFrame:
    """``table(node, head, w)`` with the end of each chain of heads and the distance from it; chains that run into a cycle stay open."""
    left = None
    while left is None or left > 0:
        step = table.select(F.col("node").alias("head"), F.col("head").alias("_next"), F.col("w").alias("_w"))
        joined = table.join(step, "head", "left")
        if joined.where("_w is not null").isEmpty():
            break
        left = table.count().bit_length() if left is None else left - 1
        table = cut(joined.select("node", F.when(F.col("_w").isNull(), F.col("head")).otherwise(F.col("_next")).alias("head"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w")))
    return table


def topo_order(nodes: DataFrame, edges: DataFrame, append_cycles: bool = True, leftover: list[Column] | None = None) -> DataFrame:
    """GRF9: (node, pos, layer) in the order of a first-in-first-out topological sort.

    ``nodes(node, base, ...)``: base breaks ties.  A node's layer is its depth (see ``depths``); inside a layer it sorts by the
    place of its last predecessor, then by base.  Nodes in or behind cycles follow in ``leftover`` order (base by default)
    with layer null.  Layers follow each other, so consecutive ones are sorted by one task as long as they have no
    more than SMALL rows, and a layer with more is sorted over all tasks: the rounds are the rows over SMALL.
    """
    base = nodes.dropDuplicates(["node"])
    known = base.select("node")
    live = cut(edges.select("src", "dst").join(known.toDF("src"), "src", "left_semi").join(known.toDF("dst"), "dst", "left_semi"))
    layered = cut(base.join(depths(known, live), "node").select("node", "base", "layer"))
    above = layered.select(F.col("node").alias("src"), (F.col("layer") + 1).alias("layer"))
    steps = live.join(above, "src").join(layered.select(F.col("node").alias("dst"), "layer"), ["dst", "layer"])
    rows = cut(layered.join(steps.select(F.col("dst").alias("node"), F.col("src").alias("up")).distinct(), "node", "left"))
    ranked = global_rank(rows.select("layer", "node"), [F.col("layer"), F.col("node")], "at")
    starts = ranked.groupBy("layer").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    batch = (F.floor(F.col("start") / SMALL) * 2 + (F.col("n") > SMALL).cast("long")).alias("batch")
    rows = cut(rows.join(starts.select("layer", batch), "layer").repartitionByRange("batch", "node"))
    batches = rows.groupBy("batch").agg(F.count_distinct("node").alias("n"), F.max("layer").alias("last")).orderBy("batch").collect()
    order, offset, last = Parts(nodes.sparkSession), 0, None
    kind = layered.schema["node"].dataType.simpleString()
    for group in batches:
        here = rows.where(F.col("batch") == group["batch"])
        before = here.withColumn("after", F.lit(None)) if last is None else here.join(last.select(F.col("node").alias("up"), F.col("pos").alias("after")), "up", "left")
        here = before.select("node", "base", "layer", F.coalesce("up", "node").alias("up"), F.col("up").isNotNull().alias("has"), F.coalesce("after", F.lit(-1)).cast("long").alias("after"))
        if group["batch"] % 2:
            one = here.groupBy("node").agg(F.first("base").alias("base"), F.first("layer").alias("layer"), F.max("after").alias("after"))
            placed = global_rank(one, [F.col("after"), F.col("base"), F.col("node")], "rank", group["n"])
        else:
            placed = here.groupBy().applyInPandas(_placed, f"node {kind}, rank long, layer long")
        done = order.add(placed.select("node", (F.col("rank") + offset).alias("pos"), "layer"))
        offset += group["n"]
        last = done.where(F.col("layer") == group["last"])
    if append_cycles:
        tail = base.join(layered.select("node"), "node", "left_anti")
        by = leftover or [F.col("base")]
        placed = global_rank(tail, [*by, F.col("node")], "rank").select("node", (F.col("rank") + offset).alias("pos"), F.lit(None).cast("long").alias("layer"))
        order.add(placed)
    out = order.table()
    return base.select("node", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("layer")).limit(0) if out is None else out


def _placed(pdf: pd.DataFrame) -> pd.DataFrame:
    """(node, rank, layer) of whole layers: by layer, the last place of (node, up) before, then base and node."""
    own = pdf.drop_duplicates("node").sort_values(["layer", "base", "node"], na_position="first")
    index, layer = pd.Index(own["node"]), own["layer"].to_numpy()
    after = pdf.groupby("node")["after"].max().reindex(index).to_numpy().copy()
    links = pdf[pdf["has"]]
    up, node = index.get_indexer(links["up"]), index.get_indexer(links["node"])
    by = np.flatnonzero(up >= 0)
    by = by[np.argsort(node[by], kind="stable")]
    up, node, rank = up[by], node[by], np.empty(len(own), np.int64)
    ends = np.flatnonzero(np.append(layer[1:] != layer[:-1], True)) + 1
    for start, end in zip(np.append(0, ends[:-1]), ends):
        lo, hi = np.searchsorted(node, [start, end])
        np.maximum.at(after, node[lo:hi], rank[up[lo:hi]])
        rank[start + np.argsort(after[start:end], kind="stable")] = np.arange(start, end)
    return pd.DataFrame({"node": index, "rank": rank, "layer": layer})


def study_order(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF10: prerequisite and builds_on edges (parallel edges count); leftovers by difficulty, then age."""
    nodes = blocks.select(
        F.col("block_id").alias("node"), F.col("block_id").alias("base"), difficulty_rank(F.col("difficulty")).alias("rank_d"), "created_at")
    hard = edges.where(F.col("rel_type").isin("prerequisite", "builds_on"))
    return topo_order(nodes, hard, leftover=[F.col("rank_d"), F.col("created_at")])


def difficulty_order(blocks: DataFrame) -> DataFrame:
    """GRF11: (block_id, pos, difficulty, order_in_level); by level, then age, one distributed sort."""
    known = blocks.where(F.col("difficulty").isin(list(DIFFICULTY_RANK)))
    ranked = global_rank(known, [difficulty_rank(F.col("difficulty")), F.col("created_at"), F.col("block_id")], "pos")
    first = ranked.groupBy("difficulty").agg(F.min("pos").alias("_first"))
    return ranked.join(F.broadcast(first), "difficulty").select(
        "block_id", "pos", "difficulty", (F.col("pos") - F.col("_first") + 1).alias("order_in_level"), "duration_s")


def cluster_order(blocks: DataFrame, edges: DataFrame, difficulty_sort: str = "rank") -> DataFrame:
    """GRF12: (block_id, pos, cluster): components of related edges, single blocks last, inside by difficulty and age.

    ``difficulty_sort="name"`` sorts difficulty alphabetically, as the path variant does.
    """
    nodes = blocks.select(F.col("block_id").alias("node"))
    comps = components(edges.where("rel_type = 'related'"), nodes)
    sizes = comps.groupBy("component").agg(F.count("*").alias("n"))
    by = difficulty_rank(F.col("difficulty")) if difficulty_sort == "rank" else F.col("difficulty")
    joined = blocks.join(comps.withColumnRenamed("node", "block_id"), "block_id").join(sizes, "component")
    order = [(F.col("n") == 1).cast("int"), F.col("component"), by, F.col("created_at"), F.col("block_id")]
    return global_rank(joined, order, "pos").select("block_id", "pos", F.col("component").alias("cluster"), "difficulty", "duration_s")


def path_totals(paths: DataFrame) -> DataFrame:
    """GRF13: blocks, seconds and hours per path_id."""
    return paths.groupBy("path_id").agg(F.count("*").alias("n_blocks"), F.sum("duration_s").alias("total_duration")).withColumn(
        "hours", F.col("total_duration") / 3600)


def study_paths(blocks: DataFrame, edges: DataFrame, strategy: str = "prerequisite_first") -> DataFrame:
    """GRF13: (path_id, block_id, pos, duration_s) for a strategy; unknown names take the default.

    With cycles among all edges, the default gives one path per strong component.
    """
    if strategy == "difficulty_progression":
        return difficulty_order(blocks).select(F.concat(F.lit("difficulty_"), "difficulty").alias("path_id"), "block_id", F.col("order_in_level").alias("pos"), "duration_s")
    if strategy == "concept_clusters":
        return cluster_order(blocks, edges.withColumn("rel_type", F.lit("related")), "name").select(
            F.concat(F.lit("cluster_"), F.col("cluster").cast("string")).alias("path_id"), "block_id", "pos", "duration_s")
    nodes = blocks.select(F.col("block_id").alias("node"), F.col("block_id").alias("base"))
    order = cut(topo_order(nodes, edges))
    seconds = blocks.select(F.col("block_id").alias("node"), "duration_s")
    if order.where("layer is null").isEmpty():
        return order.join(seconds, "node").select(F.lit("prerequisite_optimal").alias("path_id"), F.col("node").alias("block_id"), "pos", "duration_s")
    parts = scc(nodes.select("node"), edges)
    return parts.join(seconds, "node").join(order.select("node", "pos"), "node").select(
        F.concat(F.lit("component_"), F.col("scc").cast("string")).alias("path_id"), F.col("node").alias("block_id"), "pos", "duration_s")


def path_metrics(path: DataFrame, blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF14: one row for ``path(block_id, pos)`` (0-based, gap-free): size, minutes, days, satisfied
    prerequisites, difficulty progression and coherence in percent.  Adjacent blocks meet by a join on
    pos, so no window runs over the whole path."""
    one = F.lit(1).alias("one")
    rows = path.select("block_id", "pos").join(blocks.select("block_id", "duration_s", "difficulty"), "block_id")
    rows = rows.select("block_id", "pos", "duration_s", difficulty_rank(F.col("difficulty")).alias("d"))
    totals = rows.agg(F.count("*").alias("n"), F.sum(F.coalesce("duration_s", F.lit(DEFAULT_SECONDS))).alias("s"), one)
    ahead = rows.select((F.col("pos") - 1).alias("pos"), F.col("d").alias("dn"))
    falls = rows.join(ahead, "pos").agg(F.count_if(F.col("dn") < F.col("d")).alias("falls"), one)
    a, b = rows.select(F.col("block_id").alias("src"), F.col("pos").alias("ps")), rows.select(F.col("block_id").alias("dst"), F.col("pos").alias("pd"))
    inside = edges.select("src", "dst", "rel_type").join(a, "src").join(b, "dst")
    links = inside.agg(
        F.count_if(F.col("rel_type") == "prerequisite").alias("pre"),
        F.count_if((F.col("rel_type") == "prerequisite") & (F.col("ps") < F.col("pd"))).alias("met"),
        F.count_if(F.col("rel_type") == "related").alias("rel"),
        F.coalesce(F.sum(F.when(F.col("rel_type") == "related", F.abs(F.col("ps") - F.col("pd")))), F.lit(0)).alias("dist"), one,
    )
    j = totals.join(falls, "one").join(links, "one")
    minutes, span = F.col("s") / 60, F.col("n") - 1
    return j.select(
        F.col("n").alias("total_blocks"), minutes.alias("total_minutes"),
        F.greatest(F.lit(1).cast("long"), F.floor(minutes / 90)).alias("study_days"),
        F.when(F.col("pre") > 0, 100.0 * F.col("met") / F.col("pre")).otherwise(100.0).alias("prerequisite_satisfaction"),
        F.when(F.col("n") < 2, 100.0).otherwise(100.0 * (span - F.col("falls")) / span).alias("difficulty_progression"),
        F.when((F.col("n") < 2) | (F.col("rel") == 0), 100.0).otherwise(
            100.0 * (F.col("rel") * span - F.col("dist")) / span / F.col("rel")).alias("concept_coherence"),
    )


def adaptive_path(blocks: DataFrame, known: DataFrame, edges: DataFrame, style: str = "comprehensive") -> DataFrame:
    """GRF15: (block_id, pos) over the blocks not in ``known(block_id)``; depth_first follows clusters."""
    unknown = blocks.join(known.select("block_id"), "block_id", "left_anti")
    if style == "depth_first":
        inside = unknown.select(F.col("block_id"))
        kept = edges.join(inside.toDF("src"), "src", "left_semi").join(inside.toDF("dst"), "dst", "left_semi")
        return cluster_order(unknown, kept).select("block_id", "pos")
    return study_order(unknown, edges).select(F.col("node").alias("block_id"), "pos")


def graph_view_nodes(blocks: DataFrame) -> DataFrame:
    """GRF16: node table of ``blocks(block_id, title, difficulty, duration_s, segments)``: segment roles,
    category, and the two clamped node sizes (by roles and by duration)."""
    roles = F.transform("segments", lambda s: F.coalesce(s["type"], F.lit("unknown")))
    n = F.size("roles")
    category = F.when(F.col("difficulty") == "beginner", "foundational").when(F.col("difficulty") == "advanced", "advanced").otherwise("intermediate")
    return blocks.withColumn("roles", roles).select(
        "block_id", "title", category.alias("category"), F.array_join("roles", ",").alias("roles"),
        F.greatest(n, F.lit(1)).cast("long").alias("chunk_count"),
        F.coalesce("duration_s", F.lit(DEFAULT_SECONDS)).cast("long").alias("estimated_duration"),
        F.when(n > 0, F.greatest(F.lit(20), F.least(F.lit(60), n * 10))).otherwise(30).cast("long").alias("size_by_roles"),
        F.greatest(F.lit(20.0), F.least(F.lit(50.0), F.col("duration_s") / 10)).alias("size_by_duration"),
    )


def graph_view_edges(edges: DataFrame) -> DataFrame:
    """GRF16: edge table with width max(1, 5 * strength) and the strong flag."""
    return edges.select(
        "src", "dst", "rel_type", F.greatest(F.lit(1.0), F.col("strength") * 5).alias("width"), (F.col("strength") > 0.7).alias("strong"))


def graph_view_totals(edges: DataFrame) -> DataFrame:
    """GRF16: per relation type the edges, the strong ones and the mean confidence."""
    return edges.groupBy("rel_type").agg(
        F.count("*").alias("n_edges"), F.count_if(F.col("strength") > 0.7).alias("n_strong"), F.avg("confidence").alias("mean_confidence"))


def neighbours(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """GRF17: (block_id, neighbour, rel_type, direction) for the blocks of ``ids(block_id)``.

    Two equi-joins instead of one disjunction, so both use the edge key."""
    out = edges.join(ids.select(F.col("block_id").alias("src")), "src").select(
        F.col("src").alias("block_id"), F.col("dst").alias("neighbour"), "rel_type", F.lit("out").alias("direction"))
    back = edges.join(ids.select(F.col("block_id").alias("dst")), "dst").select(
        F.col("dst").alias("block_id"), F.col("src").alias("neighbour"), "rel_type", F.lit("in").alias("direction"))
    return out.unionByName(back)
