import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from lernwerk.operators import graph as gr, ranking as rk


def kahn(nodes, edges):
    degree = {n: 0 for n in nodes}
    after = {n: [] for n in nodes}
    for a, b in edges:
        degree[b] += 1
        after[a].append(b)
    queue, out = deque(n for n in nodes if not degree[n]), []
    while queue:
        n = queue.popleft()
        out.append(n)
        for other in nodes:
            if other in after[n]:
                degree[other] -= 1
                if not degree[other]:
                    queue.append(other)
    return out + [n for n in nodes if n not in out]


@pytest.mark.parametrize("cyclic", [False, True])
def test_topo_order_equals_queue(spark, cyclic):
    rng = random.Random(6)
    for trial in range(2):
        nodes = list(range(25))
        edges = {(a, b) for a in nodes for b in nodes if a < b and rng.random() < 0.08}
        if cyclic:
            edges |= {(b, a) for a, b in edges if rng.random() < 0.1}
        n = spark.createDataFrame([(x, x) for x in nodes], "node long, base long")
        got = gr.topo_order(n, spark.createDataFrame(sorted(edges), "src long, dst long")).orderBy("pos").collect()
        assert [r["node"] for r in got] == kahn(nodes, edges)
        assert [r["pos"] for r in got] == nodes


def test_strong_components(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 7), (8, 8), (5, 9)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 11)], "node long")
    got = {r["node"]: r["scc"] for r in gr.scc(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {1: 3, 2: 3, 3: 3, 4: 5, 5: 5, 6: 6, 7: 7, 8: 8, 9: 9, 10: 10}


def test_global_rank_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(rk, "SMALL", 50)
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"))
    got = rk.global_rank(df, [F.col("x")], "r").collect()
    assert all(r["x"] == r["r"] for r in got) and len(got) == 1000


def test_upsert_is_idempotent(spark):
    schema = "src long, dst long, rel_type string, confidence double, similarity double"
    new = spark.createDataFrame([(1, 2, "related", 0.8, 0.9), (2, 3, "builds_on", 0.7, 0.8), (2, 1, "related", 0.5, 0.5)], schema)
    empty = spark.createDataFrame([], schema + ", strength double")
    edges, created = gr.upsert_edges(empty, new)
    assert sorted((r["src"], r["dst"], r["rel_type"], r["confidence"]) for r in created.collect()) == [(1, 2, "related", 0.8), (2, 1, "related", 0.5), (2, 3, "builds_on", 0.7)]
    again, more = gr.upsert_edges(edges, new)
    assert more.count() == 0 and again.count() == 3


def test_clustering(spark):
    nodes = spark.createDataFrame([(i,) for i in range(5)], "node long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 0), (2, 3), (3, 2)], "src long, dst long")
    got = gr.mean_clustering(nodes, edges).first()["mean_clustering"]
    assert abs(got - (1 + 1 + 1 / 3) / 5) < 1e-12


def test_path_metrics(spark):
    blocks = spark.createDataFrame([(1, 600, "beginner"), (2, 600, "advanced"), (3, 600, "intermediate")], "block_id long, duration_s long, difficulty string")
    path = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "block_id long, pos long")
    edges = spark.createDataFrame([(1, 2, "prerequisite"), (3, 2, "prerequisite"), (1, 3, "related")], "src long, dst long, rel_type string")
    m = gr.path_metrics(path, blocks, edges).first()
    assert (m["total_blocks"], m["total_minutes"], m["study_days"]) == (3, 30.0, 1)
    assert (m["prerequisite_satisfaction"], m["difficulty_progression"], m["concept_coherence"]) == (50.0, 50.0, 0.0)


def layers_of(nodes, edges):
    """Longest paths, by relaxing edges until nothing changes; None in or behind cycles."""
    before = {n: {a for a, b in edges if b == n} for n in nodes}
    depth, more = {}, True
    while more:
        more = False
        for n in nodes:
            if n not in depth and all(a in depth for a in before[n]):
                depth[n], more = max((depth[a] + 1 for a in before[n]), default=0), True
    return depth


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    """10,000 nodes in a row, with a few forks, chains beside it and a cycle at its end."""
    n = 10_000
    edges = [(i, i + 1) for i in range(n - 1)] + [(5, 20_000), (20_000, 20_001), (20_001, 300), (700, 30_000), (n - 1, 40_000), (40_000, 40_001), (40_001, 40_000), (40_001, 40_002)]
    nodes = sorted({x for e in edges for x in e})
    rounds = []
    old = gr.cut
    monkeypatch.setattr(gr, "cut", lambda df: rounds.append(1) or old(df))
    df = spark.createDataFrame([(x, -x) for x in nodes], "node long, base long")
    got = {r["node"]: r for r in gr.topo_order(df, spark.createDataFrame(edges, "src long, dst long").repartition(4)).collect()}
    assert len(rounds) < 120
    depth = layers_of_path = {i: i for i in range(n)} | {20_000: 6, 20_001: 7, 30_000: 701}
    assert {k: r["layer"] for k, r in got.items() if r["layer"] is not None} == depth
    # one place per node, by layer, then by the place of the last predecessor
    order = sorted(layers_of_path, key=lambda x: (depth[x], -x if depth[x] in (6, 7) else 0, x))
    by_pos = sorted(depth, key=lambda x: got[x]["pos"])
    assert [depth[x] for x in by_pos] == [depth[x] for x in order]
    assert by_pos[6:8] == [20_000, 6] and by_pos[8:10] == [20_001, 7]
    assert sorted(x for x, r in got.items() if r["layer"] is None) == [40_000, 40_001, 40_002]
    assert sorted(r["pos"] for r in got.values()) == list(range(len(nodes)))


def test_topo_order_of_chains_ladders_and_self_loops(spark):
    rng = random.Random(9)
    for trial in range(3):
        edges, top = set(), 0
        for _ in range(6):
            kind, k = rng.choice(["chain", "ladder", "fan"]), rng.randint(2, 6)
            if kind == "chain":
                edges |= {(top + i, top + i + 1) for i in range(k)}
            elif kind == "ladder":
                edges |= {(top + 2 * i + a, top + 2 * i + 2 + b) for i in range(k) for a in (0, 1) for b in (0, 1)}
            else:
                edges |= {(top, top + i + 1) for i in range(k)} | {(top + i + 1, top + k + 1) for i in range(k)}
            top = max(max(e) for e in edges) - rng.randint(0, 2)
        nodes = list(range(max(max(e) for e in edges) + 2))
        perm = nodes[:]
        rng.shuffle(perm)
        edges = {(a, b) for a, b in edges if a != b}
        if trial == 2:
            edges.add((4, 4))
        # the queue takes nodes of equal rank in the order of their base, which is their number after the shuffle
        named = {(perm[a], perm[b]) for a, b in edges}
        df = spark.createDataFrame([(x, x) for x in nodes], "node long, base long")
        got = gr.topo_order(df, spark.createDataFrame(sorted(named), "src long, dst long")).orderBy("pos").collect()
        assert {r["node"]: r["layer"] for r in got if r["layer"] is not None} == layers_of(nodes, named)
        assert [r["node"] for r in got] == kahn(nodes, named)


def test_topo_order_of_nothing(spark):
    none = spark.createDataFrame([], "node long, base long")
    assert gr.topo_order(none, spark.createDataFrame([], "src long, dst long")).isEmpty()


def test_topo_order_in_many_walks_and_batches(spark, monkeypatch):
    """Deep dense graphs take rounds by their edges, not by their layers, with the queue's order."""
    monkeypatch.setattr(gr, "SMALL", 30)
    monkeypatch.setattr(gr, "LOCAL", 60)
    rng = random.Random(4)
    nodes = list(range(60))
    edges = {(a, b) for a in nodes for b in nodes if a < b and rng.random() < 0.15} | {(57, 59), (59, 57)}
    rounds = []
    old = gr.cut
    monkeypatch.setattr(gr, "cut", lambda df: rounds.append(1) or old(df))
    df = spark.createDataFrame([(x, x) for x in nodes], "node long, base long")
    got = gr.topo_order(df, spark.createDataFrame(sorted(edges) + sorted(edges)[:9], "src long, dst long")).orderBy("pos").collect()
    assert [r["node"] for r in got] == kahn(nodes, edges)
    assert {r["node"]: r["layer"] for r in got if r["layer"] is not None} == layers_of(nodes, edges)
    assert len(rounds) < 40


def test_a_shuffled_path_beyond_a_walk(spark, monkeypatch):
    monkeypatch.setattr(gr, "SMALL", 25)
    names = list(range(400))
    random.Random(5).shuffle(names)
    edges = spark.createDataFrame(list(zip(names, names[1:])), "src long, dst long")
    got = {r["node"]: r["layer"] for r in gr.depths(edges.sparkSession.range(400).toDF("node"), edges).collect()}
    assert got == {x: i for i, x in enumerate(names)}


def test_triangles_in_tasks_of_three_colours(spark, monkeypatch):
    """A dense graph and a hub, with so few edges to a task that nodes take many colours, against all triples."""
    monkeypatch.setattr(gr, "GROUP", 200)
    monkeypatch.setattr(gr, "STRETCH", 50)
    rng = random.Random(6)
    pairs = {(a, b) for a in range(30) for b in range(a + 1, 30) if rng.random() < 0.4} | {(99, a) for a in range(30)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    share = {x: sum(b in near[a] for a in s for b in s) / (len(s) * (len(s) - 1)) for x, s in near.items() if len(s) > 1}
    nodes = spark.createDataFrame([(x,) for x in [*near, 500]], "node long")
    edges = spark.createDataFrame(sorted(pairs) + [(b, a) for a, b in sorted(pairs)[:20]], "src long, dst long")
    found = gr.mean_clustering(nodes, edges)
    assert abs(found.first()["mean_clustering"] - sum(share.values()) / (len(near) + 1)) < 1e-12
    none = gr.mean_clustering(nodes, edges.limit(0)).first()["mean_clustering"]
    assert none == 0.0


def test_upsert_makes_the_reverse_after_the_shuffle(spark):
    """One exchange carries the new edges once and the known keys; given edges win, loops have one direction."""
    existing = spark.createDataFrame([(1, 2, "related", 0.5, 0.5, 0.5), (4, 3, "related", 0.5, 0.5, 0.5)], "src long, dst long, rel_type string, confidence double, similarity double, strength double")
    new = spark.createDataFrame(
        [(1, 2, "related", 0.9, 0.9), (3, 4, "related", 0.7, 0.8), (6, 5, "related", 0.6, 0.6), (5, 6, "related", 0.3, 0.3), (7, 7, "related", 0.4, 0.4),
         (9, 8, "builds_on", 0.2, 0.2), (1, 2, "builds_on", 0.1, 0.1), (10, 11, "related", 0.1, 0.1), (10, 11, "related", 0.2, 0.2)],
        "src long, dst long, rel_type string, confidence double, similarity double")
    every, created = gr.upsert_edges(existing, new)
    got = sorted((r["src"], r["dst"], r["rel_type"], r["confidence"]) for r in created.collect())
    assert got == [(1, 2, "builds_on", 0.1), (2, 1, "related", 0.9), (3, 4, "related", 0.7), (5, 6, "related", 0.3), (6, 5, "related", 0.6), (7, 7, "related", 0.4),
                   (9, 8, "builds_on", 0.2), (10, 11, "related", 0.2), (11, 10, "related", 0.2)]
    assert every.count() == len(got) + 2 and gr.upsert_edges(every, new)[1].count() == 0
    plan = created._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
