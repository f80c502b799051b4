"""Similarity and community queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..derived import EDGE_TAU, check_sql
from ..operators import communities as cm, similarity as sm
from ..session import cut
from . import Query

# A short stop list for the languages of the test documents; the operator's default is Spark's list.
STOPS = ("the", "and", "is", "of", "in", "to", "le", "la", "les", "et", "de", "un")
STOP_SQL = ", ".join(f"'{w}'" for w in STOPS)
WORDS = r"regexp_extract_all(lower(chunk_text), '[\p{L}\p{M}\p{Nd}\p{Pc}]+')"


def _chunks(t):
    return t.chunks.select("doc_id", F.col("chunk_order").alias("chunk"), F.col("chunk_text").alias("text"))


def _tfidf(t):
    return sm.tfidf(_chunks(t), stop_words=STOPS)


TFIDF_CTES = f"""
  toks as (select doc_id, chunk_order as chunk, list_filter({WORDS}, lambda w: length(w) > 1 and w not in ({STOP_SQL})) as w, count(*) over (partition by doc_id) as n from chunks),
  terms as (select doc_id, chunk, n, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) as term from toks),
  tf as (select doc_id, chunk, n, term, count(*) as tf from terms group by all),
  dfs as (select doc_id, term, any_value(n) as n, count(*) as df, sum(tf) as cf from tf group by doc_id, term),
  vocab as (select * from dfs where df <= 0.8::double * n),
  raw as (select tf.doc_id, chunk, term, tf * (ln((1 + v.n) / (1 + v.df)::double) + 1) as x from tf join vocab v using (doc_id, term)),
  vectors as (select doc_id, chunk, term, x / sqrt(sum(x * x) over (partition by doc_id, chunk)) as w from raw)"""

FREQ_CTES = f"""
  ws as (select doc_id, chunk_order as chunk, unnest({WORDS}) as term, len({WORDS}) as n from chunks),
  vectors as (select doc_id, chunk, term, count(*) / any_value(n)::double as w from ws group by all)"""


def q_pairs(tau: float) -> str:
    return f""",
  unit as (select doc_id, chunk, term, w / sqrt(sum(w * w) over (partition by doc_id, chunk)) as w from vectors),
  pairs as (select a.doc_id, a.chunk as i, b.chunk as j, round(sum(a.w * b.w), 6) as sim from unit a join unit b
            on a.doc_id = b.doc_id and a.term = b.term and a.chunk < b.chunk group by all having round(sum(a.w * b.w), 6) >= {tau})"""


def _freq_pairs(t):
    return sm.sparse_cosine_pairs(sm.term_freq(_chunks(t)), 0.60)


def _tfidf_pairs(t):
    return sm.sparse_cosine_pairs(_tfidf(t), 0.20)


def _embedding_pairs(t):
    return sm.dense_cosine_pairs(t.embeddings, EDGE_TAU)


def _nearest(t):
    vectors = t.embeddings
    return sm.nearest_existing(vectors, vectors, 5).select(
        "new_id", "rank", F.col("id").alias("existing_id"), (F.round(F.col("sim") * 10000) / 10000).alias("sim"))     # a half as doubles have it, as in the check SQL


def _components(t):
    return cm.components(t.edges_once.where("rel_type = 'related'"), t.embeddings.select(F.col("vec_id").alias("node")))


def q_components(edges: str, nodes: str) -> str:
    """Recursive reachability in DuckDB as ``comps(node, component)``."""
    return f"""
  both_ways as (select src, dst from {edges} union select dst, src from {edges}),
  reach as (select node, node as r from ({nodes}) n union select reach.node, b.dst from reach join both_ways b on b.src = reach.r),
  comps as (select node, min(r) as component from reach group by node)"""


def _doc_edges(t):
    return _freq_pairs(t)


def _members(t, edges=None):
    nodes = t.chunks.select("doc_id", F.col("chunk_order").alias("node"))
    return cm.modularity_communities(_doc_edges(t) if edges is None else edges, nodes)


def _community_stats(t):
    edges = cut(_doc_edges(t))        # read by the communities and by the totals
    return cm.community_stats(_members(t, edges), edges, "greedy_modularity", 0.60)


def _communities(t):
    return _members(t)


def q_communities(pairs: str) -> str:
    """Rounds of mutual choices over ``pairs(doc_id, i, j)`` in DuckDB, as ``named(doc_id, node, community)``."""
    return f"""
  edge as (select distinct doc_id as g, least(i, j) as a, greatest(i, j) as b from {pairs} where i <> j),
  both_ends as (select g, a, b from edge union all select g, b, a from edge),
  deg as (select g, a, count(*) as k from both_ends group by all),
  start as (select s.g, s.a, s.b, 1::bigint as e, x.k as ka, y.k as kb, count(*) over (partition by s.g) as m2
    from both_ends s join deg x on x.g = s.g and x.a = s.a join deg y on y.g = s.g and y.a = s.b),
  -- rows of links (node is null), and of nodes with their community a
  rounds as (
    select 0 as nth, g, null::bigint as node, a, b, e, ka, kb, m2 from start
    union all select 0, g, a, a, null, null, null, null, null from deg
    union all
    select * from (
      with best as (select g, a, arg_max(b, (m2 * e - ka * kb, -least(a, b), -greatest(a, b))) as b, arg_max(ka + kb, (m2 * e - ka * kb, -least(a, b), -greatest(a, b))) as k
          from rounds where node is null and m2 * e - ka * kb > 0 group by g, a),
        merged as (select x.g, x.a, x.b, x.k from best x join best y on y.g = x.g and y.a = x.b and y.b = x.a where x.a < x.b),
        moved as (select g, a as c, a as t, k from merged union all select g, b, a, k from merged)
      select r.nth + 1, r.g, null::bigint, coalesce(x.t, r.a) as a2, coalesce(y.t, r.b) as b2, sum(r.e)::bigint, max(coalesce(x.k, r.ka)), max(coalesce(y.k, r.kb)), max(r.m2)
        from rounds r left join moved x on x.g = r.g and x.c = r.a left join moved y on y.g = r.g and y.c = r.b
        where r.node is null and exists (select 1 from merged) and coalesce(x.t, r.a) <> coalesce(y.t, r.b) group by r.nth, r.g, a2, b2
      union all
      select r.nth + 1, r.g, r.node, coalesce(x.t, r.a), null, null, null, null, null
        from rounds r left join moved x on x.g = r.g and x.c = r.a where r.node is not null and exists (select 1 from merged)
    )),
  named as (select g as doc_id, node, a as community from rounds where node is not null qualify row_number() over (partition by g, node order by nth desc) = 1)"""


COMMUNITY_SQL = check_sql("chunks", f"""with {FREQ_CTES} {q_pairs(0.6)}, {q_communities('pairs')}
  select c.doc_id, c.chunk_order as node, coalesce(n.community, c.chunk_order) as community from chunks c left join named n on n.doc_id = c.doc_id and n.node = c.chunk_order""", recursive=True)
COMMUNITY_STATS_SQL = check_sql("chunks", f"""with {FREQ_CTES} {q_pairs(0.6)}, {q_communities('pairs')},
  sizes as (select c.doc_id, coalesce(n.community, c.chunk_order) as community, count(*) as size from chunks c left join named n on n.doc_id = c.doc_id and n.node = c.chunk_order group by all)
  select count(*) as n_communities, round(avg(size), 6) as mean_size, max(size) as largest, (select count(*) from pairs) as n_edges, 'greedy_modularity' as method, 0.6::double as tau from sizes""", recursive=True)


def _community_chunks(t):
    """Documents' chunks grouped by the components of their similarity graph (checkable in SQL)."""
    pairs = _doc_edges(t)
    key = lambda c: F.col("doc_id") * 100000 + F.col(c)
    nodes = t.chunks.select((F.col("doc_id") * 100000 + F.col("chunk_order")).alias("node"))
    comps = cm.components(pairs.select(key("i").alias("src"), key("j").alias("dst")), nodes)
    members = comps.select(F.floor(F.col("node") / 100000).alias("doc_id"), (F.col("node") % 100000).alias("node"), (F.col("component") % 100000).alias("community"))
    return cm.community_chunks(members, t.chunks).select(
        "doc_id", "community_id", "n_chunks", "word_count", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.sha2("combined_text", 256).alias("text_hash"))


CHUNK_COMM_SQL = check_sql("chunks", f"""with {FREQ_CTES} {q_pairs(0.6)},
  e as (select doc_id * 100000 + i as src, doc_id * 100000 + j as dst from pairs),
  {q_components('e', 'select doc_id * 100000 + chunk_order as node from chunks')},
  g as (select c.doc_id, component, count(*) as n_chunks, sum(word_count)::bigint as word_count, string_agg(chunk_order, ',' order by chunk_order) as chunk_ids,
      string_agg(chunk_text, chr(10) || chr(10) order by chunk_order) as t from chunks c join comps on node = c.doc_id * 100000 + c.chunk_order group by all)
  select doc_id, row_number() over (partition by doc_id order by word_count desc, component) - 1 as community_id, n_chunks, word_count, chunk_ids, sha256(t) as text_hash from g""", recursive=True)


def _pair_groups(t):
    nodes = t.embeddings.select(F.col("vec_id").alias("node"))
    g = cm.pair_groups(nodes, sm.dense_cosine_pairs(t.embeddings, 0.35))
    return g.withColumn("mean_sim", F.round("mean_sim", 5))


EMB_PAIRS = """pairs as (select a.vec_id as i, b.vec_id as j, round(list_inner_product(a.e, b.e) / (a.n * b.n), 6) as sim
  from (select vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings) a
  join (select vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from embeddings) b on a.vec_id {op} b.vec_id)"""

QUERIES = [
    Query("tfidf_weights", lambda t: _tfidf(t).withColumn("w", F.round("w", 6)), check_sql("chunks", f"with {TFIDF_CTES} select doc_id, chunk, term, round(w, 6) as w from vectors")),
    Query("term_frequencies", lambda t: sm.term_freq(_chunks(t)).withColumn("w", F.round("w", 6)), check_sql("chunks", f"with {FREQ_CTES} select doc_id, chunk, term, round(w, 6) as w from vectors")),
    Query("tf_cosine_pairs", _freq_pairs, check_sql("chunks", f"with {FREQ_CTES} {q_pairs(0.6)} select doc_id, i, j, sim from pairs")),
    Query("tfidf_cosine_pairs", _tfidf_pairs, check_sql("chunks", f"with {TFIDF_CTES} {q_pairs(0.2)} select doc_id, i, j, sim from pairs")),
    Query("embedding_pairs", _embedding_pairs, "with " + EMB_PAIRS.format(op="<") + f" select i, j, sim from pairs where sim >= {EDGE_TAU}"),
    Query("nearest_existing", _nearest, "with " + EMB_PAIRS.format(op="<>") + """, r as (select *, row_number() over (partition by i order by sim desc, j) as rank from pairs)
      select i as new_id, rank, j as existing_id, round(sim, 4) as sim from r where rank <= 5"""),
    Query("components", _components, check_sql("edges", "with rel as (select src, dst from edges where rel_type = 'related')," + q_components("rel", "select vec_id as node from embeddings") + " select node, component from comps", recursive=True)),
    Query("modularity_communities", _communities, COMMUNITY_SQL),
    Query("community_stats", _community_stats, COMMUNITY_STATS_SQL),
    Query("community_chunks", _community_chunks, CHUNK_COMM_SQL),
    Query("pair_groups", _pair_groups, "with recursive " + EMB_PAIRS.format(op="<") + ", p as (select * from pairs where sim >= 0.35), e as (select i as src, j as dst from p)," + q_components("e", "select vec_id as node from embeddings") + """,
      s as (select component, count(*) as n_members from comps group by component),
      q as (select component, count(*) as n_pairs, avg(sim) as mean_sim, max(sim) as max_sim from p join comps on node = i group by component)
      select s.component as group_id, n_members, coalesce(n_pairs, 0) as n_pairs, round(mean_sim, 5) as mean_sim, max_sim from s left join q using (component)"""),
]
