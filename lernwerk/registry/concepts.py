"""Concept-unit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..derived import check_sql
from ..operators import concepts as cp
from . import Query

OPENING = ", ".join(f"'{x}'" for x in cp.OPENING_LABELS)
SPEED = "case l " + " ".join(f"when '{k}' then {v}::double" for k, v in cp.LABEL_SPEEDS.items()) + " else 1.0::double end"

GROUP_CTES = f"""
  lagged as (select *, lag(keywords) over (partition by doc_id order by chunk_order) as pk from chunk_labels),
  broken as (select *, primary_label in ({OPENING}) or coalesce(len(list_intersect(pk, keywords))::double / len(list_distinct(list_concat(pk, keywords))) < 0.2, false) as b from lagged),
  islands as (select *, sum(b::int) over (partition by doc_id order by chunk_order) as island from broken),
  placed as (select *, (row_number() over (partition by doc_id, island order by chunk_order) - 1) % 3 = 0 as o from islands),
  grouped as (select doc_id, chunk_order, primary_label, keywords, word_count, confidence,
    (sum(o::int) over (partition by doc_id order by chunk_order))::bigint as concept_order from placed)"""

UNIT_CTES = GROUP_CTES + f""",
  kw as (select doc_id, concept_order, chunk_order, unnest(keywords) as k, generate_subscripts(keywords, 1) as p from grouped),
  kn as (select doc_id, concept_order, k, count(*) as n, min(chunk_order * 100 + p) as seen from kw group by all),
  kt as (select *, row_number() over (partition by doc_id, concept_order order by n desc, seen) as rn from kn),
  tops as (select doc_id, concept_order, list(k order by rn) filter (where rn <= 5) as top, list(k order by seen) as keywords from kt group by all),
  units as (select doc_id, concept_order, list_sort(list_distinct(list(primary_label))) as labels, sum(word_count)::bigint as word_count,
      list(chunk_order order by chunk_order) as chunk_orders, list(primary_label order by chunk_order) as chunk_labels from grouped group by all),
  titled as (select u.*, t.top, t.keywords, ('Concept ' || concept_order || ': ' || array_to_string(t.top[1:3], ', '))[1:255] as title from units u join tops t using (doc_id, concept_order)),
  speeds as (select doc_id, concept_order, sum(sp) / count(*) as mean from (select doc_id, concept_order, {SPEED} as sp from (select doc_id, concept_order, unnest(labels) as l from units) a) b group by all),
  timed as (select t.*, greatest(1.0::double, word_count / (200.0::double * mean) * 1.3::double) as reading_min from titled t join speeds using (doc_id, concept_order))"""


def _grouped(t):
    return cp.concept_groups(t.chunk_labels)


def _units(t):
    return cp.concept_units(_grouped(t))


def _timed(t):
    return cp.reading_time(_units(t))


def _out_units(t):
    u = _units(t)
    return u.select("doc_id", "concept_order", "title", "word_count", F.array_join("labels", ",").alias("labels"), F.array_join("top_keywords", ",").alias("top_keywords"))


def _texts(t):
    return cp.unit_text(_grouped(t), t.chunks).withColumn("text_hash", F.sha2("unit_text", 256)).drop("unit_text")


def _out_timed(t):
    return _timed(t).select("doc_id", "concept_order", F.round("reading_min", 6).alias("reading_min"))


def _wide(t):
    """Units of 64 chunks: long enough to need splitting."""
    runs = t.chunk_labels.withColumn("concept_order", F.floor(F.col("chunk_order") / 64) + 1)
    members = runs.groupBy("doc_id", "concept_order").agg(
        F.array_sort(F.collect_list(F.struct("chunk_order", "primary_label"))).alias("m"), F.sum("word_count").alias("word_count"))
    return members.select(
        "doc_id", "concept_order", F.transform("m", lambda x: x["chunk_order"]).alias("chunk_orders"),
        F.transform("m", lambda x: x["primary_label"]).alias("chunk_labels"), (F.col("word_count") / F.lit(50.0)).alias("reading_min"))


def _flags(t):
    return cp.length_flags(_eight(t))


def _eight(t):
    """Units of up to 8 chunks with times between 1 and 14 minutes, so every rule of the binning applies."""
    runs = t.chunk_labels.withColumn("concept_order", F.floor(F.col("chunk_order") / 8) + 1)
    return runs.groupBy("doc_id", "concept_order").agg(F.sum("word_count").alias("word_count")).withColumn(
        "reading_min", 1 + (F.col("word_count") * 7 + F.col("doc_id") + 13 * F.col("concept_order")) % 14 * F.lit(0.75))


EIGHT = """eight as (select *, 1 + (word_count * 7 + doc_id + 13 * concept_order) % 14 * 0.75::double as reading_min from (
      select doc_id, chunk_order // 8 + 1 as concept_order, sum(word_count)::bigint as word_count from chunk_labels group by all) x)"""


def _bins(t):
    return cp.bin_by_time(_eight(t).select("doc_id", "concept_order", "reading_min"))


BIN_CTES = EIGHT + """,
  fold as (
    select doc_id, concept_order, reading_min as total, 1 as members, 1::bigint as bin_order from eight where concept_order = 1
    union all
    select f.doc_id, e.concept_order,
      case when stay then f.total + e.reading_min else e.reading_min end, case when stay then f.members + 1 else 1 end, f.bin_order + case when stay then 0 else 1 end
    from fold f join eight e on e.doc_id = f.doc_id and e.concept_order = f.concept_order + 1,
    lateral (select case when f.members = 1 then f.total + e.reading_min < 10 else f.total < 10 and f.total + e.reading_min <= 10 end as stay) s)"""


def _split(t):
    return cp.split_long(_wide(t)).select(
        "doc_id", "concept_order", F.element_at("chunk_orders", 1).alias("first_chunk"),
        F.size("chunk_orders").alias("n_chunks"), F.round("reading_min", 6).alias("reading_min"))


BAD = ", ".join(f"'{a}>{b}'" for a, b in cp.BAD_SPLITS)
SPLIT_SQL = check_sql("chunk_labels", f"""with
  wide as (select doc_id, chunk_order // 64 + 1 as concept_order, list(primary_label order by chunk_order) as l, min(chunk_order) as first, count(*)::int as n, sum(word_count) / 50.0::double as t from chunk_labels group by all),
  segs as (
    select doc_id, concept_order, 0::int as s, n, t::double as t, 0 as done from wide
    union all
    select p.doc_id, p.concept_order, case when half = 0 then p.s else p.s + p.pt end::int, case when half = 0 then p.pt else p.n - p.pt end::int,
      p.t * ((case when half = 0 then p.pt else p.n - p.pt end)::double / p.n), 0
    from (select g.*, coalesce(list_filter(list_filter([g.n // 2, g.n // 2 + 1, g.n // 2 - 1, g.n // 2 + 2, g.n // 2 - 2],
              lambda x: abs(x - g.n // 2) <= least(2, g.n // 4)),
              lambda x: x > 0 and x < g.n and (w.l[g.s + x] || '>' || w.l[g.s + x + 1]) not in ({BAD}))[1], greatest(1, least(g.n // 2, g.n - 1))) as pt
          from segs g join wide w using (doc_id, concept_order) where g.t > 10 and g.n > 1) p, (values (0), (1)) h(half))
  select g.doc_id, g.concept_order, w.first + g.s as first_chunk, g.n::bigint as n_chunks, round(g.t, 6) as reading_min
  from segs g join wide w using (doc_id, concept_order) where not (g.t > 10 and g.n > 1)""", recursive=True)


def _merged(t):
    units = _timed(t).withColumn("complexity", (F.col("concept_order") % 10) / F.lit(10.0)).withColumn(
        "load", F.element_at(F.array(*[F.lit(x) for x in cp.LOADS]), ((F.col("concept_order") + F.col("doc_id")) % 4 + 1).cast("int")))
    bins = cp.bin_by_time(units.select("doc_id", "concept_order", "reading_min")).drop("reading_min", "needs_split")
    m = cp.merge_units(units.join(bins, ["doc_id", "concept_order"]))
    return m.select(
        "doc_id", "bin_order", "n_units", "word_count", F.round("reading_min", 6).alias("reading_min"), F.round("complexity", 6).alias("complexity"),
        "load", "title", F.array_join("labels", ",").alias("labels"), F.array_join("chunk_orders", ",").alias("chunk_orders"))


MERGE_SQL = check_sql("chunk_labels", f"""with {UNIT_CTES},
  fold as (
    select doc_id, concept_order, reading_min as total, 1 as members, 1::bigint as bin_order from timed where concept_order = 1
    union all
    select f.doc_id, e.concept_order,
      case when stay then f.total + e.reading_min else e.reading_min end, case when stay then f.members + 1 else 1 end, f.bin_order + case when stay then 0 else 1 end
    from fold f join timed e on e.doc_id = f.doc_id and e.concept_order = f.concept_order + 1,
    lateral (select case when f.members = 1 then f.total + e.reading_min < 10 else f.total < 10 and f.total + e.reading_min <= 10 end as stay) s),
  j as (select t.*, f.bin_order, (t.concept_order % 10) / 10.0::double as complexity, ['low', 'medium', 'high', 'very_high'][(t.concept_order + t.doc_id) % 4 + 1] as load,
      (t.concept_order + t.doc_id) % 4 + 1 as rank from timed t join fold f using (doc_id, concept_order)),
  m as (select doc_id, bin_order, count(*) as n_units, sum(word_count)::bigint as word_count, sum(reading_min) as reading_min, avg(complexity) as complexity,
      arg_max(load, rank) as load, arg_min(title, concept_order) as t1, list_sort(list_distinct(flatten(list(labels)))) as labels, list_sort(flatten(list(chunk_orders))) as co from j group by all)
  select doc_id, bin_order, n_units, word_count, round(reading_min, 6) as reading_min, round(complexity, 6) as complexity, load,
    case when n_units = 1 then t1 else 'Combined Concept ' || bin_order || ': ' || array_to_string(labels[1:3], ', ') end as title,
    array_to_string(labels, ',') as labels, array_to_string(co, ',') as chunk_orders from m""", recursive=True)


def _prior(t):
    return cp.related_prior(_units(t)).withColumn("score", F.round("score", 6))


PRIOR_SQL = check_sql("chunk_labels", f"""with {UNIT_CTES},
  terms as (select doc_id, concept_order, list_distinct(list_transform(list_concat(labels, keywords), lambda x: lower(x))) as w from titled),
  pairs as (select a.doc_id, a.concept_order, b.concept_order as po, len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w))) as s
    from terms a join terms b on a.doc_id = b.doc_id and b.concept_order between a.concept_order - 3 and a.concept_order - 1),
  best as (select *, row_number() over (partition by doc_id, concept_order order by s desc, po desc) as rn from pairs where s > 0)
  select t.doc_id, t.concept_order, b.po as prior_order, coalesce(round(b.s, 6), 0) as score from terms t left join best b on t.doc_id = b.doc_id and t.concept_order = b.concept_order and rn = 1""")


def _next(t):
    existing = _units(t).select("doc_id", "concept_order")
    new = t.chunks.select("doc_id", "chunk_order")
    return cp.next_order(existing, new, "concept_order", "chunk_order")


QUERIES = [
    Query("concept_groups", lambda t: _grouped(t).select("doc_id", "chunk_order", "concept_order"),
          check_sql("chunk_labels", f"with {GROUP_CTES} select doc_id, chunk_order, concept_order from grouped")),
    Query("concept_units", _out_units, check_sql("chunk_labels", f"""with {UNIT_CTES}
      select doc_id, concept_order, title, word_count, array_to_string(labels, ',') as labels, array_to_string(top, ',') as top_keywords from titled""")),
    Query("unit_texts", _texts, check_sql("chunk_labels", f"""with {GROUP_CTES}, ut as (select doc_id, concept_order, string_agg(chunk_text, chr(10) || chr(10) order by chunk_order) as u, sum(c.word_count)::bigint as n_words
      from grouped g join chunks c using (doc_id, chunk_order) group by all)
      select doc_id, concept_order, n_words, length(u)::bigint as n_chars, sha256(u) as text_hash from ut""")),
    Query("reading_time", _out_timed, check_sql("chunk_labels", f"with {UNIT_CTES} select doc_id, concept_order, round(reading_min, 6) as reading_min from timed")),
    Query("length_flags", _flags, check_sql("chunk_labels", f"""with {EIGHT}
      select doc_id, concept_order, reading_min, reading_min between 5 and 10 as optimal, reading_min > 10 as needs_split,
        coalesce(reading_min + lead(reading_min) over (partition by doc_id order by concept_order) < 10, false) as combinable from eight""")),
    Query("time_bins", _bins, check_sql("chunk_labels", f"""with {BIN_CTES}
      select doc_id, bin_order, concept_order, e.reading_min, e.reading_min > 10 as needs_split from fold join eight e using (doc_id, concept_order)""", recursive=True)),
    Query("long_units_split", _split, SPLIT_SQL),
    Query("merged_units", _merged, MERGE_SQL),
    Query("related_prior_unit", _prior, PRIOR_SQL),
    Query("next_orders", _next, check_sql("chunk_labels", f"""with {GROUP_CTES}, top as (select doc_id, max(concept_order) as m from grouped group by doc_id)
      select c.doc_id, c.chunk_order, m + row_number() over (partition by c.doc_id order by c.chunk_order) as concept_order from chunks c join top using (doc_id)""")),
]
