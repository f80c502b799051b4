"""JSON queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..derived import CONCEPT_LABELS, check_sql
from ..operators import body as bd, concepts as cp
from . import Query
from .concepts import UNIT_CTES
from .text import BODY_CTES, q_strip

LABELS = ", ".join(f"'{x}'" for x in CONCEPT_LABELS)


def _fields(t):
    f = bd.body_fields(t.block_bodies)
    return f.select(
        "block_id", F.size("segments").alias("n_segments"), F.size("qa_items").alias("n_qa"), "core_goal", "has_body", "total_duration",
        *[(F.length(c) > 2).alias(f"has_{c}") for c in ("revision", "recap", "rescue")],
        F.get("qa_items", F.lit(0))["question"].alias("first_question"))


QA = "case when json_exists(j, '$.qa_items') then j->'$.qa_items' when json_exists(j, '$.qa') then j->'$.qa' else j->'$.core.qa' end"
FIELDS_SQL = check_sql("block_bodies", f"""with {BODY_CTES}, q as (select *, {QA} as qa from located)
  select block_id, coalesce(json_array_length(segs), 0)::bigint as n_segments, coalesce(json_array_length(qa), 0)::bigint as n_qa, coalesce(j->>'$.core.goal', '') as core_goal,
    coalesce(len(json_keys(j)) > 0, false) as has_body, (j->>'$.total_duration')::bigint as total_duration, coalesce(json_exists(j, '$.revision'), false) as has_revision,
    coalesce(json_exists(j, '$.recap'), false) as has_recap, coalesce(json_exists(j, '$.rescue'), false) as has_rescue, qa->>'$[0].question' as first_question from q""")


def _formats(t):
    return t.block_bodies.select("block_id", bd.body_format(F.col("body"), F.col("title"), F.col("script")).alias("format"))


def _labels(t):
    p = bd.parse_label_responses(t.label_responses)
    return p.select("event_id", "primary_label", F.array_join("secondary_labels", ",").alias("secondary_labels"), "confidence", "reasoning", F.array_join("keywords", ",").alias("keywords"), "concept_topic", "parsed")


def q_fence(c: str, bare: bool) -> str:
    start = "^```(json)?" if bare else "^```json"
    return q_strip(f"regexp_replace(regexp_replace({q_strip(c)}, '{start}', ''), '```$', '')")


LABEL_SQL = check_sql("label_responses", f"""with c as (select event_id, {q_fence('response', False)} as t from label_responses), j as (select event_id, case when json_valid(t) then cast(t as json) end as j from c),
  k as (select *, coalesce(json_exists(j, '$.primary_label') and json_exists(j, '$.confidence') and json_exists(j, '$.reasoning') and json_exists(j, '$.keywords') and json_exists(j, '$.concept_topic'), false) as ok from j)
  select event_id, case when ok and j->>'$.primary_label' in ({LABELS}) then j->>'$.primary_label' else 'Other' end as primary_label,
    case when ok then coalesce(array_to_string(cast(j->'$.secondary_labels' as varchar[]), ','), '') else '' end as secondary_labels, case when ok then (j->>'$.confidence')::double else 0.5 end::double as confidence,
    case when ok then j->>'$.reasoning' else 'Failed to parse LLM response' end as reasoning, case when ok then coalesce(array_to_string(cast(j->'$.keywords' as varchar[]), ','), '') else '' end as keywords,
    case when ok then j->>'$.concept_topic' else 'Unknown' end as concept_topic, ok as parsed from k""")


def _times(t):
    return bd.parse_time_responses(t.time_responses)


TIME_SQL = check_sql("time_responses", f"""with c as (select event_id, {q_fence('response', True)} as t from time_responses), j as (select event_id, case when json_valid(t) then cast(t as json) end as j from c)
  select event_id, coalesce((j->>'$.reading_time')::double, 5.0)::double as reading_min, greatest(0.0, least(1.0, coalesce((j->>'$.complexity_score')::double, 0.5)))::double as complexity,
    case when j->>'$.cognitive_load' in ('low', 'medium', 'high', 'very_high') then j->>'$.cognitive_load' else 'medium' end as load from j""")


def _assembled(min_chars):
    def run(t):
        f = bd.body_fields(t.block_bodies)
        a = f.select("block_id", bd.assemble_body(F.col("segments"), F.col("qa_items"), min_chars).alias("a"))
        return a.select("block_id", "a.total_duration", F.size("a.segments").alias("n_segments"), F.array_join(F.transform("a.segments", lambda s: F.concat(F.coalesce(s["type"], F.lit("")), F.lit(":"), F.coalesce(s["title"], F.lit("")), F.lit("="), F.coalesce(s["content"], F.lit("")))), "|").alias("outline"))
    return run


def q_assembled(min_chars: int) -> str:
    keep = "true" if min_chars == 0 else f"length(trim(coalesce(s->>'$.content', ''))) > {min_chars}"
    return check_sql("block_bodies", f"""with {BODY_CTES}, q as (select *, {QA} as qa from located),
  parts as (select block_id, 0 as a, i, coalesce(s->>'$.type', '') || ':' || coalesce(s->>'$.title', '') || '=' || coalesce(s->>'$.content', '') as o, coalesce((s->>'$.duration_seconds')::bigint, 90) as d from seg where {keep}
    union all select block_id, 1, i, 'knowledge_check:Knowledge Check ' || (i + 1) || '=<strong>Q: ' || coalesce(x->>'$.question', '') || '</strong><br><br><em>A: ' || coalesce(x->>'$.answer', '') || '</em>', 90
      from (select block_id, i, json_extract(qa, '$[' || i || ']') as x from (select block_id, qa, unnest(range(0, json_array_length(qa)::int)) as i from q) y) z)
  select b.block_id, coalesce(sum(d), 0)::bigint as total_duration, count(o) as n_segments, coalesce(string_agg(o, '|' order by a, i), '') as outline from block_bodies b left join parts using (block_id) group by b.block_id""")


def _defaults(t):
    units = cp.concept_units(cp.concept_groups(t.chunk_labels))
    prior = cp.related_prior(units).join(units.select("doc_id", F.col("concept_order").alias("prior_order"), F.col("title").alias("prior_title")), ["doc_id", "prior_order"], "left")
    rows = units.select("doc_id", "concept_order", "title").join(prior.select("doc_id", "concept_order", "prior_title"), ["doc_id", "concept_order"], "left")
    b = bd.default_body(rows)
    return b.select("doc_id", "concept_order", F.get_json_object("body", "$.core.goal").alias("goal"), F.get_json_object("body", "$.revision.nano_recap").alias("recap"),
                    F.get_json_object("body", "$.core.segments[0].content").alias("opening"), F.get_json_object("body", "$.rescue.nano_summary").alias("rescue"))


DEFAULT_SQL = check_sql("chunk_labels", f"""with {UNIT_CTES},
  terms as (select doc_id, concept_order, title, list_distinct(list_transform(list_concat(labels, keywords), lambda x: lower(x))) as w from titled),
  pairs as (select a.doc_id, a.concept_order, b.title as pt, b.concept_order as po, len(list_intersect(a.w, b.w))::double / len(list_distinct(list_concat(a.w, b.w))) as s
    from terms a join terms b on a.doc_id = b.doc_id and b.concept_order between a.concept_order - 3 and a.concept_order - 1),
  best as (select *, row_number() over (partition by doc_id, concept_order order by s desc, po desc) as rn from pairs where s > 0)
  select t.doc_id, t.concept_order, 'Understand the concepts in ' || title as goal, 'Previous concept: ' || coalesce(pt, 'N/A') as recap, 'Let''s explore ' || title as opening, 'Key concept: ' || title as rescue
  from terms t left join best b on t.doc_id = b.doc_id and t.concept_order = b.concept_order and rn = 1""")


def _relations(t):
    return bd.parse_relations(t.relation_responses, t.relation_batches).drop("similarity")


RELATION_SQL = check_sql("relation_responses", """with r as (select batch_id, f, g, k, c from relation_responses, (values (0, 3, 'prerequisite', 0.9::double), (1, 7, 'builds_on', 0.95), (2, 4, 'related', 0.5), (4, 1, 'related', 0.75)) v(f, g, k, c) where batch_id % 3 < 2 and c >= 0.75)
  select r.batch_id, a.block_id as src, b.block_id as dst, k as rel_type, c as confidence from r join relation_batches a on a.batch_id = r.batch_id and a.idx = f join relation_batches b on b.batch_id = r.batch_id and b.idx = g""")


def _inspected(t):
    return bd.inspect_body(t.block_bodies)


INSPECT_SQL = check_sql("block_bodies", f"""with {BODY_CTES}, q as (select *, {QA} as qa from located)
  select block_id, array_to_string(list_sort(coalesce(json_keys(j), [])), ',') as body_keys, coalesce(json_exists(j, '$.segments'), false) as has_segments, coalesce(json_exists(j, '$.core'), false) as has_core,
    coalesce(json_array_length(segs), 0)::bigint as n_segments, coalesce(json_array_length(qa), 0)::bigint as n_qa,
    case when length(j->>'$.core.goal') > 50 then (j->>'$.core.goal')[1:50] || '...' else coalesce(j->>'$.core.goal', '') end as goal_preview from q""")


def _cards(drop: bool):
    def run(t):
        m = bd.merge_card_responses(t.card_batches, t.card_responses, drop)
        return m.withColumn("tags", F.array_join("tags", ","))
    return run


def q_cards(where: str) -> str:
    return check_sql("card_responses card_batches", f"""with j as (select batch_id, case when json_valid({q_fence('response', True)}) then cast({q_fence('response', True)} as json) end as j from card_responses),
  c as (select b.*, j, j->('$[' || pos || ']') as r from card_batches b join j using (batch_id))
  select batch_id, pos, coalesce(r->>'$.question', question) as question, coalesce(r->>'$.answer', answer) as answer, context, coalesce(r->>'$.difficulty', 'medium') as difficulty,
    case when r is null then replace(lower(context), ' ', '_') else coalesce(array_to_string(cast(r->'$.tags' as varchar[]), ','), '') end as tags, r is not null as improved from c {where}""")


def _exploded(t):
    return bd.explode_completions(t.completions_map)


QUERIES = [
    Query("body_fields", _fields, FIELDS_SQL),
    Query("body_formats", _formats, check_sql("block_bodies", """with p as (select *, case when json_valid(body) then cast(body as json) end as j from block_bodies)
      select block_id, case when starts_with(title, '[MIGRATED→') then 'migrated' when json_exists(j, '$.segments') then 'new' when j->>'$.template' = 'compact7' and (json_exists(j, '$.core') or json_exists(j, '$.qa')) then 'old'
        when script <> '' then 'legacy' else 'empty' end as format from p""")),
    Query("label_responses_parsed", _labels, LABEL_SQL),
    Query("time_responses_parsed", _times, TIME_SQL),
    Query("assembled_bodies", _assembled(50), q_assembled(50)),
    Query("assembled_bodies_unfiltered", _assembled(0), q_assembled(0)),
    Query("default_bodies", _defaults, DEFAULT_SQL),
    Query("completions_exploded", _exploded, check_sql("reviews", "select user_id as session_id, block_id, max(rating) as rating, sum(time_s)::bigint as time_s, 'n' as notes from reviews group by all")),
    Query("relations_parsed", _relations, RELATION_SQL),
    Query("bodies_inspected", _inspected, INSPECT_SQL),
    Query("cards_merged", _cards(False), q_cards("")),
    Query("cards_merged_answered", _cards(True), q_cards("where j is null or r is not null")),
]
