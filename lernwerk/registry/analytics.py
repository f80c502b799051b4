"""Progress and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..derived import check_sql
from ..operators import analytics as an, concepts as cp, scheduling as sc
from ..operators.body import body_fields
from . import Query
from .concepts import GROUP_CTES, UNIT_CTES
from .dedup import EXACT_CTES, _exact
from .scheduling import AS_OF, DYNAMIC_SQL, KEYS, LIST_ORDER, LISTED, WEAK, _dynamic, _master, q_quota
from .text import BODY_CTES


def _board(t):
    return an.dashboard(t.states, AS_OF, sc.new_blocks(_master(t), t.states, t.completed))


def _out_board(t):
    b = _board(t)
    return b.withColumn("mean_rating", F.round("mean_rating", 6)).select(*[F.array_join(c, ",").alias(c) if c in ("due", "struggling", "new") else c for c in b.columns])


BOARD_CTES = f"""
  d as (select user_id, block_id, {LIST_ORDER} as place from states where {LISTED.format(timed=f"next_due_at <= timestamp '{AS_OF}'")}),
  s as (select user_id, block_id, row_number() over (partition by user_id order by avg_rating nulls last, lapses desc, block_id) as place from states where {WEAK}),
  n as (select user_id, block_id, row_number() over (partition by user_id order by master_pos) as place from candidates c anti join states x using (user_id, block_id) anti join completed y on y.user_id = c.user_id and y.block_id = c.block_id),
  hd as (select user_id, string_agg(block_id, ',' order by place) as due, count(*) as n_due from d where place <= 10 group by user_id),
  hs as (select user_id, string_agg(block_id, ',' order by place) as struggling, count(*) as n_struggling from s where place <= 5 group by user_id),
  hn as (select user_id, string_agg(block_id, ',' order by place) as new, count(*) as n_new from n where place <= 10 group by user_id),
  board as (select user_id, studied, mean_rating, excellent, good, needs_work, coalesce(due, '') as due, coalesce(n_due, 0) as n_due, coalesce(struggling, '') as struggling, coalesce(n_struggling, 0) as n_struggling,
      coalesce(new, '') as new, coalesce(n_new, 0) as n_new
    from (select user_id, count(*) as studied, round(avg(avg_rating), 6) as mean_rating, count(*) filter (where avg_rating >= 4.5) as excellent, count(*) filter (where avg_rating >= 3.5 and avg_rating < 4.5) as good,
      count(*) filter (where avg_rating < 3.5) as needs_work from states group by user_id) a left join hd using (user_id) left join hs using (user_id) left join hn using (user_id))"""


def _recommended(t):
    r = an.recommendations(_board(t))
    return r.select("user_id", F.array_join("kinds", ",").alias("kinds"), F.array_join("titles", "|").alias("titles"))


RECOMMEND_SQL = check_sql("states candidates completed", f"""with {BOARD_CTES}
  select user_id, coalesce(nullif(concat_ws(',', case when n_struggling > 0 then 'warning' end, case when n_due > 5 then 'info' end, case when mean_rating > 4 then 'success' end), ''), 'info') as kinds,
    coalesce(nullif(concat_ws('|', case when n_struggling > 0 then n_struggling || ' blocks need attention' end, case when n_due > 5 then n_due || ' blocks due for review' end,
      case when mean_rating > 4 then 'Excellent progress!' end), ''), 'Ready to start learning!') as titles from board""")


def _micros(c):
    return F.timestamp_diff("MICROSECOND", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col(c))


def _completions(t):
    s = an.completion_stats(t.attempts, t.blocks)
    return s.withColumn("last_completed", _micros("last_completed")).withColumn("mean_time", F.round("mean_time", 6))


COMPLETION_SQL = check_sql("attempts blocks", """with c as (select block_id, count(*) as completions, epoch_us(max(completed_at)) - epoch_us(timestamp '2024-01-01') as last_completed, arg_max(proficiency, (completed_at, attempt_id)) as last_proficiency,
    sum(coalesce(study_s, 0)) / count(*) as mean_time from attempts where status = 'completed' group by block_id)
  select b.block_id, coalesce(completions, 0) as completions, last_completed, last_proficiency, coalesce(round(mean_time, 6), 0) as mean_time, case when completions is null then 'new' else 'completed' end as category
  from blocks b left join c using (block_id)""")


def _units(t):
    return cp.reading_time(cp.concept_units(cp.concept_groups(t.chunk_labels)))


def _catalogue(t):
    return an.catalogue(t.documents.select("doc_id"), t.blocks, t.chunks, _units(t))


CATALOGUE_SQL = check_sql("blocks chunk_labels", f"""with {GROUP_CTES},
  b as (select doc_id, count(*) as n from blocks group by doc_id), c as (select doc_id, count(*) as n from chunks group by doc_id), u as (select doc_id, count(distinct concept_order) as n from grouped group by doc_id)
  select d.doc_id, coalesce(b.n, 0) as n_blocks, coalesce(c.n, 0) as n_chunks, coalesce(u.n, 0) as n_units, coalesce(b.n, 0) * 7 as minutes, coalesce(b.n, 0) > 0 as ready
  from documents d left join b using (doc_id) left join c using (doc_id) left join u using (doc_id)""")


def _status_docs(t):
    """Copies are duplicates, short documents unprocessed, code-like sources in error."""
    dup = _exact(t).select("doc_id", F.col("duplicate_of").isNotNull().alias("is_duplicate"))
    return t.documents.select("doc_id", F.col("source").alias("name"), (F.col("n_chars") >= 500).alias("processed"), F.when(F.col("n_chars") < 100, "short").otherwise("").alias("error")).join(dup, "doc_id")


STATUS_CTES = EXACT_CTES + """, sd as (select d.doc_id, source as name, n_chars >= 500 as processed, case when n_chars < 100 then 'short' else '' end as error, duplicate_of is not null as is_duplicate from documents d join exact using (doc_id))"""


def q_status(compat: bool) -> str:
    ready = "sum(case when processed and u.n is not null then u.n else 0 end)::bigint" if compat else "count(*) filter (where processed and u.n is not null)"
    return check_sql("chunk_labels", f"""with {GROUP_CTES}, {STATUS_CTES}, u as (select doc_id, count(distinct concept_order) as n from grouped group by doc_id)
      select count(*) as total, {ready} as ready, count(*) filter (where not processed) as processing, count(*) filter (where is_duplicate) as duplicates, count(*) filter (where error <> '') as errors from sd left join u using (doc_id)""")


def _listing(t):
    return an.list_documents(_status_docs(t), _units(t), "ready", "SRC1").select("doc_id", "name", "is_duplicate")


def _labelled(t):
    """Every third label is missing, so that orphans and unlabelled chunks occur."""
    return cp.concept_groups(t.chunk_labels).where("confidence >= 0.3")


def _report(t):
    r = an.processing_report(t.documents, t.chunks, _labelled(t), _units(t))
    return r.withColumn("total_minutes", F.round("total_minutes", 6)).withColumn("mean_minutes", F.round("mean_minutes", 6))


REPORT_SQL = check_sql("chunk_labels", f"""with {UNIT_CTES}, lb as (select * from grouped where confidence >= 0.3),
  c as (select doc_id, count(*) as n_chunks, count(*) filter (where l.chunk_order is null) as unlabelled_chunks, count(l.chunk_order) as n_labels from chunks left join lb l using (doc_id, chunk_order) group by doc_id),
  u as (select t.doc_id, count(*) as n_units, sum(reading_min) as total_minutes, count(*) filter (where l.concept_order is null) as orphan_units from timed t left join (select distinct doc_id, concept_order from lb) l using (doc_id, concept_order) group by t.doc_id)
  select d.doc_id, coalesce(n_chunks, 0) as n_chunks, coalesce(n_labels, 0) as n_labels, coalesce(n_units, 0) as n_units, coalesce(round(total_minutes, 6), 0) as total_minutes, coalesce(orphan_units, 0) as orphan_units,
    coalesce(unlabelled_chunks, 0) as unlabelled_chunks, coalesce(round(total_minutes / n_units, 6), 0) as mean_minutes from documents d left join c using (doc_id) left join u using (doc_id)""")


def _breakdown(t):
    b = an.unit_breakdown(_labelled(t))
    return b.select("doc_id", "concept_order", "n_chunks", F.round("mean_confidence", 6).alias("mean_confidence"), F.array_join("labels_used", ",").alias("labels_used"), F.array_join("keywords", ",").alias("keywords"))


BREAKDOWN_SQL = check_sql("chunk_labels", f"""with {GROUP_CTES}
  select doc_id, concept_order, count(*) as n_chunks, round(avg(confidence), 6) as mean_confidence, array_to_string(list_sort(list_distinct(list(primary_label))), ',') as labels_used,
    array_to_string(list_sort(list_distinct(flatten(list(keywords)))), ',') as keywords from grouped where confidence >= 0.3 group by all""")


def _reconciled(t):
    return an.reconcile(t.completed.select("block_id"), t.states.where("status = 'completed'").select("block_id"))


def _progress(t):
    return an.corpus_progress(body_fields(t.block_bodies), t.edges_once).withColumn("hours", F.round("hours", 6))


FORMAT = """case when starts_with(title, '[MIGRATED→') then 'migrated' when list_contains(k, 'segments') then 'new'
  when j->>'$.template' = 'compact7' and len(list_intersect(k, ['revision', 'core', 'qa', 'recap', 'rescue'])) > 0 then 'old' when script <> '' then 'legacy' else 'empty' end"""
FORMAT_CTES = f"""p as (select *, case when json_valid(body) then cast(body as json) end as j from block_bodies), f as (select *, {FORMAT} as f from (select *, json_keys(j) as k from p) x)"""
FORMAT_OUT = "count(*) as total, " + ", ".join(f"count(*) filter (where f = '{k}') as n_{k}" for k in ("migrated", "new", "old", "legacy", "empty")) + ", count(*) filter (where f in ('old', 'legacy')) as pending"


def _audit(t):
    return an.audit(t.documents, _units(t), cp.concept_groups(t.chunk_labels).where("confidence >= 0.8"))


def _log(t):
    return an.completion_log(t.attempts, t.blocks).withColumn("completed_at", _micros("completed_at"))


def _due_calendar(t):
    return an.review_calendar(t.states, AS_OF)[0].select(*KEYS, "days_overdue")


def _upcoming(t):
    return an.review_calendar(t.states, AS_OF)[1].withColumn("due_date", F.col("due_date").cast("string"))


def _shifted(t):
    s = an.shift_reviews(t.states, sc.struggling(t.states), 3)
    return s.select(*KEYS, F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), F.col("next_due_at")).alias("due_hour"))


def _incomplete(t):
    return an.incomplete(sc.quota_plan(_master(t), t.completed), t.completed)


def _segment_progress(t):
    blocks = body_fields(t.block_bodies).select("block_id", F.size("segments").cast("long").alias("n_segments"))
    done = t.attempt_events.where("action = 'complete_segment'").groupBy(F.col("user_id").alias("session_id"), "block_id").agg(F.collect_set("segment_index").alias("segments_done"))
    return an.segment_progress(done, blocks).withColumn("percent", F.round("percent", 6))


def _session_progress(t):
    return an.session_progress(t.completed.withColumnRenamed("user_id", "session_id"), t.blocks)


def _attempt_stats(t):
    s = an.attempt_stats(t.attempts)
    return s.withColumn("mean_study_s", F.round("mean_study_s", 6)).withColumn("mean_proficiency", F.round("mean_proficiency", 6))


def _confusion(t):
    return an.confusion_histogram(t.attempts.withColumn("confusion", F.filter(F.split("confusion", ","), lambda x: x != "")))


def _sample(t):
    """Blocks as cards, their documents as folders, learners as sessions."""
    cards = t.blocks.select(F.col("block_id").alias("card_id"), F.col("doc_id").alias("folder_id"))
    sessions = t.reviews.join(t.blocks.select("block_id", "doc_id"), "block_id").groupBy(F.col("user_id").alias("session_id")).agg(F.min("doc_id").alias("folder_id"))
    return an.unseen_sample(cards, sessions, t.reviews.select(F.col("user_id").alias("session_id"), F.col("block_id").alias("card_id")))


SAMPLE_SQL = check_sql("reviews blocks", """with s as (select user_id as session_id, min(doc_id) as folder_id from reviews join blocks using (block_id) group by user_id),
  p as (select s.session_id, b.block_id as card_id, exists (select 1 from reviews r where r.user_id = s.session_id and r.block_id = b.block_id) as seen from s join blocks b on b.doc_id = s.folder_id),
  f as (select *, count(*) filter (where not seen) over (partition by session_id) as fresh from p)
  select session_id, card_id, row_number() over (partition by session_id order by md5('42-' || session_id || '-' || card_id), card_id) as place, fresh = 0 as restarted from f where not seen or fresh = 0 qualify place <= 10""")


def _cards(t):
    """Parts as cards: some belong to a supplier folder, some to a document, some to neither."""
    k = F.col("p_partkey")
    cards = t.part.select(k.alias("card_id"), F.when(k % 3 == 0, k % 150).alias("folder_id"), F.when(k % 3 == 1, k).alias("doc_id"), F.element_at(F.split(F.lit("beginner,intermediate,advanced"), ","), (F.col("p_size") % 3 + 1).cast("int")).alias("difficulty"))
    return an.card_catalogue(cards, t.supplier.select(F.col("s_suppkey").alias("folder_id"), F.col("s_name").alias("name")), t.documents.select("doc_id", F.col("source").alias("name")))


CARDS_CTES = """c as (select p_partkey as card_id, case when p_partkey % 3 = 0 then p_partkey % 150 end as folder_id, case when p_partkey % 3 = 1 then p_partkey end as doc_id, ['beginner', 'intermediate', 'advanced'][p_size % 3 + 1] as difficulty from part),
  listed as (select card_id, difficulty, case when s_name is not null then 'folder' when source is not null then 'document' else 'unknown' end as source_type, coalesce(s_name, source, 'Unknown') as source_name
    from c left join supplier on s_suppkey = folder_id left join documents d on d.doc_id = c.doc_id)"""


def _summary(denominator):
    def run(t):
        s = an.sequence_summary(_dynamic(t), t.reviews, denominator)
        return s.withColumn("next_blocks", F.array_join("next_blocks", ",")).withColumn("progress_percent", F.round("progress_percent", 6))
    return run


def q_summary(base: str) -> str:
    head, tail = DYNAMIC_SQL.rsplit("select o.user_id, o.block_id", 1)
    return head.rstrip() + f""", sq as (select o.user_id, o.block_id{tail}), rv as (select user_id, count(*) as studied from reviews group by user_id)
      select user_id, count(*) as length, count(*) filter (where type = 'new') as n_new, count(*) filter (where type = 'review') as n_review, string_agg(block_id, ',' order by position) filter (where position <= 5) as next_blocks,
        any_value(studied) as studied, round(any_value(studied)::double / {base} * 100, 6) as progress_percent, count(*) * 7 as minutes from sq join rv using (user_id) group by user_id"""


QUERIES = [
    Query("learner_dashboard", _out_board, check_sql("states candidates completed", f"with {BOARD_CTES} select * from board")),
    Query("recommendations", _recommended, RECOMMEND_SQL),
    Query("block_completion_stats", _completions, COMPLETION_SQL),
    Query("document_catalogue", _catalogue, CATALOGUE_SQL),
    Query("status_counts", lambda t: an.status_counts(_status_docs(t), _units(t)), q_status(False)),
    Query("status_counts_joined", lambda t: an.status_counts(_status_docs(t), _units(t), True), q_status(True)),
    Query("document_listing", _listing, check_sql("chunk_labels", f"with {STATUS_CTES} select doc_id, name, is_duplicate from sd semi join chunk_labels using (doc_id) where processed and contains(lower(name), 'src1')")),
    Query("processing_report", _report, REPORT_SQL),
    Query("unit_breakdown", _breakdown, BREAKDOWN_SQL),
    Query("label_distribution", lambda t: an.label_distribution(t.chunk_labels), check_sql("chunk_labels", "select primary_label, count(*) as n, round(count(*) * 100.0::double / sum(count(*)) over (), 1) as percentage from chunk_labels group by primary_label")),
    Query("completion_reconciliation", _reconciled, check_sql("completed states", """with a as (select distinct block_id from completed), b as (select distinct block_id from states where status = 'completed'), u as (select block_id from a union select block_id from b)
      select (select count(*) from a) as in_a, (select count(*) from b) as in_b, (select count(*) from u) as merged, (select count(*) from a anti join b using (block_id)) as only_a, (select count(*) from b anti join a using (block_id)) as only_b,
        (select count(*) from u) > (select count(*) from a) as sync_working""")),
    Query("corpus_progress", _progress, check_sql("block_bodies edges", f"""with {BODY_CTES} select (select count(*) from block_bodies) as n_blocks, (select count(*) from seg) as n_segments, (select round(sum(duration_s) / 3600.0::double, 6) from block_bodies) as hours,
      count(*) as n_edges, count(*) filter (where rel_type = 'prerequisite') as n_prerequisite, count(*) filter (where rel_type = 'builds_on') as n_builds_on, count(*) filter (where rel_type = 'related') as n_related from edges""")),
    Query("format_stats", lambda t: an.format_stats(t.block_bodies), check_sql("block_bodies", f"with {FORMAT_CTES} select {FORMAT_OUT} from f")),
    Query("format_stats_by_document", lambda t: an.format_stats(t.block_bodies, True), check_sql("block_bodies", f"with {FORMAT_CTES} select doc_id, {FORMAT_OUT} from f group by doc_id")),
    Query("inconsistent_documents", _audit, check_sql("chunk_labels", f"with {GROUP_CTES} select doc_id, count(distinct concept_order) as n_units from grouped where doc_id not in (select doc_id from grouped where confidence >= 0.8) group by doc_id")),
    Query("completion_log", _log, check_sql("attempts blocks", """with r as (select block_id, title, row_number() over (order by doc_id, block_order, block_id) - 1 as block_index from blocks)
      select attempt_id, block_id, title, block_index, proficiency, study_s, epoch_us(completed_at) - epoch_us(timestamp '2024-01-01') as completed_at from attempts join r using (block_id) where status = 'completed'""")),
    Query("review_calendar", _due_calendar, check_sql("states", f"""select user_id, block_id, floor(epoch(date_trunc('day', timestamp '{AS_OF}') - next_due_at) / 86400)::bigint as days_overdue from states where next_due_at::date <= date '{AS_OF[:10]}'""")),
    Query("upcoming_reviews", _upcoming, check_sql("states", f"""select user_id, next_due_at::date::varchar as due_date, count(*) as n_reviews from states where next_due_at > timestamp '{AS_OF}' and next_due_at <= timestamp '{AS_OF}' + interval 30 day group by all""")),
    Query("shifted_reviews", _shifted, check_sql("states", f"""select user_id, block_id, (epoch(next_due_at - timestamp '2024-01-01') // 3600 + case when {WEAK} then 72 else 0 end)::bigint as due_hour from states""")),
    Query("incomplete_plans", _incomplete, check_sql("candidates completed", f"""with p as ({q_quota(8, 2)}), m as (select p.user_id, count(*) as planned, count(c.block_id) as completed from p left join completed c using (user_id, block_id) group by p.user_id)
      select m.user_id, planned, completed, completed * 100 // planned as percent, block_id as next_block_id from m join p on p.user_id = m.user_id and place = completed + 1 where completed < planned""")),
    Query("segment_progress", _segment_progress, check_sql("attempt_events block_bodies", f"""with {BODY_CTES}, s as (select b.block_id, count(i) as n from block_bodies b left join seg using (block_id) group by b.block_id)
      select user_id as session_id, a.block_id, case when any_value(n) > 0 then round(count(distinct segment_index) * 100.0::double / any_value(n), 6) else 0 end as percent from attempt_events a join s using (block_id) where action = 'complete_segment' group by all""")),
    Query("session_progress", _session_progress, check_sql("completed blocks", """with n as (select doc_id, count(*) as n_blocks from blocks group by doc_id)
      select user_id as session_id, doc_id, count(*) as n_done, any_value(n_blocks) as n_blocks, round(count(*)::double / any_value(n_blocks) * 100, 1) as percent from completed join blocks using (block_id) join n using (doc_id) group by all""")),
    Query("attempt_stats", _attempt_stats, check_sql("attempts", """select block_id, count(*) as n_attempts, count(*) filter (where status = 'completed') as n_completed, round(avg(study_s) filter (where status = 'completed'), 6) as mean_study_s,
      round(avg(proficiency) filter (where status = 'completed'), 6) as mean_proficiency from attempts group by block_id""")),
    Query("confusion_histogram", _confusion, check_sql("attempts", "select point, count(*) as n from (select unnest(list_filter(string_split(confusion, ','), lambda x: x <> '')) as point from attempts where status = 'completed') x group by point")),
    Query("latest_open_attempts", lambda t: an.latest_open(t.attempts), check_sql("attempts", "select user_id, attempt_id, block_id, status from attempts where status in ('active', 'paused') qualify row_number() over (partition by user_id order by completed_at desc, attempt_id desc) = 1")),
    Query("unseen_cards", _sample, SAMPLE_SQL),
    Query("order_totals", lambda t: an.order_totals(t.blocks), check_sql("blocks", "select count(*) as n_blocks, sum(duration_s) / 60.0::double as total_minutes, greatest(1, floor(sum(duration_s) / 60.0 / 120))::bigint as days from blocks")),
    Query("card_catalogue", _cards, f"with {CARDS_CTES} select * from listed"),
    Query("card_counts", lambda t: an.card_counts(_cards(t), "advanced"), f"with {CARDS_CTES} select source_type, source_name, count(*) as n_cards from listed where difficulty = 'advanced' group by all"),
    Query("sequence_summary", _summary(None), q_summary("count(*)")),
    Query("sequence_summary_fixed", _summary(an.PLANNED_TOTAL), q_summary("32")),
]
