"""Review-state, plan and sequence queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..derived import check_sql
from ..operators import scheduling as sc
from . import Query

AS_OF = "2024-01-31 00:00:00"
KEYS = ["user_id", "block_id"]

ORDERED = "o as (select *, row_number() over (partition by user_id, block_id order by ts, event_id) as rn from reviews)"
COMMON = """case when f.avg_rating is null then o.rating::double else f.avg_rating * 0.7::double + o.rating * 0.3::double end as avg_rating,
      case when o.qa_total = 0 then f.qa when f.qa is null then o.qa_correct::double / o.qa_total else f.qa * 0.6::double + (o.qa_correct::double / o.qa_total) * 0.4::double end as qa,
      case when o.rating = 5 then least(4.0::double, f.ease + 0.15::double) when o.rating = 4 then least(4.0::double, f.ease + 0.1::double) when o.rating = 3 then f.ease else greatest(1.3::double, f.ease - 0.2::double) end as ease"""
STATUS = "case when o.rating < 3 then 'lapsed' when f.status = 'new' then 'learning' when f.status = 'learning' then 'review' else f.status end"


def q_fold(first: str = "new", reviews: int = 0) -> str:
    """Both schedules in one recursion over the review number."""
    block = f"""greatest(1, trunc([1, 3, 7, 15, 30][least(f.n + 1, 5)] * [0.5, 0.7, 1.0, 1.3, 1.5][o.rating]::double * f.ease))"""
    return f"""{ORDERED},
  fold as (
    select user_id, block_id, 0::bigint as rn, '{first}' as status, {reviews}::bigint as n, 0::bigint as lapses, 0::bigint as time_s,
      {'null::double' if first == 'new' else '(arg_min(rating, rn))::double'} as avg_rating, null::double as qa, 2.5::double as ease, 1.0::double as stab_d, 1.0::double as stab_b, 0::bigint as iv, 0::bigint as days, null::timestamp as last
    from o group by user_id, block_id
    union all
    select f.user_id, f.block_id, o.rn, {STATUS} as status, f.n + 1, f.lapses + (o.rating < 3)::int, f.time_s + o.time_s, {COMMON},
      case when o.rating < 3 then greatest(1.0::double, f.stab_d * 0.8::double) when f.status in ('new', 'learning') then f.stab_d else greatest(1, trunc(f.stab_d * f.ease)) end,
      case when o.rating < 3 then greatest(1.0::double, f.stab_b * 0.8::double) when f.status in ('new', 'learning') then f.stab_b else {block} end,
      case when o.rating < 3 or f.status = 'new' then 1 when f.status = 'learning' then 3 else {block} end::bigint,
      case when o.rating < 3 then 0 when f.status = 'new' then 1 when f.status = 'learning' then 6 else greatest(1, trunc(f.stab_d * f.ease)) end::bigint, o.ts
    from fold f join o on o.user_id = f.user_id and o.block_id = f.block_id and o.rn = f.rn + 1),
  final as (select * from fold qualify row_number() over (partition by user_id, block_id order by rn desc) = 1)"""


COLS = ["review_count", "lapses", "time_s"]


def _rounded(df, *extra):
    return df.select(*KEYS, "status", *COLS, *[F.round(c, 6).alias(c) for c in ("avg_rating", "qa_score", "ease", "stability")], *extra)


def _day(t):
    s = sc.day_state(t.reviews)
    hours = F.timestamp_diff("HOUR", F.col("last_reviewed_at"), F.col("next_due_at"))
    return _rounded(s, hours.alias("due_hours"))


STATE_OUT = """select user_id, block_id, status, n as review_count, lapses, time_s, round(avg_rating, 6) as avg_rating, round(qa, 6) as qa_score, round(ease, 6) as ease"""


def _block(first):
    def run(t):
        return _rounded(sc.block_state(t.reviews, first), "next_due_after")
    return run


def _counter(t):
    states = sc.block_state(t.reviews)
    return sc.review_counter(t.reviews, states).select(*KEYS, "next_due_after", "studied_count")


COUNTER_SQL = check_sql("reviews", f"""with {q_fold()}
  select f.user_id, f.block_id, iv as next_due_after, least(iv, (select count(*) from reviews r where r.user_id = f.user_id and r.ts > f.last))::bigint as studied_count from final f""", recursive=True)

DUE = f"""case when next_due_after is not null then studied_count >= next_due_after when next_due_at is null then status = 'new' else next_due_at <= timestamp '{AS_OF}' end"""
LISTED = f"""(status = 'new' or (next_due_after is not null and studied_count >= next_due_after) or (next_due_after is null and {{timed}}))"""
LIST_ORDER = "row_number() over (partition by user_id order by next_due_after nulls last, next_due_at nulls last, status, block_id)"


def _flags(t):
    return sc.due_flags(t.states, AS_OF).select(*KEYS, "status", "is_due", "blocks_until_due", "days_until_due")


def _due(include):
    def run(t):
        return sc.due_list(t.states, AS_OF if include else "2024-02-01 12:00:00", include).select(*KEYS, "status", "next_due_after", "place")
    return run


def _fixed(t):
    return sc.fixed_schedule(t.attempts.where("status = 'completed'")).select("attempt_id", "block_id", "level", "interval_days")


def _master(t):
    return t.candidates.select("user_id", "block_id", "master_pos")


def _dynamic(t):
    return sc.dynamic_sequence(_master(t), t.states, t.completed)


DYNAMIC_SQL = check_sql("candidates states completed", """with
  f as (select m.user_id, m.block_id, m.master_pos, coalesce(s.status in ('completed', 'review', 'learning'), false) or c.block_id is not null as done, s.next_due_after, s.studied_count
    from candidates m left join states s using (user_id, block_id) left join completed c using (user_id, block_id)),
  r as (select *, row_number() over (partition by user_id order by master_pos) as i from f where done and next_due_after is not null),
  seq as (
    select user_id, 0::bigint as i, coalesce(list(block_id order by master_pos) filter (where not done), []) as s from f group by user_id
    union all
    select seq.user_id, r.i, list_concat(list_concat(s[1:least(p, len(s))], [r.block_id]), s[least(p, len(s)) + 1:]) from seq join r on r.user_id = seq.user_id and r.i = seq.i + 1,
      lateral (select greatest(r.next_due_after - r.studied_count, 0) as p) l),
  last as (select user_id, s from seq qualify row_number() over (partition by user_id order by i desc) = 1),
  out as (select user_id, unnest(s) as block_id, generate_subscripts(s, 1) as position from last)
  select o.user_id, o.block_id, case when done then 'review' else 'new' end as type, position::bigint as position from out o join f using (user_id, block_id)""", recursive=True)


def _interleaved(t):
    new = sc.new_blocks(_master(t), t.states, None)
    due = sc.due_flags(t.states, AS_OF).where("is_due").select(*KEYS, "blocks_until_due")
    return sc.interleave(new, due.join(_master(t), KEYS))


INTERLEAVE_SQL = check_sql("candidates states", f"""with
  n as (select user_id, block_id, row_number() over (partition by user_id order by master_pos) - 1 as k, count(*) over (partition by user_id) as nn from candidates c anti join states s using (user_id, block_id)),
  r as (select user_id, block_id, row_number() over (partition by user_id order by u, master_pos) - 1 as k, count(*) over (partition by user_id) as nr from (
    select user_id, block_id, case when next_due_after is null then 0 else next_due_after - studied_count end as u, {DUE} as d from states) s join candidates using (user_id, block_id) where d),
  x as (select user_id, block_id, 'new' as type, k + least(k // 3, coalesce((select any_value(nr) from r where r.user_id = n.user_id), 0)) as pos from n
    union all select user_id, block_id, 'review', k + least(3 * (k + 1), coalesce((select any_value(nn) from n where n.user_id = r.user_id), 0)) from r)
  select user_id, block_id, type, (pos + 1)::bigint as position from x""")


def q_quota(total: int, review: int) -> str:
    """The two walks over the master order, as counting windows over the whole catalogue."""
    return f"""select user_id, block_id, is_review, row_number() over (partition by user_id order by over, master_pos) as place from (
      select *, row_number() over (partition by user_id, is_review order by master_pos) > case when is_review then {review} else {total - review} end as over
      from (select m.*, c.block_id is not null as is_review from candidates m left join completed c using (user_id, block_id)) a) b qualify place <= {total}"""


def _simple(t):
    return sc.simple_plan(_master(t), t.completed)


def _next(t):
    plan = sc.quota_plan(_master(t), t.completed)
    return sc.next_block(plan, t.completed, 0)


def _suspended(t):
    ids = sc.struggling(t.states)
    return sc.suspend(t.states, ids).select(*KEYS, "status", "lapses")


def _reset(t):
    states = t.states.withColumn("ease", F.lit(1.9))
    return sc.reset_new(states, sc.struggling(states)).select(*KEYS, "status", "lapses", "review_count", "ease", "next_due_after", "studied_count")


WEAK = "(avg_rating < 2.5 or status = 'lapsed' or lapses >= 2)"


def _backfill_inputs(t):
    r = t.reviews.groupBy(*KEYS).agg(F.max_by("rating", F.struct("ts", "event_id")).alias("rating"), F.sum("time_s").alias("time_s"))
    return r, t.states.where("status in ('review', 'learning')"), t.blocks


def _backfilled(t):
    states, _ = sc.backfill(*_backfill_inputs(t), AS_OF)
    return states.select(*KEYS, "status", "lapses", "review_count", "time_s", F.round("avg_rating", 6).alias("avg_rating"), F.round("ease", 6).alias("ease"), "stability")


BACKFILL_CTES = """
  c as (select user_id, block_id, arg_max(rating, event_id) as rating, sum(time_s)::bigint as time_s from reviews group by all),
  s as (select * from states where status in ('review', 'learning')),
  j as (select c.*, b.block_id is not null as known, s.block_id is not null as has, s.avg_rating from c left join blocks b using (block_id) left join s using (user_id, block_id)),
  k as (select *, case when not known then 'skipped' when not has then 'created' when coalesce(avg_rating, 0) <> rating then 'updated' else 'skipped' end as kind from j)"""

QUERIES = [
    Query("srs_day_state", _day, check_sql("reviews", f"""with {q_fold()} {STATE_OUT}, round(stab_d, 6) as stability,
      case when days = 0 then 6 else days * 24 end::bigint as due_hours from final""", recursive=True)),
    Query("srs_block_state", _block("learning"), check_sql("reviews", f"with {q_fold()} {STATE_OUT}, round(stab_b, 6) as stability, iv as next_due_after from final", recursive=True)),
    Query("srs_block_state_seeded", _block("completed"), check_sql("reviews", f"with {q_fold('completed', 1)} {STATE_OUT}, round(stab_b, 6) as stability, iv as next_due_after from final", recursive=True)),
    Query("review_counter", _counter, COUNTER_SQL),
    Query("due_flags", _flags, check_sql("states", f"""select user_id, block_id, status, {DUE} as is_due, case when next_due_after is null then 0 else next_due_after - studied_count end as blocks_until_due,
      coalesce(floor(epoch(next_due_at - timestamp '{AS_OF}') / 86400), 0)::bigint as days_until_due from states""")),
    Query("due_blocks", _due(True), check_sql("states", f"select user_id, block_id, status, next_due_after, {LIST_ORDER} as place from states where " + LISTED.format(timed=f"next_due_at <= timestamp '{AS_OF}'"))),
    Query("due_blocks_today", _due(False), check_sql("states", f"select user_id, block_id, status, next_due_after, {LIST_ORDER} as place from states where " + LISTED.format(timed="next_due_at::date = date '2024-02-01'"))),
    Query("struggling_blocks", lambda t: sc.struggling(t.states).select(*KEYS, "avg_rating", "lapses", "place"),
          check_sql("states", f"select user_id, block_id, avg_rating, lapses, row_number() over (partition by user_id order by avg_rating nulls last, lapses desc, block_id) as place from states where {WEAK}")),
    Query("new_blocks", lambda t: sc.new_blocks(t.candidates, t.states, t.completed).select(*KEYS, "master_pos"),
          check_sql("candidates states completed", "select user_id, block_id, master_pos from candidates c anti join states s using (user_id, block_id) anti join completed d on d.user_id = c.user_id and d.block_id = c.block_id")),
    Query("fixed_schedule", _fixed, check_sql("attempts", """with l as (select attempt_id, block_id, proficiency, least(row_number() over (partition by block_id order by completed_at, attempt_id) - 1, 4) as level from attempts where status = 'completed')
      select attempt_id, block_id, level, floor([1, 3, 7, 21, 52][level + 1] * [0.5, 0.7, 1.0, 1.3, 1.5][proficiency]::double)::bigint as interval_days from l""")),
    Query("dynamic_sequence", _dynamic, DYNAMIC_SQL),
    Query("interleaved_sequence", _interleaved, INTERLEAVE_SQL),
    Query("quota_plan", lambda t: sc.quota_plan(_master(t), t.completed), check_sql("candidates completed", q_quota(8, 2))),
    Query("simple_plan", _simple, check_sql("candidates completed", """select user_id, block_id, row_number() over (partition by user_id order by master_pos) as place
      from candidates anti join completed using (user_id, block_id) qualify place <= 8""")),
    Query("preset_plans", lambda t: sc.preset_plans(_master(t), t.completed), check_sql("candidates completed", " union all ".join(
        f"select *, '{name}' as preset from ({q_quota(max(1, m // 7), int(max(1, m // 7) * r))}) p_{name}" for name, (m, r) in sc.PRESETS.items()))),
    Query("next_block", _next, check_sql("candidates completed", f"""with p as ({q_quota(8, 2)}),
      f as (select user_id, arg_min(block_id, place) as b, min(place) as pl from p anti join completed using (user_id, block_id) group by user_id)
      select user_id, b as next_block_id, pl as next_place, case when b is null then 'completed' else 'active' end as status from (select distinct user_id from p) u left join f using (user_id)""")),
    Query("unlock_status", lambda t: sc.unlock_status(_master(t), t.completed), check_sql("candidates completed", """with d as (select m.user_id, m.block_id, master_pos, c.block_id is not null as done from candidates m left join completed c using (user_id, block_id)),
      w as (select *, coalesce(bool_and(done) over (partition by user_id order by master_pos rows between unbounded preceding and 1 preceding), true) as open from d)
      select user_id, block_id, master_pos, case when done then 'completed' when open then 'available' else 'locked' end as status from w""")),
    Query("unlock_counts", lambda t: sc.unlock_counts(sc.unlock_status(_master(t), t.completed)), check_sql("candidates completed", """with d as (select m.user_id, master_pos, c.block_id is not null as done from candidates m left join completed c using (user_id, block_id)),
      w as (select *, coalesce(bool_and(done) over (partition by user_id order by master_pos rows between unbounded preceding and 1 preceding), true) as open from d)
      select user_id, count(*) filter (where done) as n_completed, count(*) filter (where not done and open) as n_available, count(*) filter (where not done and not open) as n_locked from w group by user_id""")),
    Query("suspended_states", _suspended, check_sql("states", f"select user_id, block_id, case when {WEAK} then 'suspended' else status end as status, lapses from states")),
    Query("reset_states", _reset, check_sql("states", f"""select user_id, block_id, case when {WEAK} then 'new' else status end as status, case when {WEAK} then 0 else lapses end as lapses, case when {WEAK} then 0 else review_count end as review_count,
      case when {WEAK} then 2.5 else 1.9 end::double as ease, case when {WEAK} then null else next_due_after end as next_due_after, case when {WEAK} then 0 else studied_count end as studied_count from states""")),
    Query("backfilled_states", _backfilled, check_sql("reviews states blocks", f"""with {BACKFILL_CTES}
      select s.user_id, s.block_id, s.status, lapses, review_count, s.time_s + coalesce(k.time_s, 0) as time_s, round(coalesce(k.rating, s.avg_rating), 6)::double as avg_rating, null::double as ease, null::double as stability
        from s left join k on k.user_id = s.user_id and k.block_id = s.block_id and kind = 'updated'
      union all select user_id, block_id, case when rating >= 3 then 'review' else 'lapsed' end, case when rating >= 3 then 0 else 1 end, 2, time_s * 2, rating::double,
        case when rating = 5 then 2.65 when rating = 4 then 2.6 when rating = 3 then 2.5 else 2.3 end::double, case when rating >= 3 then 2 else 1 end::double from k where kind = 'created'""")),
    Query("backfill_counts", lambda t: sc.backfill(*_backfill_inputs(t), AS_OF)[1], check_sql("reviews states blocks", f"with {BACKFILL_CTES} select kind, count(*) as n from k group by kind")),
]
