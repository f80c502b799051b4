"""Flow and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..derived import check_sql
from ..operators.body import body_fields
from ..plans import flows as fw
from ..session import ensure_checkpoint_dir
from ..streaming import streams as st
from . import Query
from .chunking import CARD_CTES
from .scheduling import STATE_OUT, q_fold
from .similarity import STOPS
from .text import FLAGSHIP_SQL


def _folder(t) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def _table_stream(t, name: str):
    """A table as a stream of its file, or of the files in its folder."""
    table = t.spark.read.parquet(f"{t.folder}/{name}.parquet")
    reader = t.spark.readStream.schema(table.schema)
    if any(f"/{name}.parquet/" in path for path in table.inputFiles()):
        return reader.parquet(f"{t.folder}/{name}.parquet")
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(t.folder)


def _events_stream(t):
    return _table_stream(t, "events")


def _reviews_stream(t):
    e = _events_stream(t).withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    return e.selectExpr(
        "event_id", "user_id", "k * k div 100 as block_id", "1 + cents % 5 as rating", "cents % 600 as time_s", "ts", "event_id % 4 as qa_total", "greatest(event_id % 4 - event_id % 2, 0) as qa_correct")


def _stream_states(t):
    s = st.drain(st.review_states(_reviews_stream(t)), _folder(t))
    return s.select("user_id", "block_id", "status", "review_count", "lapses", "time_s", *[F.round(c, 6).alias(c) for c in ("avg_rating", "qa_score", "ease", "stability")], F.col("interval").alias("next_due_after"))


def _attempts_stream(t):
    e = _events_stream(t).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.selectExpr(
        "event_id", "user_id * 1000 + k * k div 100 as attempt_id", "case event_type when 'signup' then 'start' when 'view' then 'complete_segment' when 'click' then 'complete_segment' when 'error' then 'pause' else 'complete' end as action",
        "event_id % 5 as segment_index", "cast(round(value * 100) as bigint) % 600 as time_s", "ts")


def _shown(df):
    return df.select("attempt_id", "status", F.array_join("segments", ",").alias("segments"), "study_s")


ATTEMPT_SQL = check_sql("attempt_events", """select attempt_id, coalesce(arg_max(case action when 'start' then 'active' when 'pause' then 'paused' when 'complete' then 'completed' end, (ts, event_id)) filter (where action <> 'complete_segment'), 'active') as status,
  coalesce(array_to_string(list_sort(list_distinct(list(segment_index) filter (where action = 'complete_segment'))), ','), '') as segments, arg_max(time_s, (ts, event_id)) filter (where action = 'complete') as study_s
  from attempt_events group by attempt_id""")


def _ingested(t):
    folder = _folder(t)
    docs = _table_stream(t, "documents").select("doc_id", "text")
    st.ingest(docs, f"{folder}/known", f"{folder}/chunks").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{folder}/chunks").groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum("word_count").alias("n_words"), F.max("word_count").alias("longest"))


def _merged(t, enhanced: bool = False) -> str:
    """The folder of a merge of reports made of the reviews stream: some without a rating, some for unknown blocks."""
    folder = _folder(t)
    r = _reviews_stream(t).select(
        F.col("event_id").cast("string").alias("report_id"), "user_id", F.when(F.col("event_id") % 17 == 0, -1).otherwise(F.col("block_id")).alias("block_id"),
        F.when(F.col("event_id") % 13 != 0, F.col("rating")).cast("int").alias("proficiency_rating"), F.col("time_s").alias("time_spent_seconds"), F.col("ts").cast("timestamp").alias("completed_at"))
    writer = st.merge_progress(r, t.blocks, f"{folder}/states", f"{folder}/bad", f"{folder}/counts", enhanced=enhanced)
    writer.option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start().awaitTermination()
    return folder


def _synced(t):
    return t.spark.read.parquet(f"{_merged(t)}/counts").agg(F.sum("synced").alias("synced"), F.sum("errors").alias("errors"))


def _progress(enhanced: bool):
    def run(t):
        s = st.progress_versions(t.spark, f"{_merged(t, enhanced)}/states").current()
        return s.select("user_id", "block_id", "status", "review_count", "lapses", "time_s", *[F.round(c, 6).alias(c) for c in ("avg_rating", "ease", "stability")],
            F.coalesce(F.col("due_after_s") / 3600, F.lit(0)).cast("long").alias("due_hours"))
    return run


def progress_sql(enhanced: bool) -> str:
    """Reports one by one: a first one is stored as completed, or (enhanced) runs through the day schedule like all others."""
    rated = "coalesce(case when event_id % 13 <> 0 then rating end, 3)" if enhanced else "rating"
    kept = "event_id % 17 <> 0" + ("" if enhanced else " and event_id % 13 <> 0")
    first = """select user_id, block_id, 0::bigint as rn, 'new' as status, 0::bigint as n, 0::bigint as lapses, 0::bigint as time_s, null::double as avg_rating,
      2.5::double as ease, 1.0::double as stab, 0::bigint as due from o where rn = 1""" if enhanced else """select user_id, block_id, 1::bigint as rn, 'completed' as status, 1::bigint as n, 0::bigint as lapses, time_s, rating::double as avg_rating,
      2.5::double as ease, 1.0::double as stab, 0::bigint as due from o where rn = 1"""
    status = "'completed'" if enhanced else "case when o.rating < 3 then 'lapsed' else f.status end"
    return check_sql("reviews", f"""with recursive o as (select user_id, block_id, {rated} as rating, time_s, row_number() over (partition by user_id, block_id order by ts, event_id) as rn from reviews where {kept}),
  fold as ({first}
    union all
    select f.user_id, f.block_id, o.rn, {status}, f.n + 1, f.lapses + (o.rating < 3)::int, f.time_s + o.time_s,
      case when f.avg_rating is null then o.rating::double else f.avg_rating * 0.7::double + o.rating * 0.3::double end,
      case when o.rating = 5 then least(4.0::double, f.ease + 0.15::double) when o.rating = 4 then least(4.0::double, f.ease + 0.1::double) when o.rating = 3 then f.ease else greatest(1.3::double, f.ease - 0.2::double) end,
      case when o.rating < 3 then greatest(1.0::double, f.stab * 0.8::double) when f.status = 'new' then f.stab else greatest(1, trunc(f.stab * f.ease)) end,
      case when o.rating < 3 then 6 when f.status = 'new' then 24 else 24 * greatest(1, trunc(f.stab * f.ease)) end::bigint
    from fold f join o on o.user_id = f.user_id and o.block_id = f.block_id and o.rn = f.rn + 1)
  select user_id, block_id, status, n as review_count, lapses, time_s, round(avg_rating, 6) as avg_rating, round(ease, 6) as ease, round(stab, 6) as stability, due as due_hours
  from fold qualify row_number() over (partition by user_id, block_id order by rn desc) = 1""".replace("with recursive ", "with "), recursive=True)


def _new_since(t):
    return st.new_since(t.blocks, "2024-01-02 12:00:00").select("block_id", "title")


def _corpus(t):
    return fw.corpus(t.paragraph_docs, stop_words=STOPS)


def _communities(t):
    return _corpus(t).parts.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.sum("n_chunks").alias("n_chunks"), F.sum("word_count").alias("n_words"))


def _dedup(t):
    names = t.part.select(F.col("p_partkey").alias("block_id"), F.sha2("p_name", 256).alias("content_hash"))
    blocks = body_fields(t.block_bodies).select("block_id", "created_at", "objectives", "segments").join(names, "block_id").join(
        t.embeddings.select(F.col("vec_id").alias("block_id"), "embedding"), "block_id")
    survivors, _ = fw.with_dedup(blocks, 0.5)
    return survivors.select("block_id", "n_merged", F.coalesce(F.size("segments"), F.lit(0)).alias("n_segments"), "total_duration")


def _graph(t):
    blocks = t.blocks.join(t.embeddings.select(F.col("vec_id").alias("block_id")), "block_id", "left_semi")
    known = t.edges.where("rel_type = 'prerequisite'").selectExpr("src", "dst", "rel_type", "0.9D as confidence", "similarity", "0.8D as strength")
    out = fw.with_graph(blocks, t.embeddings, known, 0.35)
    return out["study_order"].select(F.col("node").alias("block_id"), "pos").join(out["cluster_order"].select("block_id", F.col("pos").alias("cluster_pos")), "block_id")


def _concept_run(t):
    run = fw.concept_flow(t.chunk_labels)
    return run.optimized.select("doc_id", "bin_order", "n_units", "word_count", F.round("reading_min", 6).alias("reading_min"), "title")


QUERIES = [
    Query("stream_block_state", _stream_states, check_sql("reviews", f"with {q_fold()} {STATE_OUT}, round(stab_b, 6) as stability, iv as next_due_after from final", recursive=True)),
    Query("stream_attempts", lambda t: _shown(st.drain(st.attempt_states(_attempts_stream(t)), _folder(t))), ATTEMPT_SQL),
    Query("attempt_rows", lambda t: _shown(st.attempt_rows(t.attempt_events)), ATTEMPT_SQL),
    Query("stream_ingest_totals", _ingested, FLAGSHIP_SQL),
    Query("stream_progress_counts", _synced, check_sql("reviews", "select count(*) filter (where event_id % 13 <> 0 and event_id % 17 <> 0) as synced, count(*) filter (where event_id % 13 = 0 or event_id % 17 = 0) as errors from reviews")),
    Query("stream_progress_states", _progress(False), progress_sql(False)),
    Query("stream_progress_states_enhanced", _progress(True), progress_sql(True)),
    Query("new_since", _new_since, check_sql("blocks", "select block_id, title from blocks where created_at > timestamp '2024-01-02 12:00:00'")),
    Query("corpus_communities", _communities, None),
    Query("corpus_run_report", lambda t: fw.run_report(t.documents, _corpus(t)), None),
    Query("deduplicated_blocks", _dedup, None),
    Query("graph_orders", _graph, None),
    Query("markdown_cards", lambda t: fw.cards(t.markdown_docs.select("path", "content"))[1], check_sql("markdown_docs", "with " + CARD_CTES + " select content_type, count(*) as n_cards, count(distinct source_file) as n_files from cards group by content_type")),
    Query("concept_run", _concept_run, None),
]
