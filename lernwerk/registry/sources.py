"""Source and sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..derived import check_sql
from ..operators import graph as gr
from ..sources import documents as ds, files as fl
from . import Query
from .dedup import EXACT_CTES, _exact
from .text import BODY_CTES, q_strip, q_words


def _uploads(t):
    k = F.col("doc_id")
    path = F.concat(F.lit("/up/"), F.col("source"), F.lit("/"), k.cast("string"), F.when(k % 3 == 0, ".pdf").when(k % 3 == 1, ".PDF").otherwise(".txt"))
    return fl.admit_uploads(t.documents.select(path.alias("path"), (F.col("n_chars") * 20000).alias("length")))


UPLOAD_CTES = """u as (select '/up/' || source || '/' || doc_id || case doc_id % 3 when 0 then '.pdf' when 1 then '.PDF' else '.txt' end as path, doc_id || case when doc_id % 3 < 2 then '' else '.txt' end as name, n_chars * 20000 as length, doc_id % 3 < 2 as p from documents),
  a as (select path, name, length, p and length <= 52428800 as accepted, case when not p then 'not a pdf' when length > 52428800 then 'too large' end as reason from u)"""


def _assembled(t):
    a = ds.assemble_pages(t.page_text)
    return a.select("doc_id", "page_count", "method", F.sha2("text", 256).alias("text_hash"))


ASSEMBLE_SQL = check_sql("page_text", f"""with t as (select doc_id, extractor, {q_strip("string_agg(page_text, chr(10) || chr(10) order by page_no)")} as text from page_text where page_text <> '' group by all),
  c as (select doc_id, max(page_no) + 1 as page_count from page_text group by doc_id)
  select doc_id, page_count, extractor as method, sha256(text) as text_hash from t join c using (doc_id) where length(text) >= 50 qualify row_number() over (partition by doc_id order by extractor) = 1""")


def _metrics(t):
    known = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return ds.load_metrics(t.documents, known)


def _pack(t):
    p = ds.study_pack(t.block_bodies, t.documents.select("doc_id", F.col("source").alias("name")))
    return p.select("doc_id", "pack_title", "block_count", "block_id", F.get_json_object("block", "$.title").alias("title"), F.get_json_object("block", "$.segments[0].title").alias("first_segment"), F.get_json_object("block", "$.qa_items[1].question").alias("second_question"))


PACK_SQL = check_sql("block_bodies", f"""with {BODY_CTES}, e as (select * from located where json_exists(j, '$.segments') and not starts_with(title, '[MIGRATED→'))
  select e.doc_id, coalesce(source, 'unknown') || '_study_pack' as pack_title, count(*) over (partition by e.doc_id) as block_count, block_id, title, segs->>'$[0].title' as first_segment, j->>'$.qa_items[1].question' as second_question
  from e left join documents d on d.doc_id = e.doc_id""")


def _sequence(t):
    order = gr.difficulty_order(t.blocks).select("block_id", "pos")
    return ds.master_sequence(t.blocks, order, t.completed)


SEQUENCE_SQL = check_sql("blocks completed", """with o as (select *, row_number() over (order by case difficulty when 'beginner' then 1 when 'intermediate' then 2 else 3 end, created_at, block_id) as sequence_number from blocks)
  select sequence_number, block_id, title, difficulty, block_id in (select block_id from completed) as is_completed from o""")


def _retained(t):
    docs = t.documents.select("doc_id", F.when(F.col("n_chars") < 800, "").otherwise(F.col("text")).alias("text"), (F.col("lang") == "en").alias("processed"),
                              (F.lit("2024-01-31 00:00:00").cast("timestamp_ntz") - F.make_dt_interval(hours=(F.col("doc_id") % 60).cast("int"))).alias("created_at"))
    return ds.retain(docs, "2024-01-31 00:00:00").groupBy("processed").agg(F.count("*").alias("n_docs"), F.sum("doc_id").alias("id_sum"))


def _cascade(t):
    gone = _exact(t).where("duplicate_of is not null")
    return ds.cascade_delete({"chunks": t.chunks, "labels": t.chunk_labels, "documents": t.documents}, gone)


def _kept(t):
    return _cascade(t)[0]["chunks"].select("doc_id", "chunk_order")


QUERIES = [
    Query("upload_admission", _uploads, f"with {UPLOAD_CTES} select * from a"),
    Query("upload_counts", lambda t: fl.admission_counts(_uploads(t)), f"with {UPLOAD_CTES} select accepted, count(*) as n_files, sum(length)::bigint as n_bytes from a group by accepted"),
    Query("folder_status", lambda t: fl.folder_status(t.markdown_docs.withColumn("path", F.concat(F.lit("notes/"), F.col("doc_id") % 7, F.lit("/"), "doc_id", F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".Markdown")))),
          "select 'notes/' || doc_id % 7 as folder, count(*) as total_files, true as valid from documents group by 1"),
    Query("page_assembly", _assembled, ASSEMBLE_SQL),
    Query("load_metrics", _metrics, f"select doc_id, sha256(text) as content_hash, len({q_words('text')})::bigint as n_words, strlen(text)::bigint as n_bytes from documents anti join labels using (doc_id)"),
    Query("study_pack", _pack, PACK_SQL),
    Query("master_sequence", _sequence, SEQUENCE_SQL),
    Query("retained_documents", _retained, "select lang = 'en' as processed, count(*) as n_docs, sum(doc_id)::bigint as id_sum from documents where not (doc_id % 60 > 24 and n_chars < 800 and lang <> 'en') group by 1"),
    Query("cascade_counts", lambda t: _cascade(t)[1], check_sql("chunks", f"""with {EXACT_CTES}, g as (select doc_id from exact where duplicate_of is not null)
      select 'chunks' as table_name, count(*) as deleted from chunks semi join g using (doc_id) union all select 'labels', count(*) from chunks semi join g using (doc_id) union all select 'documents', count(*) from documents semi join g using (doc_id)""")),
    Query("cascade_kept_chunks", _kept, check_sql("chunks", f"with {EXACT_CTES} select doc_id, chunk_order from chunks where doc_id not in (select doc_id from exact where duplicate_of is not null)")),
]
