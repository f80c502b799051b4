"""Chunking and card queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..derived import check_sql
from ..operators import chunking as ck
from . import Query
from .text import q_clean_markdown, q_content_type, q_strip, q_words

def _hash(df, *keys):
    return df.select(*keys, F.sha2("chunk_text", 256).alias("text_hash"))


def _fixed(t):
    return _hash(ck.fixed_chunks(t.documents.select("doc_id", "text")), "doc_id", "chunk_order", "word_start", "word_end", "word_count")


FIXED_SQL = f"""with w as (select doc_id, {q_words('text')} as w from documents),
  c as (select doc_id, w, unnest(range(0, (len(w) + 299) // 300)) as c from w)
  select doc_id, (c + 1)::bigint as chunk_order, (c * 300 + 1)::bigint as word_start, least(c * 300 + 300, len(w))::bigint as word_end,
    (least(c * 300 + 300, len(w)) - c * 300)::bigint as word_count, sha256(array_to_string(w[c * 300 + 1:c * 300 + 300], ' ')) as text_hash from c"""


def _sentences(t):
    return _hash(ck.sentence_chunks(t.documents.select("doc_id", "text")), "doc_id", "chunk_order", "word_start", "word_end", "word_count")


SENTENCE_SQL = f"""with recursive d as (select doc_id, text, w, len(w) as n from (select doc_id, text, {q_words('text')} as w from documents) x where len(w) > 0),
  cuts as (
    select doc_id, -1::bigint as k, 0::bigint as a, 0::bigint as b from d
    union all
    select c.doc_id, c.k + 1, c.b,
      case when c.b + 350 >= d.n then d.n else coalesce(
        list_max(list_filter(range(c.b + 301, c.b + 351), lambda i: right(d.w[i], 1) in ('.', '!', '?'))), c.b + 350) end::bigint
    from cuts c join d using (doc_id) where c.b < d.n)
  select doc_id, k as chunk_order, a as word_start, b as word_end, b - a as word_count,
    sha256(case when n <= 350 then text else array_to_string(w[a + 1:b], ' ') end) as text_hash
  from cuts join d using (doc_id) where k >= 0"""


def _paragraphs(t):
    return _hash(ck.pack_paragraphs(t.paragraph_docs), "doc_id", "chunk_order", "word_count")


PARAGRAPH_CTES = f"""
  p as (select doc_id, row_number() over (partition by doc_id order by i) as i, {q_strip('p')} as p
        from (select doc_id, unnest(ps) as p, generate_subscripts(ps, 1) as i from (select doc_id, string_split(text, chr(10) || chr(10)) as ps from paragraph_docs) a) b
        where {q_strip('p')} <> ''),
  pw as (select doc_id, i, p, len({q_words('p')}) as n from p),
  fold as (
    select doc_id, i, n as total, 0 as g from pw where i = 1
    union all
    select f.doc_id, w.i, case when f.total + w.n > 800 and f.total >= 100 then w.n else f.total + w.n end,
      f.g + case when f.total + w.n > 800 and f.total >= 100 then 1 else 0 end
    from fold f join pw w on w.doc_id = f.doc_id and w.i = f.i + 1),
  packed as (select doc_id, g::bigint as chunk_order, sum(n)::bigint as word_count, string_agg(p, chr(10) || chr(10) order by i) as chunk_text
             from fold join pw using (doc_id, i) group by doc_id, g)"""
PARAGRAPH_SQL = check_sql("paragraph_docs", f"""with {PARAGRAPH_CTES}
  select doc_id, chunk_order, word_count, sha256(chunk_text) as text_hash from packed""", recursive=True)


def _large(t):
    """Runs of eight 50-word chunks stand in for communities, so both limits and the plain case occur."""
    c = t.chunks.withColumn("community_id", F.floor(F.col("chunk_order") / (4 + F.col("doc_id") % 30)))
    communities = c.groupBy("doc_id", "community_id").agg(
        F.sum("word_count").alias("word_count"),
        F.array_sort(F.collect_list(F.struct("chunk_order", "chunk_text", F.col("word_count").alias("n_words")))).alias("chunks"),
    )
    return ck.split_large(communities).withColumn("text_hash", F.sha2("combined_text", 256)).drop("combined_text")


LARGE_SQL = check_sql("chunks", """with
  m as (select *, chunk_order // (4 + doc_id % 30) as community_id from chunks),
  o as (select *, row_number() over (partition by doc_id, community_id order by chunk_order) as i,
          sum(word_count) over (partition by doc_id, community_id) > 1500 or count(*) over (partition by doc_id, community_id) > 6 as large from m),
  fold as (
    select doc_id, community_id, i, word_count::bigint as total, 0 as g from o where i = 1
    union all
    select f.doc_id, f.community_id, o.i, case when o.large and f.total + o.word_count > 800 then o.word_count else f.total + o.word_count end,
      f.g + case when o.large and f.total + o.word_count > 800 then 1 else 0 end
    from fold f join o on o.doc_id = f.doc_id and o.community_id = f.community_id and o.i = f.i + 1)
  select doc_id, community_id, g::bigint as part, count(*) as n_chunks, sum(word_count)::bigint as word_count,
    sha256(string_agg(chunk_text, chr(10) || chr(10) order by i)) as text_hash
  from fold join o using (doc_id, community_id, i) group by doc_id, community_id, g""", recursive=True)


def _even(t):
    c = t.chunks.select(F.col("doc_id").alias("group_id"), F.col("chunk_order").alias("pos"))
    sizes = c.groupBy("group_id").agg(F.count("*").alias("n"))
    return ck.split_even(c.join(sizes, "group_id")).groupBy("group_id", "part").agg(
        F.count("*").alias("n_members"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


EVEN_SQL = check_sql("chunks", """with s as (select doc_id as group_id, chunk_order as pos, count(*) over (partition by doc_id) as n from chunks),
  p as (select *, case when n <= 3 then 0 else least(pos // (n // least(4, (n + 2) // 3)), least(4, (n + 2) // 3) - 1) end as part from s)
  select group_id, part::bigint as part, count(*) as n_members, min(pos) as first_pos, max(pos) as last_pos from p group by group_id, part""")


def _files(t):
    return t.markdown_docs.select("path", "content")


def _sections(compat):
    def run(t):
        s = ck.markdown_sections(_files(t), compat)
        return s.select("path", "section_order", "heading", "level", "content_type", F.sha2("content", 256).alias("text_hash"))
    return run


def q_sections(compat: bool) -> str:
    """Sections in DuckDB: lines are numbered, headings open a section, bodies are the lines up to the next."""
    body_of_loose = "h = n_heads" if compat else "h = 0"
    order_of_loose = "n_heads" if compat else "case when n_heads = 0 then -1 else -1 end"
    return rf"""
  ln as (select path, unnest(ls) as line, generate_subscripts(ls, 1) as i from (select path, string_split(content, chr(10)) as ls from markdown_docs) a),
  marked as (select *, regexp_matches(line, '^#{{1,2}}\s+.+$') as is_head from ln),
  open as (select *, sum(is_head::int) over (partition by path order by i) as h, sum(is_head::int) over (partition by path) as n_heads from marked),
  bodies as (select path, h, n_heads, coalesce(string_agg(line, chr(10) order by i) filter (where not is_head), '') as body,
               max(line) filter (where is_head) as head from open group by path, h, n_heads),
  secs as (
    select path, (h - 1)::bigint as section_order, {q_strip(r"regexp_replace(head, '^#{1,2}\s+', '')")} as heading,
      length(regexp_extract(head, '^(#{{1,2}})\s', 1))::bigint as level, {q_clean_markdown('body')} as content, {q_clean_markdown('body')} as basis, false as loose
    from bodies where h > 0
    union all
    select path, {order_of_loose}::bigint, 'Introduction', 1::bigint, {q_clean_markdown(q_strip('body'))}, {q_strip('body')}, true from bodies where {body_of_loose}),
  sections as (select path, section_order, heading, level, content, {q_content_type('basis')} as content_type from secs
               where case when heading = 'Introduction' then length(basis) > 0 else length(content) > 0 end)"""


SECTION_OUT = " select path, section_order, heading, level, content_type, sha256(content) as text_hash from sections"


def _cards(t):
    return ck.folder_cards(_files(t)).withColumn("answer_hash", F.sha2("answer", 256)).withColumn(
        "original_hash", F.sha2("original_content", 256)).drop("answer", "original_content")


CARD_CTES = q_sections(False) + rf""",
  defs as (select path, section_order, generate_subscripts(q, 1) - 1 as card_order, 'What is ' || unnest(q) || '?' as question, {q_strip('unnest(a)')} as answer, heading, content, content_type
           from (select *, regexp_extract_all(content, '\*\*([^*]+)\*\*:\s*([^\n]+)', 1) as q, regexp_extract_all(content, '\*\*([^*]+)\*\*:\s*([^\n]+)', 2) as a from sections where content_type = 'definition') x),
  lists as (select path, section_order, 0 as card_order, 'List the main points about ' || heading as question,
              array_to_string(list_transform(items, lambda x: '• ' || {q_strip('x')}), chr(10)) as answer, heading, content, content_type
            from (select *, regexp_extract_all(content, '(?m)^\s*[-*+]\s*(.+)$', 1) as items from sections where content_type = 'list') x where len(items) > 1),
  codes as (select path, section_order, generate_subscripts(cs, 1) - 1 as card_order, 'How do you implement ' || heading || '? (Code example)' as question,
              '```' || chr(10) || {q_strip('unnest(cs)')} || chr(10) || '```' as answer, heading, content, content_type
            from (select *, regexp_extract_all(content, '(?s)```[^\n]*\n(.*?)```', 1) as cs from sections where content_type = 'code') x),
  concepts as (select path, section_order, 0 as card_order, 'Explain ' || heading as question,
              {q_strip('p')}[1:500] || case when length(p) > 500 then '...' else '' end as answer, heading, content, content_type
            from (select *, regexp_replace(regexp_replace(content, '\*\*([^*]+)\*\*', '\1', 'g'), '`([^`]+)`', '\1', 'g') as p from sections where content_type = 'concept') x
            where length({q_strip('p')}) > 50),
  cards as (select path as source_file, section_order, card_order::bigint as card_order, question, answer, heading as context,
              case when length(content) > 200 then content[1:200] || '...' else content end as original_content, content_type
            from (select * from defs union all select * from lists union all select * from codes union all select * from concepts) u)"""


def _card_types(t):
    return ck.cards_by_type(ck.folder_cards(_files(t)))


def _basic(t):
    cards = ck.basic_cards(ck.folder_cards(_files(t)))
    return cards.select("source_file", "section_order", "card_order", "question", "difficulty", F.array_join("tags", ",").alias("tags"))


QUERIES = [
    Query("chunk_fixed_300", _fixed, FIXED_SQL),
    Query("chunk_sentence_350", _sentences, SENTENCE_SQL),
    Query("paragraph_pack", _paragraphs, PARAGRAPH_SQL),
    Query("large_communities_split", _large, LARGE_SQL),
    Query("groups_split_even", _even, EVEN_SQL),
    Query("markdown_sections", _sections(True), check_sql("markdown_docs", "with " + q_sections(True) + SECTION_OUT)),
    Query("markdown_sections_once", _sections(False), check_sql("markdown_docs", "with " + q_sections(False) + SECTION_OUT)),
    Query("folder_cards", _cards, check_sql("markdown_docs", "with " + CARD_CTES + """
      select source_file, section_order, card_order, question, context, content_type, sha256(answer) as answer_hash, sha256(original_content) as original_hash from cards""")),
    Query("cards_by_type", _card_types, check_sql("markdown_docs", "with " + CARD_CTES + """
      select content_type, count(*) as n_cards, count(distinct source_file) as n_files from cards group by content_type""")),
    Query("basic_cards", _basic, check_sql("markdown_docs", "with " + CARD_CTES + """
      select source_file, section_order, card_order, question, 'medium' as difficulty, replace(lower(context), ' ', '_') as tags from cards""")),
]
