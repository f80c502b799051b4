"""Study tables derived from the given parquet tables.

Every derivation is one SQL text per table, written for Spark or DuckDB through a small dialect, so
that the registered queries and their check SQL start from the same rows.  All derivations read
their whole base table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .session import cut, spread

BASE_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The label vocabulary, in its declared order.
CONCEPT_LABELS = (
    "Definition", "Intuition", "Example", "Procedure", "Algorithm", "Derivation", "Proof",
    "Statement", "Theorem", "Lemma", "Assumption", "Property", "Discussion", "Contrast", "Warning",
    "NewTopic", "Recap", "WrapUp", "DataSpec", "Code", "Pseudocode", "FigureCaption", "Exercise",
    "ProblemStatement", "Introduction", "Conclusion", "Summary", "Background", "Methodology",
    "Results", "Analysis", "Interpretation", "Application", "Limitation", "FutureWork", "Related",
    "Comparison", "Classification", "Explanation", "Elaboration", "Other",
)

EDGE_TAU = 0.30


class Dialect:
    """The few spots where the SQL of the two engines differs."""

    def __init__(self, name: str):
        self.spark = name == "spark"

    def table(self, name: str) -> str:
        return f"lw_{name}" if self.spark else name

    def div(self, a: str, b: str) -> str:
        return f"({a} div {b})" if self.spark else f"({a} // {b})"

    def k(self) -> str:
        value = "get_json_object(props, '$.k')" if self.spark else "json_extract_string(props, '$.k')"
        return f"cast({value} as bigint)"

    def hours_after(self, base: str, hours: str) -> str:
        if self.spark:
            return f"timestampadd(HOUR, cast({hours} as int), timestamp_ntz'{base}')"
        return f"(timestamp '{base}' + to_hours(cast({hours} as int)))"

    def words(self, c: str) -> str:
        if self.spark:
            return rf"filter(split(regexp_replace({c}, '(?U)^\\s+|\\s+$', ''), '(?U)\\s+'), w -> w <> '')"
        return rf"list_filter(string_split_regex(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: w <> '')"

    def lines(self, c: str) -> str:
        return f"split({c}, '\\n')" if self.spark else f"string_split({c}, chr(10))"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {sep})" if self.spark else f"array_to_string({a}, {sep})"

    def explode_range(self, n: str, alias: str) -> str:
        """A lateral 0..n-1; no row for n = 0, where ``sequence(0, -1)`` would count down."""
        if self.spark:
            return f"lateral view explode(slice(sequence(0, cast({n} as int)), 1, cast({n} as int))) x as {alias}"
        return f", unnest(range(0, cast({n} as int))) as x({alias})"

    def at(self, array: str, i: str) -> str:
        return f"get({array}, cast({i} as int))" if self.spark else f"{array}[cast({i} as int) + 1]"

    def part_of(self, array: str, start: str, n: int | str) -> str:
        """Elements start .. start+n-1, zero-based."""
        if self.spark:
            return f"slice({array}, cast({start} as int) + 1, {n})"
        return f"array_slice({array}, cast({start} as int) + 1, cast({start} as int) + {n})"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def dot(self, a: str, b: str) -> str:
        if self.spark:
            return (f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, x) -> s + x)")
        return f"list_inner_product(cast({a} as double[]), cast({b} as double[]))"

    @property
    def nl(self) -> str:
        return "'\\n'" if self.spark else "chr(10)"


def _blocks(d: Dialect) -> str:
    return f"""
      select p_partkey as block_id, {d.div('p_partkey', '20')} as doc_id, p_partkey % 20 as block_order,
        p_name as title, cast(60 * (p_size % 10 + 1) as bigint) as duration_s,
        case p_size % 3 when 0 then 'beginner' when 1 then 'intermediate' else 'advanced' end as difficulty,
        {d.hours_after('2024-01-01 00:00:00', 'p_partkey')} as created_at
      from {d.table('part')}"""


def _reviews(d: Dialect) -> str:
    return f"""
      select event_id, user_id, {d.div('k * k', '100')} as block_id, 1 + cents % 5 as rating, cents % 600 as time_s, ts,
        event_id % 4 as qa_total, greatest(event_id % 4 - event_id % 2, 0) as qa_correct
      from (select event_id, user_id, ts, {d.k()} as k, cast(round(value * 100) as bigint) as cents
            from {d.table('events')}) e"""


def _attempt_events(d: Dialect) -> str:
    return f"""
      select event_id, user_id * 1000 + {d.div('k * k', '100')} as attempt_id, user_id, {d.div('k * k', '100')} as block_id,
        case event_type when 'signup' then 'start' when 'view' then 'complete_segment' when 'click' then 'complete_segment'
          when 'error' then 'pause' else 'complete' end as action,
        event_id % 5 as segment_index, cast(round(value * 100) as bigint) % 600 as time_s, ts,
        1 + cast(round(value * 100) as bigint) % 5 as rating
      from (select *, {d.k()} as k from {d.table('events')}) e"""


def _attempts(d: Dialect) -> str:
    """One finished or running attempt per event, with nulls where the study time is unknown."""
    return f"""
      select event_id as attempt_id, user_id, {d.div('k * k', '100')} as block_id, ts as completed_at,
        case when event_id % 9 = 0 then cast(null as double) else cast(cents % 600 as double) end as study_s,
        1 + cents % 5 as proficiency,
        case event_type when 'error' then 'paused' when 'signup' then 'active' else 'completed' end as status,
        case event_id % 4 when 0 then 'easy' when 1 then 'medium' else 'hard' end as felt,
        case when event_id % 3 = 0 then 'terms' when event_id % 3 = 1 then 'terms,proof' else '' end as confusion
      from (select *, {d.k()} as k, cast(round(value * 100) as bigint) as cents from {d.table('events')}) e"""


def _edges(d: Dialect) -> str:
    e = d.table("embeddings")
    norm = f"sqrt({d.dot('embedding', 'embedding')})"
    vec = f"(select vec_id, embedding, {norm} as n from {e})"
    return f"""
      select a.vec_id as src, b.vec_id as dst,
        case (a.vec_id + b.vec_id) % 3 when 0 then 'prerequisite' when 1 then 'builds_on' else 'related' end as rel_type,
        round({d.dot('a.embedding', 'b.embedding')} / (a.n * b.n), 6) as similarity
      from {vec} a join {vec} b on a.vec_id < b.vec_id
      where round({d.dot('a.embedding', 'b.embedding')} / (a.n * b.n), 6) >= {EDGE_TAU}"""


def _edges_cyclic(d: Dialect) -> str:
    return """
      select src, dst, rel_type, similarity from edges
      union all
      select dst as src, src as dst, rel_type, similarity from edges where rel_type = 'prerequisite' and (src + 2 * dst) % 5 = 0"""


def _chunks50(d: Dialect) -> str:
    n = f"(len(w) + 49) // 50" if not d.spark else "((size(w) + 49) div 50)"
    size = "size(w)" if d.spark else "len(w)"
    text = d.join(d.part_of("w", "c * 50", 50), "' '")
    return f"""
      select doc_id, cast(c as bigint) as chunk_order, {text} as chunk_text, cast(c * 50 as bigint) as word_start,
        cast(least(c * 50 + 50, {size}) as bigint) as word_end, cast(least(50, {size} - c * 50) as bigint) as word_count
      from (select doc_id, {d.words('text')} as w from {d.table('documents')}) t {d.explode_range(n, 'c')}
      {'' if d.spark else ''}"""


def _chunk_labels(d: Dialect) -> str:
    labels = d.array(*[f"'{x}'" for x in CONCEPT_LABELS])
    topic = f"concat('t', cast((doc_id + {d.div('chunk_order', '4')}) % 7 as varchar(20)))"
    return f"""
      select doc_id, chunk_order, {d.at(labels, '(doc_id * 31 + chunk_order * 7) % 41')} as primary_label,
        {d.array(topic, "concat('u', cast(chunk_order % 2 as varchar(20)))")} as keywords,
        cast((doc_id + chunk_order) % 10 as double) / 10 as confidence, word_count
      from chunks"""


def _page_text(d: Dialect) -> str:
    size = "size(l)" if d.spark else "len(l)"
    pages = f"(({size} + 19) div 20)" if d.spark else f"({size} + 19) // 20"
    body = d.join(d.part_of("l", "p * 20", 20), d.nl)
    base = f"""(select doc_id, {d.lines('text')} as l from {d.table('documents')}) t {d.explode_range(pages, 'p')}"""
    return f"""
      select doc_id, cast(p as bigint) as page_no, 'a' as extractor, case when doc_id % 7 = 0 then '' else {body} end as page_text from {base}
      union all
      select doc_id, cast(p as bigint) as page_no, 'b' as extractor, {body} as page_text from {base}"""


def _repeat_docs(d: Dialect) -> str:
    """A page header and a number before every second line, and a long repeated line that must stay."""
    long_line = "'" + "this long line repeats but is content and has to survive the removal of running headers and footers " + "'"
    if d.spark:
        marked = f"transform(l, (x, i) -> case when i % 2 = 1 then concat('Page 1', {d.nl}, '7', {d.nl}, {long_line}, {d.nl}, x) else x end)"
        size = "size(l)"
    else:
        marked = f"list_transform(l, lambda x, i: case when i % 2 = 0 then concat('Page 1', {d.nl}, '7', {d.nl}, {long_line}, {d.nl}, x) else x end)"
        size = "len(l)"
    return f"""
      select doc_id, case when {size} >= 10 then {d.join(marked, d.nl)} else {d.join('l', d.nl)} end as text
      from (select doc_id, {d.lines('text')} as l from {d.table('documents')}) t"""


def _hyphen_docs(d: Dialect) -> str:
    """Every fifth space becomes a hyphenated line break, every eleventh two spaces before a stop."""
    if d.spark:
        marked = f"transform(w, (x, i) -> case when i % 5 = 4 then concat(x, '-', {d.nl}) when i % 11 = 7 then concat(x, '  . ', {d.nl}, {d.nl}, {d.nl}, {d.nl}) else concat(x, ' ') end)"
    else:
        marked = f"list_transform(w, lambda x, i: case when (i - 1) % 5 = 4 then concat(x, '-', {d.nl}) when (i - 1) % 11 = 7 then concat(x, '  . ', {d.nl}, {d.nl}, {d.nl}, {d.nl}) else concat(x, ' ') end)"
    split = "split(text, ' ')" if d.spark else "string_split(text, ' ')"
    empty = "''"
    return f"""
      select doc_id, {d.join(marked, empty)} as text from (select doc_id, {split} as w from {d.table('documents')}) t"""


def _paragraph_docs(d: Dialect) -> str:
    return f"select doc_id, replace(text, {d.nl}, concat({d.nl}, {d.nl})) as text from {d.table('documents')}"


def _markdown_docs(d: Dialect) -> str:
    n = d.nl
    fence = "'```python'" 
    return f"""
      select doc_id, concat('src/', cast(doc_id as varchar(20)), '.md') as path,
        case doc_id % 4
          when 0 then concat('intro', {n}, '# ', source, {n}, text, {n}, '## Notes', {n}, '- a', {n}, '- b', {n})
          when 1 then concat('# ', source, {n}, '**Term**: what it means', {n}, '<!-- hidden', {n}, 'note -->', {n}, '**Other**: more', {n}, '## Rest', {n}, text)
          when 2 then concat('## Code ', source, {n}, {fence}, {n}, 'x = 1', {n}, '```', {n}, 'and', {n}, '```', {n}, 'y', {n}, '```', {n}, '# Tail', {n}, text)
          else text end as content
      from {d.table('documents')}"""


def _block_bodies(d: Dialect) -> str:
    t = "' || title || '"
    new = (
        '{"title":"' + t + '","learning_objectives":["Know ' + t + '","Use it"],'
        '"segments":[{"type":"explain","title":"About ' + t + '","content":"<p>The ' + t + ' is a Great Thing of Value, and this sentence is long enough to be kept.</p>","explanation":"why","duration_seconds":\' || cast(60 + block_id % 7 * 10 as varchar(20)) || \'},'
        '{"type":"example","title":"Short","content":"tiny"},'
        '{"type":"knowledge_check","title":"Check","question":"What is it?","answer":"A ' + t + '","content":"Q and A about the ' + t + ' with enough words to pass the filter","duration_seconds":90}],'
        '"qa_items":[{"question":"Why ' + t + '?","answer":"Because","difficulty":"easy"},{"question":"How?","answer":"So"}],'
        '"total_duration":420,"difficulty_level":"intermediate"}'
    )
    old = (
        '{"template":"compact7","revision":{"nano_recap":"before"},"core":{"goal":"Students will understand the ' + t + '. Then more",'
        '"segments":[{"title":"Core ' + t + '","time_sec":180,"teach":[]},{"title":"Applications","time_sec":140}],"qa":[{"question":"core?","answer":"yes"}]},'
        '"qa":[{"question":"q1","answer":"a1"}],"recap":{"bullets":["b"]},"rescue":{"nano_summary":"s"}}'
    )
    objectives = d.array("concat('Know ', title)", "'Use it'")
    return f"""
      select block_id, doc_id, block_order,
        case when block_id % 11 = 0 then concat('[MIGRATED→ab12cd34] ', cast(block_order as varchar(20)), '. ', title) else title end as title,
        case block_id % 5 when 0 then '{new}' when 1 then '{old}' when 2 then cast(null as varchar(10)) when 3 then '{{}}' else '{{"segments": [oops' end as body,
        case when block_id % 5 = 2 then concat('Say: ', title) else '' end as script,
        {objectives} as objectives, duration_s, difficulty, created_at
      from blocks"""


def _states(d: Dialect) -> str:
    """Review states as stored rows: one per learner and block, in every status and both schedules."""
    return f"""
      select user_id, block_id,
        case (user_id + block_id) % 6 when 0 then 'new' when 1 then 'learning' when 2 then 'review' when 3 then 'lapsed' when 4 then 'completed' else 'suspended' end as status,
        case when (user_id + block_id) % 4 = 0 then cast(null as bigint) else 1 + (user_id * 7 + block_id) % 12 end as next_due_after,
        (user_id + 3 * block_id) % 9 as studied_count,
        case when (user_id + block_id) % 5 = 0 then cast(null as timestamp{'_ntz' if d.spark else ''}) else {d.hours_after('2024-01-20 00:00:00', '(user_id * 13 + block_id * 29) % 480')} end as next_due_at,
        cast((user_id * 17 + block_id * 5) % 41 as double) / 10 + 1 as avg_rating,
        (user_id + block_id) % 4 as lapses, n as review_count, t as time_s, last_reviewed_at
      from (select user_id, block_id, count(*) as n, cast(sum(time_s) as bigint) as t, max(ts) as last_reviewed_at from reviews group by user_id, block_id) r"""


def _completed(d: Dialect) -> str:
    """Blocks a learner completed in a session: those rated 4 or better."""
    return "select distinct user_id, block_id from reviews where rating >= 4"


def _candidates(d: Dialect) -> str:
    """The catalogue of a learner: all blocks of the documents the learner has touched, in order."""
    return """
      select m.user_id, b.block_id, b.doc_id, b.block_order,
        row_number() over (partition by m.user_id order by b.doc_id, b.block_order) as master_pos
      from (select distinct r.user_id, b.doc_id from reviews r join blocks b on r.block_id = b.block_id) m
      join blocks b on b.doc_id = m.doc_id"""


def _label_responses(d: Dialect) -> str:
    full = '{"primary_label":"Proof","secondary_labels":["Code"],"confidence":0.8,"reasoning":"r","keywords":["k1","k2"],"concept_topic":"t"}'
    return f"""
      select event_id, case event_id % 6 when 0 then '{full}' when 1 then concat('```json', {d.nl}, '{full}', {d.nl}, '```')
        when 2 then '{{"primary_label":"Nonsense","confidence":0.25,"reasoning":"r","keywords":[],"concept_topic":"t"}}'
        when 3 then 'sorry, no JSON {{' when 4 then '{{"primary_label":"Proof","confidence":0.9}}' else concat('```', {d.nl}, '{full}', {d.nl}, '```') end as response
      from {d.table('events')}"""


def _time_responses(d: Dialect) -> str:
    t = "cast(event_id % 30 as varchar(9))"
    body = f"""concat('{{"reading_time":', {t}, ',"complexity_score":1.7,"cognitive_load":"high"}}')"""
    return f"""
      select event_id, case event_id % 5 when 0 then {body} when 1 then concat('```', {d.nl}, {body}, {d.nl}, '```')
        when 2 then '{{"complexity_score":-0.2,"cognitive_load":"extreme"}}' when 3 then 'about five minutes'
        else concat('```json', {d.nl}, '{{"reading_time":4,"complexity_score":0.25,"cognitive_load":"low"}}', {d.nl}, '```') end as response
      from {d.table('events')}"""


def _relation_batches(d: Dialect) -> str:
    return f"select {d.div('event_id', '5')} as batch_id, event_id % 5 as idx, block_id * 1000 + user_id as block_id from reviews"


def _relation_responses(d: Dialect) -> str:
    body = (
        '[{"from_block_index":0,"to_block_index":3,"relationship_type":"prerequisite","confidence":0.9},'
        '{"from_block_index":1,"to_block_index":7,"relationship_type":"builds_on","confidence":0.95},'
        '{"from_block_index":2,"to_block_index":4,"relationship_type":"related","confidence":0.5},'
        '{"from_block_index":4,"to_block_index":1,"confidence":0.75}]'
    )
    return f"""
      select batch_id, case batch_id % 3 when 0 then '{body}' when 1 then concat('```json', {d.nl}, '{body}', {d.nl}, '```') else 'none' end as response
      from (select distinct batch_id from relation_batches) b"""


def _card_batches(d: Dialect) -> str:
    return f"""
      select {d.div('p_partkey', '4')} as batch_id, p_partkey % 4 as pos, concat('What is ', p_name, '?') as question, p_type as answer, concat(p_brand, ' Notes') as context
      from {d.table('part')}"""


def _card_responses(d: Dialect) -> str:
    item = '{"question":"Why?","answer":"Because","difficulty":"hard","tags":["x","y"]}'
    return f"""
      select batch_id, case batch_id % 4 when 0 then '[{item},{item},{item},{item}]' when 1 then '[{{"question":"Only this"}},{{"answer":"Only that","tags":["z"]}}]'
        when 2 then 'no cards' else concat('```', {d.nl}, '[{item},{{}}]', {d.nl}, '```') end as response
      from (select distinct batch_id from card_batches) b"""


def _completions_map(d: Dialect) -> str:
    entry = """concat('"', cast(block_id as varchar(20)), '":{"proficiency_rating":', cast(r as varchar(9)), ',"time_spent_seconds":', cast(t as varchar(20)), ',"notes":"n"}')"""
    joined = f"array_join(array_sort(collect_list({entry})), ',')" if d.spark else f"string_agg({entry}, ',' order by block_id)"
    return f"""
      select user_id as session_id, concat('{{', {joined}, '}}') as completions
      from (select user_id, block_id, max(rating) as r, sum(time_s) as t from reviews group by user_id, block_id) x group by user_id"""


DERIVED = {
    "label_responses": ((), _label_responses),
    "time_responses": ((), _time_responses),
    "relation_batches": (("reviews",), _relation_batches),
    "relation_responses": (("relation_batches",), _relation_responses),
    "card_batches": ((), _card_batches),
    "card_responses": (("card_batches",), _card_responses),
    "completions_map": (("reviews",), _completions_map),
    "blocks": ((), _blocks),
    "reviews": ((), _reviews),
    "attempt_events": ((), _attempt_events),
    "attempts": ((), _attempts),
    "edges": ((), _edges),
    "edges_cyclic": (("edges",), _edges_cyclic),
    "chunks": ((), _chunks50),
    "chunk_labels": (("chunks",), _chunk_labels),
    "page_text": ((), _page_text),
    "repeat_docs": ((), _repeat_docs),
    "hyphen_docs": ((), _hyphen_docs),
    "paragraph_docs": ((), _paragraph_docs),
    "markdown_docs": ((), _markdown_docs),
    "block_bodies": (("blocks",), _block_bodies),
    "states": (("reviews",), _states),
    "completed": (("reviews",), _completed),
    "candidates": (("reviews", "blocks"), _candidates),
}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for name in names:
        for needed in _closure(DERIVED[name][0]):
            if needed not in out:
                out.append(needed)
        if name not in out:
            out.append(name)
    return out


def check_sql(names: tuple[str, ...] | str, body: str, recursive: bool = False) -> str:
    """DuckDB SQL: the named derived tables as CTEs in front of ``body`` (``cte AS (...), ... SELECT``)."""
    if isinstance(names, str):
        names = tuple(names.split())
    d = Dialect("duckdb")
    ctes = [f"{n} as materialized ({DERIVED[n][1](d)})" for n in _closure(names)]
    body = body.strip()
    head = "with recursive " if recursive else "with "
    if re.match(r"with\s", body, re.I):
        return head + ", ".join(ctes + [body[5:]])
    return head + ", ".join(ctes) + " " + body if ctes else body


class Tables:
    """The base and derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(table) if name == "documents" else table
        if name == "edges":
            return cut(self.edges_once)
        if name == "edges_once":
            # for a query that reads the edges once: they are not written first
            from .operators.similarity import dense_cosine_pairs

            return edges_of(dense_cosine_pairs(self.embeddings, EDGE_TAU))
        if name not in DERIVED:
            raise AttributeError(name)
        needs, build = DERIVED[name]
        sql = build(Dialect("spark"))
        frames = {f"lw_{base}": getattr(self, base) for base in BASE_TABLES if f"lw_{base}" in sql}
        return _resolved(self.spark, sql, frames | {needed: getattr(self, needed) for needed in needs})


def _resolved(spark: SparkSession, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """``sql`` over ``frames``.  Their names stand only while it is analysed; a caller's views come back."""
    theirs = {}
    for name, frame in frames.items():
        if spark.catalog.tableExists(name) and spark.catalog.getTable(name).isTemporary:
            theirs[name] = spark.table(name)
        frame.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in frames:
            spark.catalog.dropTempView(name)
            if name in theirs:
                theirs[name].createOrReplaceTempView(name)


def edges_of(pairs: DataFrame) -> DataFrame:
    """Typed edges over similarity pairs (i < j); the type rotates with the pair so that all occur."""
    return pairs.selectExpr(
        "i as src", "j as dst",
        "case (i + j) % 3 when 0 then 'prerequisite' when 1 then 'builds_on' else 'related' end as rel_type",
        "sim as similarity",
    )
