"""Block bodies and response tables held as JSON text (JSN1-JSN10).

Bodies come in several layouts; one superset schema parses all of them in a single pass, and the
layouts are told apart by their top-level keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..derived import CONCEPT_LABELS
from ..functions.common import let, strip
from ..functions.text import MIGRATED_PREFIX, preview

SEGMENT = (
    "struct<type:string,title:string,content:string,explanation:string,question:string,answer:string,"
    "difficulty:string,duration_seconds:int,time_sec:int>"
)
QA = "struct<question:string,answer:string,difficulty:string>"
BODY_SCHEMA = (
    f"template string, title string, learning_objectives array<string>, segments array<{SEGMENT}>, "
    f"qa_items array<{QA}>, qa array<{QA}>, core struct<goal:string,segments:array<{SEGMENT}>,qa:array<{QA}>>, "
    "revision string, recap string, rescue string, total_duration int, difficulty_level string"
)
# Keys that mark the older layout, the reading loads and the relation types.
OLD_KEYS = ("revision", "core", "qa", "recap", "rescue")
LOADS = ("low", "medium", "high", "very_high")
REL_TYPES = ("prerequisite", "builds_on", "related", "compares_with", "applies_to", "specializes")


def keys_of(body: Column) -> Column:
    """Top-level keys; null for missing or malformed JSON."""
    return F.json_object_keys(body)


def body_fields(blocks: DataFrame, body: str = "body") -> DataFrame:
    """JSN1: one row per block with segments, qa_items, core_goal, revision, recap, rescue and totals."""
    parsed = blocks.withColumn("_b", F.from_json(F.col(body), BODY_SCHEMA))
    b = F.col("_b")
    empty_segments = F.array().cast(f"array<{SEGMENT}>")
    empty_qa = F.array().cast(f"array<{QA}>")
    return parsed.select(
        *[c for c in blocks.columns if c != body],
        F.coalesce(b["segments"], b["core"]["segments"], empty_segments).alias("segments"),
        F.coalesce(b["qa_items"], b["qa"], b["core"]["qa"], empty_qa).alias("qa_items"),
        F.coalesce(b["core"]["goal"], F.lit("")).alias("core_goal"),
        F.coalesce(b["revision"], F.lit("{}")).alias("revision"),
        F.coalesce(b["recap"], F.lit("{}")).alias("recap"),
        F.coalesce(b["rescue"], F.lit("{}")).alias("rescue"),
        b["total_duration"].cast("long").alias("total_duration"),
        (F.coalesce(F.size(keys_of(F.col(body))), F.lit(0)) > 0).alias("has_body"),
    )


def body_format(body: Column, title: Column, script: Column) -> Column:
    """JSN2: migrated, new, old, legacy or empty."""
    keys = keys_of(body)
    old = (F.get_json_object(body, "$.template") == "compact7") & F.arrays_overlap(
        keys, F.array(*[F.lit(k) for k in OLD_KEYS])
    )
    return (
        F.when(F.startswith(title, F.lit(MIGRATED_PREFIX)), "migrated")
        .when(F.coalesce(F.array_contains(keys, "segments"), F.lit(False)), "new")
        .when(F.coalesce(old, F.lit(False)), "old")
        .when(F.coalesce(F.length(script), F.lit(0)) > 0, "legacy")
        .otherwise("empty")
    )


def strip_fences(c: Column, bare: bool = False) -> Column:
    """Drop the code fence some responses wrap around their JSON; ``bare`` also accepts one without a language."""
    out = F.regexp_replace(strip(c), r"^```(json)?" if bare else r"^```json", "")
    return strip(F.regexp_replace(out, r"```\z", ""))


def parse_label_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """JSN3: label rows from response text.  Malformed or incomplete responses give the default row."""
    text = strip_fences(F.col(response))
    schema = (
        "primary_label string, secondary_labels array<string>, confidence double, reasoning string, "
        "keywords array<string>, concept_topic string"
    )
    required = F.array(*[F.lit(k) for k in ("primary_label", "confidence", "reasoning", "keywords", "concept_topic")])
    none = F.array().cast("array<string>")
    keyed = df.withColumn("_t", text).withColumn("_d", F.from_json("_t", schema)).withColumn(
        "_ok", F.coalesce(F.size(F.array_except(required, keys_of(F.col("_t")))) == 0, F.lit(False))
    )
    d, ok = F.col("_d"), F.col("_ok")
    label = F.when(d["primary_label"].isin(list(CONCEPT_LABELS)), d["primary_label"]).otherwise("Other")
    return keyed.select(
        *[c for c in df.columns if c != response],
        F.when(ok, label).otherwise("Other").alias("primary_label"),
        F.when(ok, F.coalesce(d["secondary_labels"], none)).otherwise(none).alias("secondary_labels"),
        F.when(ok, d["confidence"]).otherwise(F.lit(0.5)).alias("confidence"),
        F.when(ok, d["reasoning"]).otherwise("Failed to parse LLM response").alias("reasoning"),
        F.when(ok, F.coalesce(d["keywords"], none)).otherwise(none).alias("keywords"),
        F.when(ok, d["concept_topic"]).otherwise("Unknown").alias("concept_topic"),
        ok.alias("parsed"),
    )


def parse_time_responses(df: DataFrame, response: str = "response") -> DataFrame:
    """JSN4: minutes, complexity in [0, 1] and load, with defaults 5.0, 0.5 and medium."""
    text = strip_fences(F.col(response), bare=True)
    d = F.from_json(text, "reading_time double, complexity_score double, cognitive_load string")
    return (
        df.withColumn("_d", d)
        .select(
            *[c for c in df.columns if c != response],
            F.coalesce("_d.reading_time", F.lit(5.0)).alias("reading_min"),
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_d.complexity_score", F.lit(0.5)))).alias("complexity"),
            F.when(F.col("_d.cognitive_load").isin(list(LOADS)), F.col("_d.cognitive_load")).otherwise("medium").alias("load"),
        )
    )


def assemble_body(segments: Column, qa_items: Column, min_chars: int = 50, qa_seconds: int = 90) -> Column:
    """JSN5: struct of segments and total_duration; question pairs become knowledge checks.

    ``min_chars=0`` keeps every segment, as the template variant does.
    """
    default = 90
    kept = segments if min_chars == 0 else F.filter(
        segments, lambda s: F.length(strip(F.coalesce(s["content"], F.lit("")))) > min_chars
    )
    plain = F.transform(kept, lambda s: F.struct(
        s["type"].alias("type"), s["title"].alias("title"), s["content"].alias("content"),
        s["question"].alias("question"), s["answer"].alias("answer"),
        F.coalesce(s["duration_seconds"], F.lit(default)).alias("duration_seconds"),
    ))

    def check(q: Column, i: Column) -> Column:
        question, answer = F.coalesce(q["question"], F.lit("")), F.coalesce(q["answer"], F.lit(""))
        return F.struct(
            F.lit("knowledge_check").alias("type"),
            F.concat(F.lit("Knowledge Check "), (i + 1).cast("string")).alias("title"),
            F.concat(F.lit("<strong>Q: "), question, F.lit("</strong><br><br><em>A: "), answer, F.lit("</em>")).alias("content"),
            question.alias("question"), answer.alias("answer"),
            F.lit(qa_seconds).alias("duration_seconds"),
        )

    full = F.concat(plain, F.transform(qa_items, check))
    return let(full, lambda s: F.struct(
        s.alias("segments"),
        F.aggregate(s, F.lit(0).cast("long"), lambda acc, x: acc + x["duration_seconds"]).alias("total_duration"),
    ))


def default_body(units: DataFrame) -> DataFrame:
    """JSN6: the fixed body used when no response could be parsed.

    Input: doc_id, concept_order, title and prior_title (may be null).
    """
    title = F.col("title")
    # The wording of the default body.
    core = F.struct(
        F.concat(F.lit("Understand the concepts in "), title).alias("goal"),
        F.array(
            F.struct(F.lit("Core Concepts").alias("title"), F.lit(180).alias("time_sec"),
                     F.concat(F.lit("Let's explore "), title).alias("content")),
            F.struct(F.lit("Applications").alias("title"), F.lit(140).alias("time_sec"),
                     F.lit("How to apply these concepts").alias("content")),
        ).alias("segments"),
    )
    qa = F.array(
        F.struct(F.lit("What are the main concepts in this material?").alias("question"),
                 F.lit("The key ideas and their relationships").alias("answer")),
        F.struct(F.lit("How would you apply these concepts?").alias("question"),
                 F.lit("Through practical examples and exercises").alias("answer")),
    )
    body = F.to_json(F.struct(
        F.lit("compact7").alias("template"),
        F.struct(F.concat(F.lit("Previous concept: "), F.coalesce("prior_title", F.lit("N/A"))).alias("nano_recap")).alias("revision"),
        core.alias("core"),
        qa.alias("qa"),
        F.struct(F.array(F.concat(F.lit("Learned about "), title), F.lit("Understood key applications")).alias("bullets")).alias("recap"),
        F.struct(F.concat(F.lit("Key concept: "), title).alias("nano_summary")).alias("rescue"),
    ))
    return units.withColumn("body", body)


def explode_completions(sessions: DataFrame, column: str = "completions") -> DataFrame:
    """JSN7: one row per (session, block) of the completion map, with rating, time and notes."""
    schema = "map<string,struct<proficiency_rating:int,time_spent_seconds:long,notes:string>>"
    rest = [c for c in sessions.columns if c != column]
    return sessions.select(*rest, F.explode(F.from_json(F.col(column), schema)).alias("_k", "_v")).select(
        *rest,
        F.expr("try_cast(_k as bigint)").alias("block_id"),
        F.col("_v.proficiency_rating").alias("rating"),
        F.coalesce("_v.time_spent_seconds", F.lit(0)).alias("time_s"),
        F.coalesce("_v.notes", F.lit("")).alias("notes"),
    )


def parse_relations(responses: DataFrame, batch: DataFrame, threshold: float = 0.75) -> DataFrame:
    """JSN8: relations from response arrays.  ``responses(batch_id, response)`` holds arrays of
    {from_block_index, to_block_index, relationship_type, confidence}; ``batch(batch_id, idx, block_id)``
    names the members.  Out-of-range indexes find no member and drop out of the inner joins."""
    item = "array<struct<from_block_index:int,to_block_index:int,relationship_type:string,confidence:double>>"
    rows = responses.select("batch_id", F.explode(F.from_json(strip_fences(F.col("response")), item)).alias("r")).select(
        "batch_id", F.col("r.from_block_index").alias("from_idx"), F.col("r.to_block_index").alias("to_idx"),
        F.coalesce("r.relationship_type", F.lit("related")).alias("rel_type"), F.col("r.confidence").alias("confidence"),
    ).where(F.coalesce("confidence", F.lit(0.0)) >= threshold)
    source = batch.select("batch_id", F.col("idx").alias("from_idx"), F.col("block_id").alias("src"))
    target = batch.select("batch_id", F.col("idx").alias("to_idx"), F.col("block_id").alias("dst"))
    return (
        rows.join(source, ["batch_id", "from_idx"]).join(target, ["batch_id", "to_idx"])
        .select("batch_id", "src", "dst", "rel_type", "confidence", F.lit(0.0).alias("similarity"))
    )


def inspect_body(blocks: DataFrame, body: str = "body") -> DataFrame:
    """JSN9: key flags, counts and a goal preview per block."""
    fields = body_fields(blocks.withColumn("_keys", keys_of(F.col(body))), body)
    none = F.array().cast("array<string>")
    keys = F.coalesce("_keys", none)
    return fields.select(
        "block_id",
        F.array_join(F.array_sort(keys), ",").alias("body_keys"),
        F.array_contains(keys, "segments").alias("has_segments"),
        F.array_contains(keys, "core").alias("has_core"),
        F.size("segments").cast("long").alias("n_segments"),
        F.size("qa_items").cast("long").alias("n_qa"),
        preview(F.col("core_goal"), 50).alias("goal_preview"),
    )


def merge_card_responses(batches: DataFrame, responses: DataFrame, drop_unanswered: bool = False) -> DataFrame:
    """JSN10: cards improved by a response array, matched to their batch by position.

    ``batches(batch_id, pos, question, answer, context)``; ``responses(batch_id, response)``.  A field
    missing in the response keeps the card's value.  A malformed response leaves basic cards for the
    whole batch.  Cards that a well-formed response does not reach stay as basic cards;
    ``drop_unanswered`` drops them.
    """
    item = "array<struct<question:string,answer:string,difficulty:string,tags:array<string>>>"
    text = strip_fences(F.col("response"), bare=True)
    parsed = responses.select("batch_id", F.from_json(text, item).alias("rs"))
    answered = parsed.select("batch_id", F.posexplode("rs").alias("pos", "r"))
    well_formed = parsed.where(F.col("rs").isNotNull()).select("batch_id", F.lit(True).alias("well_formed"))
    joined = batches.join(answered, ["batch_id", "pos"], "left").join(well_formed, "batch_id", "left")
    if drop_unanswered:
        joined = joined.where(F.col("r").isNotNull() | F.col("well_formed").isNull())
    basic_tag = F.array(F.replace(F.lower("context"), F.lit(" "), F.lit("_")))
    return joined.select(
        "batch_id", "pos",
        F.coalesce("r.question", "question").alias("question"),
        F.coalesce("r.answer", "answer").alias("answer"),
        "context",
        F.coalesce("r.difficulty", F.lit("medium")).alias("difficulty"),
        F.when(F.col("r").isNull(), basic_tag).otherwise(
            F.coalesce("r.tags", F.array().cast("array<string>"))).alias("tags"),
        F.col("r").isNotNull().alias("improved"),
    )
