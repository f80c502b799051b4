"""Progress and catalogue analytics (ANA1-ANA19).

Counts are conditional aggregates with map-side combine; children are aggregated before they are joined,
so nothing fans out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .body import body_format
from .ranking import global_rank
from .scheduling import MINUTES_PER_BLOCK, due_list, struggling

PLANNED_TOTAL = 32           # fixed value: the denominator one of the progress figures uses
DUE_HEAD, STRUGGLING_HEAD, NEW_HEAD = 10, 5, 10


def _head(rows: DataFrame, n: int, name: str) -> DataFrame:
    """The first ``n`` block ids per learner as an array and their number."""
    top = rows.where(F.col("place") <= n).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("place", "block_id"))).alias("h"))
    return top.select("user_id", F.transform("h", lambda x: x["block_id"]).alias(name), F.size("h").cast("long").alias(f"n_{name}"))


def dashboard(states: DataFrame, as_of: str, new: DataFrame | None = None) -> DataFrame:
    """ANA1: one row per learner: studied blocks, mean rating, mastery buckets, and the heads of the due,
    struggling and new lists.  ``new(user_id, block_id, master_pos)`` is optional."""
    r = F.col("avg_rating")
    totals = states.groupBy("user_id").agg(
        F.count("*").alias("studied"), F.coalesce(F.avg(r), F.lit(0.0)).alias("mean_rating"),
        F.count_if(r >= 4.5).alias("excellent"), F.count_if((r >= 3.5) & (r < 4.5)).alias("good"), F.count_if(r < 3.5).alias("needs_work"),
    )
    heads = [_head(due_list(states, as_of), DUE_HEAD, "due"), _head(struggling(states), STRUGGLING_HEAD, "struggling")]
    if new is not None:
        placed = new.withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy("master_pos")))
        heads.append(_head(placed, NEW_HEAD, "new"))
    for head in heads:
        totals = totals.join(head, "user_id", "left")
    none = F.array().cast("array<bigint>")
    fill = {c: none if dtype.startswith("array") else F.lit(0) for c, dtype in totals.dtypes}
    return totals.select(*[c if c == "user_id" else F.coalesce(c, fill[c]).alias(c) for c in totals.columns])


def recommendations(board: DataFrame) -> DataFrame:
    """ANA2: (user_id, kinds, titles); the counts are those of the truncated heads."""
    options = [
        (F.col("n_struggling") > 0, "warning", F.concat(F.col("n_struggling").cast("string"), F.lit(" blocks need attention"))),
        (F.col("n_due") > 5, "info", F.concat(F.col("n_due").cast("string"), F.lit(" blocks due for review"))),
        (F.col("mean_rating") > 4.0, "success", F.lit("Excellent progress!")),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), t.alias("title"))) for c, k, t in options]))
    default = F.array(F.struct(F.lit("info").alias("kind"), F.lit("Ready to start learning!").alias("title")))
    rows = board.withColumn("_r", F.when(F.size(found) > 0, found).otherwise(default))
    return rows.select("user_id", F.transform("_r", lambda x: x["kind"]).alias("kinds"), F.transform("_r", lambda x: x["title"]).alias("titles"))


def completion_stats(attempts: DataFrame, blocks: DataFrame) -> DataFrame:
    """ANA3: per block the completions, the last one and its rating, and the mean time (unknown times count as 0)."""
    done = attempts.where(F.col("status") == "completed").groupBy("block_id").agg(
        F.count("*").alias("completions"), F.max("completed_at").alias("last_completed"),
        F.max_by("proficiency", F.struct("completed_at", "attempt_id")).alias("last_proficiency"),
        (F.sum(F.coalesce("study_s", F.lit(0.0))) / F.count("*")).alias("mean_time"),
    )
    return blocks.select("block_id").join(done, "block_id", "left").select(
        "block_id", F.coalesce("completions", F.lit(0)).alias("completions"), "last_completed", "last_proficiency",
        F.coalesce("mean_time", F.lit(0.0)).alias("mean_time"), F.when(F.col("completions").isNull(), "new").otherwise("completed").alias("category"))


def _counts(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("doc_id").agg(F.count("*").alias(name))


def catalogue(docs: DataFrame, blocks: DataFrame, chunks: DataFrame, units: DataFrame) -> DataFrame:
    """ANA4: children per document and study minutes; ready documents are those with blocks."""
    out = docs
    for frame, name in ((blocks, "n_blocks"), (chunks, "n_chunks"), (units, "n_units")):
        out = out.join(_counts(frame, name), "doc_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out.withColumn("minutes", F.col("n_blocks") * MINUTES_PER_BLOCK).withColumn("ready", F.col("n_blocks") > 0)


def status_counts(docs: DataFrame, units: DataFrame, compat: bool = False) -> DataFrame:
    """ANA5: one row of counters over ``docs(doc_id, processed, is_duplicate, error)``.

    ``compat`` counts a ready document once per unit, as the joined count of the listing does."""
    sized = docs.join(_counts(units, "n_units"), "doc_id", "left")
    ready = F.col("processed") & F.col("n_units").isNotNull()
    n_ready = F.sum(F.when(ready, F.col("n_units")).otherwise(0)) if compat else F.count_if(ready)
    return sized.agg(
        F.count("*").alias("total"), F.coalesce(n_ready, F.lit(0)).alias("ready"), F.count_if(~F.col("processed")).alias("processing"),
        F.count_if(F.col("is_duplicate")).alias("duplicates"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("errors"))


def list_documents(docs: DataFrame, units: DataFrame, status: str = "all", search: str = "") -> DataFrame:
    """ANA5: the listing with a status filter and a case-insensitive name search."""
    out = docs
    if status == "ready":
        out = out.where("processed").join(units.select("doc_id"), "doc_id", "left_semi")
    elif status == "processing":
        out = out.where("not processed")
    elif status == "duplicates":
        out = out.where("is_duplicate")
    elif status == "errors":
        out = out.where(F.coalesce("error", F.lit("")) != "")
    return out.where(F.contains(F.lower("name"), F.lit(search.lower()))) if search else out


def processing_report(docs: DataFrame, chunks: DataFrame, labels: DataFrame, units: DataFrame) -> DataFrame:
    """ANA6: per document the chunk, label and unit totals, minutes, units without chunks, chunks without labels.

    ``labels(doc_id, chunk_order, concept_order)``, ``units(doc_id, concept_order, reading_min)``."""
    key = ["doc_id", "concept_order"]
    orphans = _counts(units.join(labels.select(*key), key, "left_anti"), "orphan_units")
    bare = _counts(chunks.join(labels.select("doc_id", "chunk_order"), ["doc_id", "chunk_order"], "left_anti"), "unlabelled_chunks")
    times = units.groupBy("doc_id").agg(F.count("*").alias("n_units"), F.sum("reading_min").alias("total_minutes"))
    out = docs.select("doc_id")
    for frame in (_counts(chunks, "n_chunks"), _counts(labels, "n_labels"), times, orphans, bare):
        out = out.join(frame, "doc_id", "left")
    out = out.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in out.columns if c != "doc_id"])
    return out.withColumn("mean_minutes", F.when(F.col("n_units") > 0, F.col("total_minutes") / F.col("n_units")).otherwise(0.0))


def unit_breakdown(labels: DataFrame) -> DataFrame:
    """ANA6: per unit the chunks, labels used, keywords and mean confidence."""
    words = labels.select("doc_id", "concept_order", F.explode_outer("keywords").alias("k")).groupBy("doc_id", "concept_order").agg(
        F.array_sort(F.collect_set("k")).alias("keywords"))
    return labels.groupBy("doc_id", "concept_order").agg(
        F.count("*").alias("n_chunks"), F.array_sort(F.collect_set("primary_label")).alias("labels_used"), F.avg("confidence").alias("mean_confidence")
    ).join(words, ["doc_id", "concept_order"])


def label_distribution(labels: DataFrame) -> DataFrame:
    """ANA6: chunks per label and their share in percent; at most one row per label of the vocabulary."""
    counted = labels.groupBy("primary_label").agg(F.count("*").alias("n"))
    share = F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 1)
    return counted.withColumn("percentage", share)


def reconcile(a: DataFrame, b: DataFrame) -> DataFrame:
    """ANA7: completions per source, their distinct union, keys of one source only, and whether b adds any."""
    marks = a.select("block_id").distinct().withColumn("src", F.lit(1)).unionByName(b.select("block_id").distinct().withColumn("src", F.lit(2)))
    merged = marks.groupBy("block_id").agg(F.sum("src").alias("m"))
    return merged.agg(
        F.count_if(F.col("m") != 2).alias("in_a"), F.count_if(F.col("m") != 1).alias("in_b"), F.count("*").alias("merged"),
        F.count_if(F.col("m") == 1).alias("only_a"), F.count_if(F.col("m") == 2).alias("only_b"),
    ).withColumn("sync_working", F.col("merged") > F.col("in_a"))


def corpus_progress(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """ANA8: one row: blocks, segments, hours, edges and edges per type.  ``blocks`` has segments and duration_s."""
    a = blocks.agg(F.count("*").alias("n_blocks"), F.coalesce(F.sum(F.size("segments")), F.lit(0)).alias("n_segments"),
                   (F.coalesce(F.sum("duration_s"), F.lit(0)) / 3600).alias("hours"), F.lit(1).alias("one"))
    kinds = ("prerequisite", "builds_on", "related")
    b = edges.agg(F.count("*").alias("n_edges"), *[F.count_if(F.col("rel_type") == k).alias(f"n_{k}") for k in kinds], F.lit(1).alias("one"))
    return a.join(b, "one").drop("one")


def format_stats(blocks: DataFrame, by_document: bool = False) -> DataFrame:
    """ANA9: blocks per body format; pending are the old and legacy ones."""
    kind = body_format(F.col("body"), F.col("title"), F.col("script"))
    rows = blocks.withColumn("_f", kind)
    grouped = rows.groupBy("doc_id") if by_document else rows.groupBy()
    return grouped.agg(
        F.count("*").alias("total"), *[F.count_if(F.col("_f") == f).alias(f"n_{f}") for f in ("migrated", "new", "old", "legacy", "empty")],
        F.count_if(F.col("_f").isin("old", "legacy")).alias("pending"))


def audit(docs: DataFrame, units: DataFrame, labels: DataFrame) -> DataFrame:
    """ANA10: documents that have units but no labelled chunk, with their number of units."""
    return docs.select("doc_id").join(_counts(units, "n_units"), "doc_id").join(labels.select("doc_id"), "doc_id", "left_anti")


def completion_log(attempts: DataFrame, blocks: DataFrame) -> DataFrame:
    """ANA11: completed attempts with the 0-based catalogue position of their block, ranked once for all."""
    ranked = global_rank(blocks.select("block_id", "doc_id", "block_order", "title"), [F.col("doc_id"), F.col("block_order"), F.col("block_id")], "block_index")
    return attempts.where(F.col("status") == "completed").join(ranked, "block_id").select(
        "attempt_id", "block_id", "title", "block_index", "proficiency", "study_s", "completed_at")


def review_calendar(states: DataFrame, as_of: str, days: int = 30) -> tuple[DataFrame, DataFrame]:
    """ANA12: (due rows with days_overdue, upcoming reviews per learner and date within ``days``)."""
    now = F.lit(as_of).cast("timestamp_ntz")
    due_at = F.col("next_due_at").cast("timestamp_ntz")
    today = F.to_date(now)
    due = states.where(F.to_date(due_at) <= today).withColumn(
        "days_overdue", F.floor(F.timestamp_diff("SECOND", due_at, today.cast("timestamp_ntz")) / 86400).cast("long"))
    ahead = states.where((due_at > now) & (due_at <= now + F.make_dt_interval(days=F.lit(days))))
    return due, ahead.groupBy("user_id", F.to_date(due_at).alias("due_date")).agg(F.count("*").alias("n_reviews"))


def shift_reviews(states: DataFrame, ids: DataFrame, days: int) -> DataFrame:
    """ANA12: the due time of ``ids(user_id, block_id)`` moved by ``days``."""
    keys = ["user_id", "block_id"]
    marked = states.join(ids.select(*keys).distinct().withColumn("_hit", F.lit(True)), keys, "left")
    moved = F.when(F.col("_hit").isNotNull(), F.col("next_due_at") + F.make_dt_interval(days=F.lit(days))).otherwise(F.col("next_due_at"))
    return marked.withColumn("next_due_at", moved).select(*states.columns)


def incomplete(plans: DataFrame, completed: DataFrame) -> DataFrame:
    """ANA13: unfinished plans: counts, percent, and the block at the place after the completed ones.

    ``plans(user_id, block_id, place)``, place from 1."""
    marked = plans.join(completed.select("user_id", "block_id").distinct().withColumn("c", F.lit(1)), ["user_id", "block_id"], "left")
    sums = marked.groupBy("user_id").agg(F.count("*").alias("planned"), F.sum(F.coalesce("c", F.lit(0))).alias("completed"))
    open_ = sums.where("completed < planned")
    nxt = open_.join(plans.select("user_id", F.col("block_id").alias("next_block_id"), "place"), "user_id").where(F.col("place") == F.col("completed") + 1)
    return nxt.select("user_id", "planned", "completed", F.floor(F.col("completed") * 100 / F.col("planned")).alias("percent"), "next_block_id")


def segment_progress(progress: DataFrame, blocks: DataFrame) -> DataFrame:
    """ANA14: percent of segments done per (session, block).  ``progress`` has the array segments_done,
    ``blocks(block_id, n_segments)``."""
    done = F.size(F.array_distinct("segments_done"))
    return progress.join(blocks.select("block_id", "n_segments"), "block_id").select(
        "session_id", "block_id", F.when(F.col("n_segments") > 0, done * 100.0 / F.col("n_segments")).otherwise(0.0).alias("percent"))


def session_progress(completed: DataFrame, blocks: DataFrame) -> DataFrame:
    """ANA14: percent of a document's blocks completed per (session, document), one decimal."""
    totals = _counts(blocks, "n_blocks")
    done = completed.select("session_id", "block_id").distinct().join(blocks.select("block_id", "doc_id"), "block_id")
    return done.groupBy("session_id", "doc_id").agg(F.count("*").alias("n_done")).join(totals, "doc_id").select(
        "session_id", "doc_id", "n_done", "n_blocks", F.round(F.col("n_done") / F.col("n_blocks") * 100, 1).alias("percent"))


def attempt_stats(attempts: DataFrame) -> DataFrame:
    """ANA15: per block: attempts, mean study seconds and mean proficiency of the completed ones."""
    done = F.col("status") == "completed"
    return attempts.groupBy("block_id").agg(
        F.count("*").alias("n_attempts"), F.count_if(done).alias("n_completed"),
        F.avg(F.when(done, F.col("study_s"))).alias("mean_study_s"), F.avg(F.when(done, F.col("proficiency"))).alias("mean_proficiency"))


def study_seconds(started: Column, completed: Column) -> Column:
    """ANA15: seconds between start and completion."""
    return F.timestamp_diff("SECOND", started, completed)


def confusion_histogram(attempts: DataFrame) -> DataFrame:
    """ANA15: completed attempts per confusion point.  ``confusion`` is an array."""
    return attempts.where(F.col("status") == "completed").select(F.explode("confusion").alias("point")).groupBy("point").agg(F.count("*").alias("n"))


def latest_open(attempts: DataFrame) -> DataFrame:
    """ANA15: the latest active or paused attempt per learner."""
    open_ = attempts.where(F.col("status").isin("active", "paused"))
    best = F.max_by(F.struct("attempt_id", "block_id", "status"), F.struct("completed_at", "attempt_id"))
    return open_.groupBy("user_id").agg(best.alias("a")).select("user_id", "a.*")


def unseen_sample(cards: DataFrame, sessions: DataFrame, shown: DataFrame, n: int = 10, seed: int = 42) -> DataFrame:
    """ANA16: up to ``n`` cards per session, not shown before, in a seeded random order.

    ``cards(card_id, folder_id)``, ``sessions(session_id, folder_id)``, ``shown(session_id, card_id)``.  A
    session that has seen all its cards starts over.  The order is a hash of seed, session and card, so it
    is the same on every run; only ``n`` rows per session and task reach the final rank.
    """
    pairs = sessions.join(cards, "folder_id").select("session_id", "card_id")
    marked = pairs.join(shown.select("session_id", "card_id").distinct().withColumn("_s", F.lit(True)), ["session_id", "card_id"], "left")
    fresh = marked.groupBy("session_id").agg(F.count_if(F.col("_s").isNull()).alias("n_fresh"))
    pool = marked.join(fresh, "session_id").where(F.col("_s").isNull() | (F.col("n_fresh") == 0))
    draw = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("session_id").cast("string"), F.col("card_id").cast("string")))
    place = F.row_number().over(W.partitionBy("session_id").orderBy("_d", "card_id"))
    return pool.withColumn("_d", draw).withColumn("place", place.cast("long")).where(F.col("place") <= n).select(
        "session_id", "card_id", "place", (F.col("n_fresh") == 0).alias("restarted"))


def order_totals(order: DataFrame) -> DataFrame:
    """ANA17: minutes and days (two hours each, at least one) of a study order with duration_s."""
    total = order.agg(F.coalesce(F.sum(F.coalesce("duration_s", F.lit(420))), F.lit(0)).alias("s"), F.count("*").alias("n_blocks"))
    return total.select("n_blocks", (F.col("s") / 60).alias("total_minutes"), F.greatest(F.lit(1).cast("long"), F.floor(F.col("s") / 60 / 120)).alias("days"))


def card_catalogue(cards: DataFrame, folders: DataFrame, docs: DataFrame) -> DataFrame:
    """ANA18: cards with the type and name of their source.  ``cards(card_id, folder_id, doc_id, difficulty)``."""
    joined = cards.join(folders.select("folder_id", F.col("name").alias("_f")), "folder_id", "left").join(
        docs.select("doc_id", F.col("name").alias("_d")), "doc_id", "left")
    return joined.select(
        "card_id", "difficulty", F.when(F.col("_f").isNotNull(), "folder").when(F.col("_d").isNotNull(), "document").otherwise("unknown").alias("source_type"),
        F.coalesce("_f", "_d", F.lit("Unknown")).alias("source_name"))


def card_counts(listed: DataFrame, difficulty: str | None = None) -> DataFrame:
    """ANA18: cards per source, optionally of one difficulty."""
    rows = listed if difficulty is None else listed.where(F.col("difficulty") == difficulty)
    return rows.groupBy("source_type", "source_name").agg(F.count("*").alias("n_cards"))


def sequence_summary(sequence: DataFrame, reviews: DataFrame, denominator: int | None = None) -> DataFrame:
    """ANA19: per learner the length, kinds, next blocks, studied count and progress of a sequence.

    ``denominator=None`` divides by the length; PLANNED_TOTAL reproduces the fixed figure."""
    totals = sequence.groupBy("user_id").agg(
        F.count("*").alias("length"), F.count_if(F.col("type") == "new").alias("n_new"), F.count_if(F.col("type") == "review").alias("n_review"))
    head = sequence.where(F.col("position") <= 5).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("position", "block_id"))).alias("h"))
    studied = reviews.groupBy("user_id").agg(F.count("*").alias("studied"))
    base = F.col("length") if denominator is None else F.lit(denominator)
    return totals.join(head, "user_id", "left").join(studied, "user_id", "left").withColumn("studied", F.coalesce("studied", F.lit(0))).select(
        "user_id", "length", "n_new", "n_review", F.transform("h", lambda x: x["block_id"]).alias("next_blocks"), "studied",
        (F.col("studied") / base * 100).alias("progress_percent"), (F.col("length") * MINUTES_PER_BLOCK).alias("minutes"))
