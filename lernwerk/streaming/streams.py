"""Structured Streaming: document intake, review state, offline progress, attempts (STR1-STR5).

Sinks are idempotent per micro-batch: every batch writes its own partition or records its number in the
rows it changes, so a batch that is replayed after a lost executor or driver leaves the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.text import clean_text, content_hash
from ..operators.chunking import fixed_chunks
from ..operators.scheduling import STATE_FIELDS, STATE_NAMES, fold_reviews, step_block, step_day, step_sync, step_sync_enhanced
from ..session import cut
from ..sources.documents import table_exists
from .versions import Versions

EPOCH = "1970-01-01 00:00:00"


def micros(c: Column) -> Column:
    """Microseconds of a zone-free timestamp."""
    return F.timestamp_diff("MICROSECOND", F.lit(EPOCH).cast("timestamp_ntz"), c.cast("timestamp_ntz"))


# --- documents --------------------------------------------------------------------------------

def ingest(stream: DataFrame, known_path: str, out_path: str, size: int = 300) -> DataStreamWriter:
    """STR1: new documents are cleaned, hashed, checked against known hashes, chunked and appended.

    ``stream(doc_id, text)``.  The lowest id of a hash inside a batch wins, and a hash known from an earlier
    batch is dropped.  Both tables are partitioned by batch number and a batch overwrites its own
    partition only.
    """
    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        rows = df.select("doc_id", clean_text(F.col("text")).alias("text")).withColumn("content_hash", content_hash(F.col("text"))).where("content_hash <> ''")
        first = rows.groupBy("content_hash").agg(F.min("doc_id").alias("doc_id"))
        if table_exists(spark, known_path):
            earlier = spark.read.parquet(known_path).where(F.col("batch_id") < batch_id).select("content_hash")
            first = first.join(earlier, "content_hash", "left_anti")
        chunks = fixed_chunks(rows.join(first, ["content_hash", "doc_id"], "left_semi").drop("content_hash"), size)
        _write_batch(chunks, out_path, batch_id)
        _write_batch(first, known_path, batch_id)

    return stream.writeStream.foreachBatch(batch)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    df.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


# --- review state -----------------------------------------------------------------------------

class KeyedFold:
    """A stream folded into one state per key, kept as versions of a table (see ``versions``).

    ``update(rows, stored)`` gives the new states of the keys in ``rows``; ``stored`` are their states so far, or None.  A
    batch reads the states of its own keys only, and no group is collected: how rows meet their state is up to ``update``."""

    def __init__(self, stream: DataFrame, keys: list[str], schema: str, update: Callable[[DataFrame, DataFrame | None], DataFrame], idle_us: int | None = None, fanout: int = 8):
        self.stream, self.keys, self.schema, self.update, self.idle_us, self.fanout = stream, keys, schema, update, idle_us, fanout
        self.sparkSession = stream.sparkSession

    def versions(self, spark: SparkSession, path: str) -> Versions:
        return Versions(spark, path, self.keys, self.schema, self.fanout, self.idle_us)

    def into(self, path: str, sink: Callable[[DataFrame, int], None] | None = None) -> DataStreamWriter:
        """Write the states to ``path``; ``sink(changed states, batch)`` follows every batch."""
        def batch(df: DataFrame, batch_id: int) -> None:
            spark = df.sparkSession
            held = self.versions(spark, path)
            rows = cut(df) if batch_id else df
            stored = held.of(rows.select(*self.keys).distinct(), batch_id)
            done = held.put(batch_id, self.update(rows, stored))
            if sink is not None:
                sink(done.drop("version"), batch_id)

        return self.stream.writeStream.foreachBatch(batch)


REVIEW_STATE = f"user_id long, block_id long, {STATE_FIELDS}, last_us long, late boolean"


def review_states(stream: DataFrame, mode: str = "block", idle_us: int | None = None, fanout: int = 8) -> KeyedFold:
    """STR2: a stream of reviews to the current state per (user_id, block_id).

    Inside a micro-batch the reviews of a key apply in event-time order, behind the state that the key had: sorted
    partitions stream through the fold of SRS1 and SRS2 with one state in memory.  A review older than the last one already
    applied is applied on arrival and marks the state ``late``.  last_us is the newest event time in microseconds."""
    step = {"block": step_block, "day": step_day}[mode]

    def update(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
        initial = None if stored is None else stored.withColumn("last_reviewed_at", F.col("last_us"))
        return fold_reviews(rows.withColumnRenamed("us", "ts"), step, initial=initial, late=True).select(
            "user_id", "block_id", *STATE_NAMES, F.col("last_reviewed_at").alias("last_us"), "late")

    reviews = stream.select("user_id", "block_id", "event_id", micros(F.col("ts")).alias("us"), "rating", "time_s", "qa_correct", "qa_total")
    return KeyedFold(reviews, ["user_id", "block_id"], REVIEW_STATE, update, idle_us, fanout)


# --- offline progress -------------------------------------------------------------------------

PROGRESS_SCHEMA = "report_id string, user_id long, block_id long, proficiency_rating int, time_spent_seconds long, completed_at timestamp"


def validate_progress(reports: DataFrame, blocks: DataFrame, enhanced: bool = False) -> DataFrame:
    """Reports with ``error``: missing id or rating, unknown block, or null.  The enhanced variant rates 3 by default."""
    rated = reports.withColumn("proficiency_rating", F.coalesce("proficiency_rating", F.lit(3))) if enhanced else reports
    known = rated.join(blocks.select("block_id").withColumn("_known", F.lit(True)), "block_id", "left")
    error = F.when(F.col("block_id").isNull() | F.coalesce(F.col("proficiency_rating") == 0, F.lit(True)), "missing required data").when(
        F.col("_known").isNull(), "block not found")
    return known.withColumn("error", error).drop("_known")


PROGRESS_STATE = f"user_id long, block_id long, last_reviewed_at timestamp, {STATE_FIELDS}"


def progress_versions(spark: SparkSession, path: str, fanout: int = 8) -> Versions:
    """The state table of ``merge_progress``; ``current()`` reads the newest version of every state."""
    return Versions(spark, path, ["user_id", "block_id"], PROGRESS_STATE, fanout)


def merge_progress(
    stream: DataFrame, blocks: DataFrame, states_path: str, quarantine_path: str, counts_path: str,
    watermark: str = "7 days", enhanced: bool = False, fanout: int = 8,
) -> DataStreamWriter:
    """STR3: offline reports into versions of the states at ``states_path``.

    ``stream`` has PROGRESS_SCHEMA.  Retries of a report_id inside the watermark are dropped.  Bad rows go to the quarantine
    table, counts per batch to ``counts_path``.  A batch reads the states of its own keys and appends the changed ones; a
    replayed batch reads the states from before it and leaves the same rows."""
    step = step_sync_enhanced if enhanced else step_sync
    keys = ["user_id", "block_id"]

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        checked = cut(validate_progress(df, blocks, enhanced))
        _write_batch(checked.where("error is not null"), quarantine_path, batch_id)
        good = checked.where("error is null").select(
            *keys, F.col("completed_at").alias("ts"), F.xxhash64("report_id").alias("event_id"), F.col("proficiency_rating").alias("rating"),
            F.coalesce("time_spent_seconds", F.lit(0)).alias("time_s"), F.lit(0).alias("qa_correct"), F.lit(0).alias("qa_total"))
        held = progress_versions(spark, states_path, fanout)
        held.put(batch_id, fold_reviews(good, step, "new", held.of(good.select(*keys).distinct(), batch_id)))
        totals = checked.agg(F.count_if(F.col("error").isNull()).alias("synced"), F.count_if(F.col("error").isNotNull()).alias("errors"))
        _write_batch(totals, counts_path, batch_id)

    return stream.withWatermark("completed_at", watermark).dropDuplicatesWithinWatermark(["report_id"]).writeStream.foreachBatch(batch)


def new_since(blocks: DataFrame, ts: str, page: int | None = None, after: tuple[str, int] | None = None) -> DataFrame:
    """STR4: blocks created after the last sync, oldest first.

    With ``page``, the first so many of them; the (created_at, block_id) of the last one, given as ``after``, brings
    the next page, and the pages together are the whole."""
    rows = blocks.where(F.col("created_at") > F.lit(ts).cast("timestamp_ntz"))
    if after is not None:
        rows = rows.where(F.struct("created_at", "block_id") > F.struct(F.lit(after[0]).cast("timestamp_ntz").alias("created_at"), F.lit(after[1]).cast("long").alias("block_id")))
    rows = rows.orderBy("created_at", "block_id")
    return rows if page is None else rows.limit(page)


# --- attempts ---------------------------------------------------------------------------------

# The status each action leads to.
ACTION_STATUS = {"start": "active", "pause": "paused", "resume": "active", "complete": "completed"}


def attempt_rows(events: DataFrame) -> DataFrame:
    """STR5 in batch: attempt rows from events, as aggregates that combine on the map side.

    ``events(event_id, attempt_id, action, segment_index, time_s, ts)``."""
    status = F
    for action, value in ACTION_STATUS.items():
        status = status.when(F.col("action") == action, value)
    at = F.struct("ts", "event_id")
    rows = events.withColumn("_s", status.otherwise(None)).withColumn("_seg", F.when(F.col("action") == "complete_segment", F.col("segment_index")))
    return rows.groupBy("attempt_id").agg(
        F.coalesce(F.max_by("_s", F.when(F.col("_s").isNotNull(), at)), F.lit("active")).alias("status"),
        F.array_sort(F.collect_set("_seg")).alias("segments"),
        F.max_by("time_s", F.when(F.col("action") == "complete", at)).cast("long").alias("study_s"),
    )


ATTEMPT_STATE = (
    "attempt_id long, status string, status_at struct<us: bigint, event: bigint>, segments array<long>, study_s long, "
    "done_at struct<us: bigint, event: bigint>, last_us long"
)


def attempt_states(stream: DataFrame, idle_us: int | None = None, fanout: int = 8) -> KeyedFold:
    """STR5: attempt rows from a stream of events, whatever the order they arrive in.

    What an event leaves (the latest status, the latest completion, a finished segment) is a maximum or a set, so a batch
    is aggregated on the map side and one row per attempt meets the stored one."""
    latest = lambda value, at: F.max_by(value, F.when(F.col(value).isNotNull() & F.col(at).isNotNull(), F.col(at)))

    def combined(rows: DataFrame) -> DataFrame:
        return rows.groupBy("attempt_id").agg(
            latest("status", "status_at").alias("status"), F.max("status_at").alias("status_at"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("segments")))).alias("segments"),
            F.max_by("study_s", "done_at").alias("study_s"), F.max("done_at").alias("done_at"), F.max("last_us").alias("last_us"))

    def update(rows: DataFrame, stored: DataFrame | None) -> DataFrame:
        at = F.struct("us", F.col("event_id").alias("event"))
        status = F
        for action, value in ACTION_STATUS.items():
            status = status.when(F.col("action") == action, value)
        done = F.col("action") == "complete"
        rows = rows.select("attempt_id", "us", status.otherwise(None).alias("status"), F.when(F.col("action").isin(*ACTION_STATUS), at).alias("status_at"),
            F.when(F.col("action") == "complete_segment", F.col("segment_index").cast("long")).alias("segment"),
            F.when(done, F.col("time_s").cast("long")).alias("study_s"), F.when(done, at).alias("done_at"))
        rows = rows.groupBy("attempt_id").agg(
            latest("status", "status_at").alias("status"), F.max("status_at").alias("status_at"), F.collect_set("segment").alias("segments"),
            F.max_by("study_s", "done_at").alias("study_s"), F.max("done_at").alias("done_at"), F.max("us").alias("last_us"))
        both = rows if stored is None else rows.unionByName(stored.drop("version"))
        out = combined(both)
        return out.withColumn("status", F.coalesce("status", F.lit("active")))

    events = stream.select("attempt_id", "event_id", micros(F.col("ts")).alias("us"), "action", "segment_index", "time_s")
    return KeyedFold(events, ["attempt_id"], ATTEMPT_STATE, update, idle_us, fanout)


# --- running ----------------------------------------------------------------------------------

def drain(stream: DataFrame | KeyedFold, folder: str, mode: str = "update") -> DataFrame:
    """Run a stream over all available input into a parquet table below ``folder`` and read it back with batch_id.

    For a fold these are the states that each batch changed; the state table itself is at ``folder``/state."""
    spark: SparkSession = stream.sparkSession
    out = f"{folder}/rows"
    write = lambda df, batch_id: _write_batch(df, out, batch_id)
    writer = stream.into(f"{folder}/state", write) if isinstance(stream, KeyedFold) else stream.writeStream.outputMode(mode).foreachBatch(write)
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)
