import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lernwerk.operators import scheduling as sc
from lernwerk.operators.chunking import fixed_chunks
from lernwerk.functions.text import clean_text
from lernwerk.streaming import streams as st
from lernwerk.streaming.versions import Versions

T0 = dt.datetime(2024, 1, 1)


def in_files(df, path, parts, key="event_id"):
    """Write ``df`` as ``parts`` files in key order, so that a stream reads them as successive batches."""
    for p in range(parts):
        df.where(F.col("part") == p).drop("part").coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def review_frame(spark):
    rng = random.Random(20)
    rows = [(rng.randrange(3), rng.randrange(3), T0 + dt.timedelta(hours=h), h, rng.randint(1, 5), 5, 1, 2, h // 20) for h in range(60)]
    return spark.createDataFrame(rows, "user_id long, block_id long, ts timestamp_ntz, event_id long, rating long, time_s long, qa_correct long, qa_total long, part long")


def test_review_stream_equals_batch(spark, tmp_path):
    df = review_frame(spark)
    in_files(df, f"{tmp_path}/in", 3)
    for mode, batch in (("block", sc.block_state), ("day", sc.day_state)):
        rows = st.drain(st.review_states(stream_of(spark, f"{tmp_path}/in", df.drop("part").schema), mode), f"{tmp_path}/{mode}")
        assert rows.select("batch_id").distinct().count() == 3
        latest = rows.groupBy("user_id", "block_id").agg(F.max_by(F.struct("status", "review_count", "ease", "stability", "avg_rating", "late"), "batch_id").alias("s"))
        got = {(r["user_id"], r["block_id"]): tuple(r["s"])[:5] for r in latest.collect()}
        want = {(r["user_id"], r["block_id"]): (r["status"], r["review_count"], r["ease"], r["stability"], r["avg_rating"]) for r in batch(df).collect()}
        assert got == want
        assert not any(tuple(r["s"])[5] for r in latest.collect())


def test_attempt_stream_equals_batch(spark, tmp_path):
    rng = random.Random(21)
    actions = ["start", "complete_segment", "complete_segment", "pause", "resume", "complete"]
    rows = [(h, rng.randrange(6), rng.choice(actions), rng.randrange(4), h, T0 + dt.timedelta(minutes=h), h // 30) for h in range(90)]
    df = spark.createDataFrame(rows, "event_id long, attempt_id long, action string, segment_index long, time_s long, ts timestamp_ntz, part long")
    in_files(df, f"{tmp_path}/in", 3)
    out = st.drain(st.attempt_states(stream_of(spark, f"{tmp_path}/in", df.drop("part").schema)), f"{tmp_path}/o")
    latest = out.groupBy("attempt_id").agg(F.max_by(F.struct("status", "segments", "study_s"), "batch_id").alias("s"))
    got = {r["attempt_id"]: (r["s"]["status"], list(r["s"]["segments"]), r["s"]["study_s"]) for r in latest.collect()}
    want = {r["attempt_id"]: (r["status"], list(r["segments"]), r["study_s"]) for r in st.attempt_rows(df).collect()}
    assert got == want


def test_ingest_drops_known_copies(spark, tmp_path):
    rows = [(1, "alpha beta", 0), (2, "alpha beta", 0), (3, "gamma", 1), (4, "alpha beta", 1), (5, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part long")
    in_files(df, f"{tmp_path}/in", 2)
    writer = st.ingest(stream_of(spark, f"{tmp_path}/in", df.drop("part").schema), f"{tmp_path}/known", f"{tmp_path}/chunks", 1)
    writer.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/chunks")
    want = fixed_chunks(df.where("doc_id in (1, 3)").select("doc_id", clean_text(F.col("text")).alias("text")), 1)
    key = ["doc_id", "chunk_order", "chunk_text"]
    assert sorted(map(tuple, got.select(key).collect())) == sorted(map(tuple, want.select(key).collect()))


def test_progress_merge(spark, tmp_path):
    t = lambda h: T0 + dt.timedelta(hours=h)
    rows = [
        ("r1", 1, 1, 4, 60, t(0), 0), ("r1", 1, 1, 4, 60, t(0), 0), ("r2", 1, 2, None, 30, t(1), 0), ("r3", 1, 99, 5, 30, t(2), 0),
        ("r1", 1, 1, 4, 60, t(0), 1), ("r4", 1, 1, 5, 40, t(5), 1), ("r5", 2, 1, 2, 10, t(6), 1),
    ]
    df = spark.createDataFrame(rows, st.PROGRESS_SCHEMA + ", part long")
    blocks = spark.createDataFrame([(1,), (2,)], "block_id long")
    in_files(df, f"{tmp_path}/in", 2)
    writer = st.merge_progress(stream_of(spark, f"{tmp_path}/in", df.drop("part").schema), blocks, f"{tmp_path}/states", f"{tmp_path}/bad", f"{tmp_path}/counts")
    writer.option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    states = {(r["user_id"], r["block_id"]): r for r in st.progress_versions(spark, f"{tmp_path}/states").current().collect()}
    assert set(states) == {(1, 1), (2, 1)}
    a = states[1, 1]
    assert (a["status"], a["review_count"], a["time_s"]) == ("completed", 2, 100) and abs(a["avg_rating"] - (4 * 0.7 + 5 * 0.3)) < 1e-9
    bad = sorted((r["report_id"], r["error"]) for r in spark.read.parquet(f"{tmp_path}/bad").collect())
    assert bad == [("r2", "missing required data"), ("r3", "block not found")]
    counts = spark.read.parquet(f"{tmp_path}/counts").agg(F.sum("synced").alias("s"), F.sum("errors").alias("e")).first()
    assert (counts["s"], counts["e"]) == (3, 2)


def test_enhanced_progress_defaults_rating(spark):
    blocks = spark.createDataFrame([(1,)], "block_id long")
    rows = spark.createDataFrame([("a", 1, 1, None, 5, T0), ("b", 1, None, 4, 5, T0)], st.PROGRESS_SCHEMA)
    got = {r["report_id"]: (r["proficiency_rating"], r["error"]) for r in st.validate_progress(rows, blocks, True).collect()}
    assert got == {"a": (3, None), "b": (4, "missing required data")}


def test_pages_of_a_sync_are_the_whole(spark):
    from pyspark.sql import functions as F

    from lernwerk.streaming import streams

    blocks = spark.range(1, 251).select(F.col("id").alias("block_id"), F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id / 3 as int), 0)").alias("created_at"))
    start = "2024-01-01 00:10:00"
    whole = [r["block_id"] for r in streams.new_since(blocks, start).collect()]
    found, after = [], None
    while page := streams.new_since(blocks, start, page=40, after=after).collect():
        found += [r["block_id"] for r in page]
        after = str(page[-1]["created_at"]), page[-1]["block_id"]
    assert found == whole and len(whole) > 200


# --- versions of states


def test_live_runs_follow_from_the_number_of_batches(spark, tmp_path):
    held = Versions(spark, f"{tmp_path}/t", ["k"], "k long, v long", fanout=3)
    for n in range(60):
        runs = held.runs(n)
        assert [first for first, _ in runs] == [sum(size for _, size in runs[:i]) for i in range(len(runs))]
        assert sum(size for _, size in runs) == n and len(runs) <= 2 * 4


def test_versions_are_merged_replayed_and_forgotten(spark, tmp_path):
    rng = random.Random(31)
    held = Versions(spark, f"{tmp_path}/t", ["k"], "k long, v long", fanout=2)
    want = {}
    for batch in range(9):
        rows = [(k, rng.randrange(1000)) for k in rng.sample(range(12), 4)]
        df = spark.createDataFrame(rows, "k long, v long")
        stored = held.of(df, batch)
        assert {r["k"]: r["v"] for r in (stored.collect() if batch else [])} == {k: want[k] for k, _ in rows if k in want}
        held.put(batch, df)
        if batch % 3 == 1:
            # the batch comes again after a crash: it reads the states from before it and leaves the same table
            again = held.of(df, batch)
            assert {r["k"]: r["v"] for r in again.collect()} == {k: want[k] for k, _ in rows if k in want}
            held.put(batch, df)
        want |= dict(rows)
        assert {r["k"]: r["v"] for r in held.current().collect()} == want
    for batch in (9, 10):
        held.put(batch, df)
    assert held.batches() == 11
    # what was merged two batches ago is gone
    assert sorted(held._names("live")) == [held._name(*run) for run in ((0, 8), (8, 1), (8, 2), (9, 1), (10, 1))]


def test_a_run_that_broke_off_is_built_again(spark, tmp_path):
    import os

    held = Versions(spark, f"{tmp_path}/t", ["k"], "k long, v long", fanout=2)
    for batch in range(2):
        held.put(batch, spark.createDataFrame([(batch, batch)], "k long, v long"))
    os.remove(f"{tmp_path}/t/live/{held._name(0, 2)}/_SUCCESS")
    held.put(2, spark.createDataFrame([(0, 7)], "k long, v long"))
    assert sorted(map(tuple, held.current().select("k", "v").collect())) == [(0, 7), (1, 1)]
    with pytest.raises(ValueError, match="another checkpoint"):
        Versions(spark, f"{tmp_path}/other", ["k"], "k long, v long", fanout=2).put(5, spark.createDataFrame([(0, 7)], "k long, v long"))


def test_idle_states_leave_the_live_runs_and_late_reviews_find_them(spark, tmp_path):
    """Block 0 is idle for 10 days, so merges move it to the cold part; its next review goes on from its state."""
    hours = [(0, 0), (0, 1), (1, 2), (1, 240), (1, 250), (1, 260), (1, 270), (0, 280), (1, 281), (0, 3)]
    rows = [(1, b, T0 + dt.timedelta(hours=h), i, 1 + i % 5, 5, 1, 2, i) for i, (b, h) in enumerate(hours)]
    df = spark.createDataFrame(rows, "user_id long, block_id long, ts timestamp_ntz, event_id long, rating long, time_s long, qa_correct long, qa_total long, part long")
    in_files(df, f"{tmp_path}/in", len(rows))
    fold = st.review_states(stream_of(spark, f"{tmp_path}/in", df.drop("part").schema), idle_us=5 * 86_400_000_000, fanout=2)
    st.drain(fold, f"{tmp_path}/o")
    held = fold.versions(spark, f"{tmp_path}/o/state")
    cold = [n for p in held._cold() for n in [spark.read.schema(held.schema + ", bucket int").parquet(p).count()]]
    assert sum(cold) >= 1
    got = {r["block_id"]: r for r in held.current().collect()}
    assert got[0]["review_count"] == 4 and got[1]["review_count"] == 6 and got[0]["late"] and not got[1]["late"]
    want = {r["block_id"]: r for r in sc.block_state(df.where("event_id <> 9")).collect()}
    assert (got[1]["ease"], got[1]["status"], got[1]["interval"]) == (want[1]["ease"], want[1]["status"], want[1]["next_due_after"])
    # the late review counts when it arrives, after those it is older than
    s = {**sc.fresh_state()}
    for r in [x for x in rows if x[1] == 0]:
        sc.step_block(s, r[4], r[5], r[6], r[7])
    assert {n: got[0][n] for n in sc.STATE_NAMES} == s


def test_late_attempt_events_do_not_undo_newer_ones(spark, tmp_path):
    rows = [(1, 1, "start", None, None, 0, 0), (2, 1, "complete", None, 50, 60, 0), (3, 1, "pause", None, None, 30, 1), (4, 1, "complete_segment", 2, None, 20, 1), (5, 1, "complete", None, 9, 59, 2), (6, 2, "complete_segment", 1, None, 1, 2)]
    df = spark.createDataFrame([(e, a, x, s, t, T0 + dt.timedelta(minutes=m), p) for e, a, x, s, t, m, p in rows], "event_id long, attempt_id long, action string, segment_index long, time_s long, ts timestamp_ntz, part long")
    in_files(df, f"{tmp_path}/in", 3)
    fold = st.attempt_states(stream_of(spark, f"{tmp_path}/in", df.drop("part").schema), fanout=2)
    st.drain(fold, f"{tmp_path}/o")
    got = {r["attempt_id"]: (r["status"], r["segments"], r["study_s"]) for r in fold.versions(spark, f"{tmp_path}/o/state").current().collect()}
    assert got == {1: ("completed", [2], 50), 2: ("active", [1], None)}
    assert got == {r["attempt_id"]: (r["status"], r["segments"], r["study_s"]) for r in st.attempt_rows(df).collect()}


def test_progress_over_many_batches_equals_one(spark, tmp_path):
    """Versions with several levels, in both variants, against the step-by-step model."""
    rng = random.Random(33)
    rows = [(f"r{i}", rng.randrange(2), rng.randrange(4), rng.choice([None, 1, 2, 3, 4, 5]), rng.randrange(90), T0 + dt.timedelta(minutes=i), i // 8) for i in range(56)]
    df = spark.createDataFrame(rows, st.PROGRESS_SCHEMA + ", part long")
    blocks = spark.createDataFrame([(0,), (1,), (2,)], "block_id long")
    in_files(df, f"{tmp_path}/in", 7)
    for enhanced in (False, True):
        at = f"{tmp_path}/{enhanced}"
        writer = st.merge_progress(stream_of(spark, f"{tmp_path}/in", df.drop("part").schema), blocks, f"{at}/states", f"{at}/bad", f"{at}/counts", enhanced=enhanced, fanout=2)
        writer.option("checkpointLocation", f"{at}/cp").trigger(availableNow=True).start().awaitTermination()
        want = {}
        for _, user, block, rating, time_s, _, _ in rows:
            rating = 3 if rating is None and enhanced else rating
            if block > 2 or rating is None:
                continue
            s = want.setdefault((user, block), sc.fresh_state())
            (sc.step_sync_enhanced if enhanced else sc.step_sync)(s, rating, time_s, 0, 0)
        got = {(r["user_id"], r["block_id"]): {n: r[n] for n in sc.STATE_NAMES} for r in st.progress_versions(spark, f"{at}/states", 2).current().collect()}
        assert got == want


def test_a_table_streams_from_a_file_or_a_folder(spark, tmp_path):
    from lernwerk.derived import Tables
    from lernwerk.registry.flows import _events_stream, _ingested

    events = spark.createDataFrame([(i, i % 2) for i in range(7)], "event_id long, user_id long")
    texts = spark.createDataFrame([(i, f"words of text {i // 2}") for i in range(6)], "doc_id long, text string")
    for kind, parts in (("file", 1), ("folder", 3)):
        for name, df in (("events", events), ("documents", texts)):
            at = tmp_path / kind / f"{name}.parquet"
            if kind == "file":
                at.parent.mkdir(exist_ok=True)
                df.toPandas().to_parquet(at)
            else:
                df.repartition(parts).write.parquet(str(at))
        t = Tables(spark, str(tmp_path / kind))
        assert _events_stream(t).isStreaming
        assert sorted(r["doc_id"] for r in _ingested(t).collect()) == [0, 2, 4]
