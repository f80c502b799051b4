import datetime as dt
import random

from lernwerk.operators import scheduling as sc

T0 = dt.datetime(2024, 1, 1)
REVIEW = "user_id long, block_id long, ts timestamp_ntz, event_id long, rating long, time_s long, qa_correct long, qa_total long"


def reviews(spark, rows):
    return spark.createDataFrame([(u, b, T0 + dt.timedelta(hours=h), i, r, 10, 1, 2) for i, (u, b, h, r) in enumerate(rows)], REVIEW)


def test_lapsed_block_stays_lapsed(spark):
    s = sc.day_state(reviews(spark, [(1, 1, 0, 1), (1, 1, 1, 5), (1, 1, 2, 5)])).first()
    assert s["status"] == "lapsed" and s["lapses"] == 1 and s["review_count"] == 3
    assert abs(s["ease"] - 2.6) < 1e-9 and s["stability"] == 4.0


def test_block_intervals(spark):
    s = {r["block_id"]: r for r in sc.block_state(reviews(spark, [(1, 1, 0, 5), (1, 2, 0, 3), (1, 2, 1, 3), (1, 3, 0, 4), (1, 3, 1, 4), (1, 3, 2, 5)])).collect()}
    assert (s[1]["status"], s[1]["next_due_after"]) == ("learning", 1)
    assert (s[2]["status"], s[2]["next_due_after"]) == ("review", 3)
    assert (s[3]["status"], s[3]["next_due_after"]) == ("review", int(7 * 1.5 * 2.7))


def test_state_carries_over_batch_borders(spark):
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rng = random.Random(8)
    rows = [(rng.randrange(3), rng.randrange(2), h, rng.randint(1, 5)) for h in range(60)]
    whole = sorted(map(str, sc.day_state(reviews(spark, rows)).collect()))
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
        assert sorted(map(str, sc.day_state(reviews(spark, rows)).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_fold_from_stored_state(spark):
    rng = random.Random(9)
    rows = [(rng.randrange(3), rng.randrange(3), h, rng.randint(1, 5)) for h in range(50)]
    r = reviews(spark, rows)
    first = sc.fold_reviews(r.where("event_id < 20"), sc.step_day)
    stepwise = sc.fold_reviews(r.where("event_id >= 20"), sc.step_day, "new", first)
    assert sorted(map(str, stepwise.collect())) == sorted(map(str, sc.fold_reviews(r, sc.step_day).collect()))


def test_review_counter_equals_increments(spark):
    rng = random.Random(10)
    rows = [(rng.randrange(2), rng.randrange(4), h * 5, rng.randint(1, 5)) for h in range(40)]
    r = reviews(spark, rows)
    states = sc.block_state(r)
    due = {(s["user_id"], s["block_id"]): s["next_due_after"] for s in states.collect()}
    count = {}
    for u, b, _, _ in rows:
        count[u, b] = 0
        for (v, c) in count:
            if v == u and c != b:
                count[v, c] += 1
    want = {k: min(due[k], n) for k, n in count.items()}
    assert {(s["user_id"], s["block_id"]): s["studied_count"] for s in sc.review_counter(r, states).collect()} == want


def insert_model(master, states, completed):
    done = lambda b: b in completed or states.get(b, ("", 0, 0))[0] in ("completed", "review", "learning")
    seq = [b for b in master if not done(b)]
    for b in master:
        if done(b) and b in states and states[b][1] is not None:
            seq.insert(min(max(states[b][1] - states[b][2], 0), len(seq)), b)
    return seq


def test_dynamic_sequence_equals_inserts(spark):
    rng, m, s, c, want = random.Random(12), [], [], [], {}
    for u in range(30):
        master = rng.sample(range(100), rng.randint(1, 30))
        states = {b: (rng.choice(["new", "learning", "review", "lapsed", "completed"]), rng.choice([None, 1, 3, 7, 20, 60]), rng.randrange(8)) for b in master if rng.random() < 0.6}
        completed = {b for b in master if rng.random() < 0.2}
        want[u] = insert_model(master, states, completed)
        m += [(u, b, i) for i, b in enumerate(master)]
        s += [(u, b, *v) for b, v in states.items()]
        c += [(u, b) for b in completed]
    got = {}
    seq = sc.dynamic_sequence(
        spark.createDataFrame(m, "user_id long, block_id long, master_pos long"),
        spark.createDataFrame(s, "user_id long, block_id long, status string, next_due_after long, studied_count long"),
        spark.createDataFrame(c, "user_id long, block_id long"))
    for r in seq.orderBy("user_id", "position").collect():
        got.setdefault(r["user_id"], []).append(r["block_id"])
    assert {u: got.get(u, []) for u in want} == want


def test_worked_sequence_example(spark):
    master = spark.createDataFrame([(1, b, b) for b in range(1, 11)], "user_id long, block_id long, master_pos long")
    states = spark.createDataFrame([(1, 1, "learning", 3, 0)], "user_id long, block_id long, status string, next_due_after long, studied_count long")
    none = spark.createDataFrame([], "user_id long, block_id long")
    got = [r["block_id"] for r in sc.dynamic_sequence(master, states, none).orderBy("position").collect()]
    assert got[:5] == [2, 3, 4, 1, 5] and len(got) == 10


def interleave_model(new, review, total):
    out, i, j = [], 0, 0
    while len(out) < total and (i < len(new) or j < len(review)):
        for _ in range(3):
            if i < len(new) and len(out) < total:
                out.append(new[i])
                i += 1
        if j < len(review) and len(out) < total:
            out.append(review[j])
            j += 1
    return out


def test_interleave_equals_loop(spark):
    rng, n, r, want = random.Random(13), [], [], {}
    for u in range(40):
        new, review = list(range(rng.randint(0, 30))), list(range(100, 100 + rng.randint(0, 15)))
        want[u] = interleave_model(new, review, 20)
        n += [(u, b, i) for i, b in enumerate(new)]
        r += [(u, b, i, i) for i, b in enumerate(review)]
    got = {}
    out = sc.interleave(spark.createDataFrame(n, "user_id long, block_id long, master_pos long"),
                        spark.createDataFrame(r, "user_id long, block_id long, blocks_until_due long, master_pos long"), 20)
    for row in out.orderBy("user_id", "position").collect():
        got.setdefault(row["user_id"], []).append(row["block_id"])
    assert {u: got.get(u, []) for u in want} == want


def quota_model(master, done, total, quota):
    picked, review, new = [], 0, 0
    for b in master:
        if len(picked) >= total:
            break
        if b in done and review < quota:
            picked.append(b)
            review += 1
        elif b not in done and new < total - quota:
            picked.append(b)
            new += 1
    return picked + [b for b in master if b not in picked][: total - len(picked)]


def test_quota_plan_equals_walk(spark):
    rng, m, c, want = random.Random(14), [], [], {}
    for u in range(40):
        master = list(range(rng.randint(1, 25)))
        done = {b for b in master if rng.random() < rng.random()}
        want[u] = quota_model(master, done, 8, 2)
        m += [(u, b, b) for b in master]
        c += [(u, b) for b in done]
    got = {}
    plan = sc.quota_plan(spark.createDataFrame(m, "user_id long, block_id long, master_pos long"), spark.createDataFrame(c, "user_id long, block_id long"))
    for r in plan.orderBy("user_id", "place").collect():
        got.setdefault(r["user_id"], []).append(r["block_id"])
    assert got == want


def test_day_schedule_counts_reviews_beyond_the_calendar(spark):
    s = sc.day_state(reviews(spark, [(1, 1, h, 5) for h in range(60)])).first()
    assert s["review_count"] == 60 and s["time_s"] == 600 and s["next_due_at"].year <= 9999
    assert s["stability"] == sc.MAX_DAYS


def test_backfill_dry_run(spark):
    comp = spark.createDataFrame([(1, 1, 5, 10), (1, 2, 2, 20), (1, 9, 4, 5), (2, 1, None, 7)], "user_id long, block_id long, rating long, time_s long")
    states = spark.createDataFrame([(1, 1, "review", 5.0, 100)], "user_id long, block_id long, status string, avg_rating double, time_s long")
    blocks = spark.createDataFrame([(1,), (2,)], "block_id long")
    _, counts = sc.backfill(comp, states, blocks, "2024-02-01 00:00:00", dry_run=True)
    assert {r["kind"]: r["n"] for r in counts.collect()} == {"updated": 1, "created": 2, "skipped": 1}
    new, counts = sc.backfill(comp, states, blocks, "2024-02-01 00:00:00")
    assert {r["kind"]: r["n"] for r in counts.collect()} == {"created": 2, "skipped": 2}
    rows = {(r["user_id"], r["block_id"]): r for r in new.collect()}
    assert rows[1, 2]["status"] == "lapsed" and rows[1, 2]["time_s"] == 40 and abs(rows[2, 1]["avg_rating"] - 3.0) < 1e-9 and rows[1, 1]["time_s"] == 100


def test_free_places_are_those_of_a_list():
    import random

    from lernwerk.operators.scheduling import FreePlaces

    rng = random.Random(4)
    for most in (1, 5, 300, 100_000):
        free, known = FreePlaces(), list(range(most + 500))
        for _ in range(500):
            p = rng.randrange(most)
            assert free.take(p) == known.pop(p)
