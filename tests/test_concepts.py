import random

from lernwerk.operators import concepts as cp

LABELS = ["Definition", "Example", "NewTopic", "Proof", "Statement", "Summary"]


def grouping_model(rows):
    out, group = [], 0
    for i, (label, words) in enumerate(rows):
        if i:
            previous = set(rows[i - 1][1])
            shift = previous and words and len(previous & set(words)) / len(previous | set(words)) < 0.2
            opens = label in cp.OPENING_LABELS or size >= 5 or shift or size + 1 > 3
        if not i or opens:
            group, size = group + 1, 0
        size += 1
        out.append(group)
    return out


def test_concept_groups_equal_model(spark):
    rng, rows, want = random.Random(5), [], {}
    for doc in range(40):
        seq = [(rng.choice(LABELS), rng.sample(["a", "b", "c"], rng.randint(0, 3))) for _ in range(rng.randint(1, 25))]
        want[doc] = grouping_model(seq)
        rows += [(doc, i, label, words, 10) for i, (label, words) in enumerate(seq)]
    df = spark.createDataFrame(rows, "doc_id long, chunk_order long, primary_label string, keywords array<string>, word_count long")
    got = {}
    for r in cp.concept_groups(df).orderBy("doc_id", "chunk_order").collect():
        got.setdefault(r["doc_id"], []).append(r["concept_order"])
    assert got == want


def binning_model(times, cap=10.0):
    out, i = [], 0
    while i < len(times):
        group = [i]
        if times[i] <= cap and i + 1 < len(times) and times[i] + times[i + 1] < cap:
            group, total, j = [i, i + 1], times[i] + times[i + 1], i + 2
            while j < len(times) and total < cap and total + times[j] <= cap:
                group.append(j)
                total += times[j]
                j += 1
        out.append(group)
        i = group[-1] + 1
    return out


def test_bins_equal_model(spark):
    rng, rows, want = random.Random(7), [], {}
    for doc in range(60):
        times = [rng.choice([0.5, 1.0, 2.0, 4.0, 5.0, 6.0, 9.0, 10.0, 11.0, 14.0]) for _ in range(rng.randint(1, 20))]
        want[doc] = binning_model(times)
        rows += [(doc, i, t) for i, t in enumerate(times)]
    got = {}
    for r in cp.bin_by_time(spark.createDataFrame(rows, "doc_id long, concept_order long, reading_min double")).collect():
        got.setdefault(r["doc_id"], {}).setdefault(r["bin_order"], []).append(r["concept_order"])
    assert {d: [sorted(g) for _, g in sorted(b.items())] for d, b in got.items()} == want


def split_model(labels, minutes, cap=10.0):
    n = len(labels)
    if minutes <= cap or n <= 1:
        return [(n, minutes)]
    mid = n // 2
    offsets = [0, 0, 0] + [d * o for o in range(1, min(2, n // 4) + 1) for d in (0, 1, -1)]
    good = [mid + o for o in offsets if 0 < mid + o < n and (labels[mid + o - 1], labels[mid + o]) not in cp.BAD_SPLITS]
    at = good[0] if good else max(1, min(mid, n - 1))
    return split_model(labels[:at], minutes * (at / n)) + split_model(labels[at:], minutes * ((n - at) / n))


def test_split_equals_recursion(spark):
    rng, rows, want = random.Random(11), [], {}
    for i in range(50):
        n = rng.randint(1, 40)
        labels = [rng.choice(LABELS) for _ in range(n)]
        minutes = rng.choice([5.0, 11.0, 30.0, 200.0])
        rows.append((1, i, minutes, list(range(n)), labels))
        want[i] = [(k, round(t, 9)) for k, t in split_model(labels, minutes)]
    df = spark.createDataFrame(rows, "doc_id long, concept_order long, reading_min double, chunk_orders array<long>, chunk_labels array<string>")
    got = {}
    for r in cp.split_long(df).orderBy("concept_order", "part").collect():
        got.setdefault(r["concept_order"], []).append((len(r["chunk_orders"]), round(r["reading_min"], 9)))
    assert got == want


def test_top_keywords_first_seen(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(["b", "a", "c", "a", "b", "d"],)], "k array<string>")
    assert df.select(cp.top_keywords(F.col("k"), 3).alias("x")).first()["x"] == ["b", "a", "c"]


def test_related_prior_prefers_recent(spark):
    rows = [(1, 1, ["x"], ["k"]), (1, 2, ["x"], ["k"]), (1, 3, ["x"], ["k"]), (2, 1, ["p"], []), (2, 2, ["q"], [])]
    df = spark.createDataFrame(rows, "doc_id long, concept_order long, labels array<string>, keywords array<string>")
    got = {(r["doc_id"], r["concept_order"]): r["prior_order"] for r in cp.related_prior(df).collect()}
    assert got == {(1, 1): None, (1, 2): 1, (1, 3): 2, (2, 1): None, (2, 2): None}


def test_parts_of_a_split_unit_stay_apart(spark):
    from lernwerk.plans.flows import concept_flow

    rows = [(1, i, "NewTopic" if i in (0, 3) else "Discussion", ["k"], 0.5, 300) for i in range(5)]
    labels = spark.createDataFrame(rows, "doc_id long, chunk_order long, primary_label string, keywords array<string>, confidence double, word_count long")
    times = spark.createDataFrame([(1, 1, 15.6, 0.5, "medium"), (1, 2, 1.77, 0.5, "low")], "doc_id long, concept_order long, reading_min double, complexity double, load string")
    got = concept_flow(labels, times).optimized.orderBy("bin_order").collect()
    assert [list(r["chunk_orders"]) for r in got] == [[0], [1], [2], [3, 4]]
    assert [r["bin_order"] for r in got] == [1, 2, 3, 4]
