"""Near duplicates, best matches and decisions read whole texts, not their heads."""

import random
from difflib import SequenceMatcher

import pytest

import __spark_entry__ as entry
from lernwerk.functions import text as tx
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    letters = "etaoinshrdlu" * 20 + "qzxj0123456789"  # the matcher starts from characters under 1 %
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 8))) for _ in range(3000)]

    def body(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    head, other, tail = body(200), body(200), body(1500)
    texts = [f"{head} {body(1500)}", f"{head} {body(1500)}", f"{head} {tail}", f"{other} {tail}", f"{head} {tail}", body(400), ". ".join(body(3) for _ in range(400))]
    texts.append(texts[-1][:2000] + body(900))
    path = tmp_path_factory.mktemp("whole")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_whole_texts_are_compared(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", tx.fingerprint(tx.clean_text(F.col("text"))).alias("f"))
    text = {r.doc_id: r.f.lower() for r in docs.collect()}
    assert min(map(len, text.values())) > 1000
    ratio = {(a, b): round(SequenceMatcher(None, text[b], text[a]).ratio(), 6) for a in text for b in text if a < b}
    # an exact copy is linked to its original only
    want = {k: v for k, v in ratio.items() if v >= 0.8 and not (4 in k and k != (2, 4))}
    assert (0, 1) not in want and (2, 3) in want
    got = {(r.a, r.b): r.ratio for r in entry.queries()["near_duplicates"](spark, folder).collect()}
    assert got == want
    best = {r.doc_id: (r.match_id, r.ratio) for r in entry.queries()["best_matches"](spark, folder).collect()}
    assert best == {3: (2, want[2, 3]), 4: (2, 1.0)}
    decided = {r.doc_id: (r.decision, r.duplicate_of) for r in entry.queries()["dedup_decisions_whole"](spark, folder).collect()}
    assert decided == {i: ("near", 2) if i == 3 else ("exact", 2) if i == 4 else ("unique", None) for i in text}
