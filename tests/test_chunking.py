import random

from pyspark.sql import functions as F

from lernwerk.operators import chunking as ck


def sentence_model(words, size=350, lookback=50, keep=100):
    out, at = [], 0
    while at < len(words):
        stop = min(at + size, len(words))
        if stop < len(words):
            for i in range(stop - 1, max(stop - lookback, at + keep) - 1, -1):
                if words[i][-1] in ".!?":
                    stop = i + 1
                    break
        out.append((at, stop))
        at = stop
    return out


def test_sentence_chunks_equal_model(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice(["a", "bb", "c.", "d", "e", "f", "gg", "h"]) if rng.random() < 0.3 else "w" for _ in range(n))) for i, n in enumerate([0, 1, 350, 351, 700, 1500, 2300])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for r in ck.sentence_chunks(df).collect():
        got.setdefault(r["doc_id"], []).append((r["word_start"], r["word_end"]))
    for i, text in docs:
        assert sorted(got.get(i, [])) == sentence_model(text.split())


def test_short_document_keeps_original_text(spark):
    df = spark.createDataFrame([(1, "  a \n b ")], "doc_id long, text string")
    assert ck.sentence_chunks(df).first()["chunk_text"] == "  a \n b "


def test_paragraphs_keep_or_drop_a_short_tail(spark):
    p = lambda n: " ".join(["w"] * n)
    df = spark.createDataFrame([(1, p(90)), (2, "\n\n".join([p(500), p(400), p(50)])), (3, "\n\n".join([p(750), p(90)])), (4, "\n\n".join([p(60), p(900)]))], "doc_id long, text string")
    for keep, want in (
        (False, {2: [(0, 500), (1, 450)], 3: [(0, 750)], 4: [(0, 960)]}),
        (True, {1: [(0, 90)], 2: [(0, 500), (1, 450)], 3: [(0, 750), (1, 90)], 4: [(0, 960)]}),
    ):
        got = {}
        for r in ck.pack_paragraphs(df, keep_tail=keep).collect():
            got.setdefault(r["doc_id"], []).append((r["chunk_order"], r["word_count"]))
        assert {k: sorted(v) for k, v in got.items()} == want


def test_split_even(spark):
    df = spark.createDataFrame([(1, i, 7) for i in range(7)] + [(2, i, 3) for i in range(3)], "group_id long, pos long, n long")
    got = {}
    for r in ck.split_even(df).collect():
        got.setdefault((r["group_id"], r["part"]), []).append(r["pos"])
    assert {k: len(v) for k, v in got.items()} == {(1, 0): 2, (1, 1): 2, (1, 2): 3, (2, 0): 3}


def test_markdown_sections_compat_quirk(spark):
    df = spark.createDataFrame([("a.md", "intro\n# One\nbody one\n## Two\nbody two"), ("b.md", "no heading here")], "path string, content string")
    rows = lambda compat: sorted((r["path"], r["heading"], r["content"]) for r in ck.markdown_sections(df, compat).collect())
    assert rows(True) == [("a.md", "Introduction", "body two"), ("a.md", "One", "body one"), ("a.md", "Two", "body two"), ("b.md", "Introduction", "no heading here")]
    assert rows(False) == [("a.md", "Introduction", "intro"), ("a.md", "One", "body one"), ("a.md", "Two", "body two"), ("b.md", "Introduction", "no heading here")]


def test_cards(spark):
    text = "# Terms\n**A**: first\n**B**: second\n# Items\n- x\n- y\n# Code\n```py\nz = 1\n```\n# Idea\n" + "plain words " * 60
    df = spark.createDataFrame([("a.md", text)], "path string, content string")
    cards = ck.basic_cards(ck.folder_cards(df, compat=False)).collect()
    by = {}
    for c in cards:
        by.setdefault(c["content_type"], []).append(c)
    assert [c["question"] for c in by["definition"]] == ["What is A?", "What is B?"]
    assert by["list"][0]["answer"] == "• x\n• y" and by["code"][0]["answer"] == "```\nz = 1\n```"
    assert by["concept"][0]["answer"].endswith("...") and len(by["concept"][0]["answer"]) == 503
    assert by["definition"][0]["tags"] == ["terms"] and by["definition"][0]["difficulty"] == "medium"
    counts = {r["content_type"]: r["n_cards"] for r in ck.cards_by_type(ck.folder_cards(df, compat=False)).collect()}
    assert counts == {"definition": 2, "list": 1, "code": 1, "concept": 1}


def test_fixed_chunks_keep_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e", "x")], "doc_id long, text string, tag string")
    got = [(r["tag"], r["chunk_text"], r["word_start"], r["word_end"]) for r in ck.fixed_chunks(df, 2).orderBy("chunk_order").collect()]
    assert got == [("x", "a b", 1, 2), ("x", "c d", 3, 4), ("x", "e", 5, 5)]


def test_split_large_only_when_large(spark):
    chunk = lambda i, n: (i, f"t{i}", n)
    rows = [(1, 0, 300, [chunk(0, 150), chunk(1, 150)]), (1, 1, 1600, [chunk(i, 400) for i in range(4)])]
    df = spark.createDataFrame(rows, "doc_id long, community_id long, word_count long, chunks array<struct<chunk_order:long,chunk_text:string,n_words:long>>")
    got = sorted((r["community_id"], r["part"], r["word_count"]) for r in ck.split_large(df).collect())
    assert got == [(0, 0, 300), (1, 0, 800), (1, 1, 800)]
    assert ck.split_large(df).where(F.col("part") == 1).first()["combined_text"] == "t2\n\nt3"
