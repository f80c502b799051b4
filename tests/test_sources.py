

from lernwerk.sources import documents as ds, files as fl


def test_scan_markdown(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# Ä", encoding="utf-8")
    (tmp_path / "sub" / "b.MARKDOWN").write_text("b")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\x00bad")
    (tmp_path / "c.txt").write_text("c")
    got = {r["path"]: r["content"] for r in fl.scan_markdown(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# Ä", "sub/b.MARKDOWN": "b"}


def test_folder_status(spark):
    files = spark.createDataFrame([("x/a.md",), ("x/b.MD",), ("y/c.txt",)], "path string")
    folders = spark.createDataFrame([("x",), ("y",)], "folder string")
    got = {r["folder"]: (r["total_files"], r["valid"]) for r in fl.folder_status(files, folders).collect()}
    assert got == {"x": (2, True), "y": (0, False)}


def test_admission(spark):
    files = spark.createDataFrame([("/u/a.PDF", 10), ("/u/b.pdf", 52428801), ("/u/c.txt", 1), ("/u/d.pdf", 52428800)], "path string, length long")
    got = {r["path"]: (r["name"], r["accepted"], r["reason"]) for r in fl.admit_uploads(files).collect()}
    assert got == {"/u/a.PDF": ("a", True, None), "/u/b.pdf": ("b", False, "too large"), "/u/c.txt": ("c.txt", False, "not a pdf"), "/u/d.pdf": ("d", True, None)}


def test_pages_fall_back(spark):
    long = "x" * 60
    rows = [(1, 0, "a", long), (1, 1, "a", ""), (1, 2, "a", long), (1, 0, "b", "no"), (2, 0, "a", "short"), (2, 0, "b", long), (3, 0, "a", "s"), (4, 100, "a", long)]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, extractor string, page_text string")
    got = {r["doc_id"]: (r["text"], r["page_count"], r["method"]) for r in ds.assemble_pages(df, max_pages=100).collect()}
    assert got == {1: (f"{long}\n\n{long}", 3, "a"), 2: (long, 1, "b")}


def test_replace_by_key_is_idempotent(spark, tmp_path):
    path = f"{tmp_path}/t"
    a = spark.createDataFrame([(1, "old"), (1, "old2"), (2, "keep")], "doc_id long, v string")
    b = spark.createDataFrame([(1, "new"), (3, "add")], "doc_id long, v string")
    ds.replace_by_key(a, path, buckets=2)
    for _ in range(2):
        ds.replace_by_key(b, path, buckets=2)
        assert sorted((r["doc_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "new"), (2, "keep"), (3, "add")]


def test_cascade(spark):
    child = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc_id long, n long")
    kept, counts = ds.cascade_delete({"chunks": child}, spark.createDataFrame([(1,), (1,), (7,)], "doc_id long"))
    assert [tuple(r) for r in kept["chunks"].collect()] == [(2, 1)]
    assert [tuple(r) for r in counts.collect()] == [("chunks", 2)]


def test_single_block_pack_includes_migrated(spark):
    rows = [(1, 1, 0, "[MIGRATED→ab] t", '{"segments":[]}', [], 60, "beginner"), (2, 1, 1, "u", '{"segments":[{"title":"s"}]}', ["o"], 60, "beginner"), (3, 1, 2, "v", "{}", [], 60, "beginner")]
    blocks = spark.createDataFrame(rows, "block_id long, doc_id long, block_order long, title string, body string, objectives array<string>, duration_s long, difficulty string")
    docs = spark.createDataFrame([(1, "d")], "doc_id long, name string")
    assert [r["block_id"] for r in ds.study_pack(blocks, docs).collect()] == [2]
    one = ds.study_pack(blocks, docs, block_ids=spark.createDataFrame([(1,)], "block_id long")).first()
    assert one["pack_title"] == "d_study_pack" and one["block_count"] == 1


def test_pages_beyond_a_hundred_are_kept(spark):
    rows = [(1, i, "a", f"page {i:03d}") for i in range(130)]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, extractor string, page_text string")
    whole = ds.assemble_pages(df).first()
    assert whole["text"].split("\n\n") == [r[3] for r in rows] and whole["page_count"] == 130
    assert len(ds.assemble_pages(df, max_pages=100).first()["text"].split("\n\n")) == 100


def test_a_callers_views_stay(spark):
    from lernwerk.derived import Tables

    spark.range(3).createOrReplaceTempView("blocks")
    t = Tables(spark, "/root/testdata/sf0.001")
    assert t.block_bodies.count() == t.blocks.count() > 3
    assert spark.table("blocks").columns == ["id"] and not spark.catalog.tableExists("lw_part")


def test_master_sequence_over_many_ranges(spark, monkeypatch):
    """More blocks than one task may number."""
    from lernwerk.operators import ranking

    monkeypatch.setattr(ranking, "SMALL", 10)
    blocks = spark.range(40).selectExpr("id as block_id", "concat('t', id) as title", "'beginner' as difficulty", "39 - id as pos")
    got = ds.master_sequence(blocks.drop("pos"), blocks.select("block_id", "pos"), blocks.where("block_id = 3").select("block_id")).collect()
    assert sorted((r["sequence_number"], r["block_id"], r["is_completed"]) for r in got) == [(40 - b, b, b == 3) for b in range(39, -1, -1)]


def test_a_rank_beside_columns_of_any_name(spark, monkeypatch):
    from pyspark.sql import functions as F
    from lernwerk.operators import ranking

    monkeypatch.setattr(ranking, "SMALL", 10)
    df = spark.range(40).selectExpr("id as _at", "id % 3 as _part", "id as _off", "id as part", "id as _place0")
    got = ranking.global_rank(df, [F.col("_at")], "_i").collect()
    assert all(r["_i"] == r["_at"] == r["_off"] == r["part"] == r["_place0"] and r["_part"] == r["_at"] % 3 for r in got) and len(got) == 40
