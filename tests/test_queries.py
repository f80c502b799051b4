"""Registered queries against their check SQL on the smallest tables.

A spread of queries by default; all of them with LERNWERK_ALL_QUERIES=1 (or use tools/check.py)."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from lernwerk import derived
from lernwerk.derived import BASE_TABLES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check import canonical  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SPREAD = ("document_chunk_totals", "body_fields", "chunk_sentence_350", "merged_units", "tf_cosine_pairs", "dedup_decisions", "path_metrics", "dynamic_sequence", "learner_dashboard", "study_pack", "attempt_rows")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for table in BASE_TABLES:
        c.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return c


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if n in SPREAD or os.environ.get("LERNWERK_ALL_QUERIES")])
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_edges_read_once_are_not_written(spark, monkeypatch):
    """The edges grow with the square of the vectors; a query that only counts them writes no table of them."""
    written = []
    monkeypatch.setattr(derived, "cut", lambda df: written.append(df.columns) or df)
    row = entry.queries()["corpus_progress"](spark, FOLDER).first()
    assert row["n_edges"] == row["n_prerequisite"] + row["n_builds_on"] + row["n_related"] > 0
    assert not written


def test_the_summary_writes_the_edges_once(spark, monkeypatch):
    """One table of the directed pairs, which components read too, and one of the undirected ones for the triangles."""
    from lernwerk.operators import communities, graph

    written = []
    for module in (derived, communities, graph):
        monkeypatch.setattr(module, "cut", lambda df, cut=module.cut: written.append(df.columns) or cut(df))
    assert entry.queries()["graph_summary"](spark, FOLDER).first()["n_edges"] > 0
    assert [c for c in written if {"src", "dst"} <= set(c) or {"a", "b"} <= set(c)] == [["src", "dst"], ["a", "b"]]
