"""Documents with an empty, blank or missing text against the check SQL: they have no chunks, but a hash unless missing."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from lernwerk.derived import BASE_TABLES
from test_queries import FOLDER, canonical

CHUNKED = (
    "cascade_kept_chunks", "concept_groups", "concept_units", "default_bodies", "document_catalogue", "inconsistent_documents",
    "label_distribution", "large_communities_split", "length_flags", "long_units_split", "merged_units",
)
HASHED = ("doc_hash_dups", "load_metrics", "owned_hash_dups", "dedup_stats", "duplicate_groups", "cascade_counts")


def made(out, missing: bool) -> str:
    for table in BASE_TABLES:
        if table != "documents":
            os.symlink(f"{FOLDER}/{table}.parquet", out / f"{table}.parquet")
    gone = "null" if missing else "'two'"
    odd = [(1001, "''"), (1002, "''"), (1004, gone), (1005, gone), (1006, "' '"), (1007, "chr(10) || chr(10)"), (1008, "'one'")]
    rows = ", ".join(f"({i}, {text}, 'en', 'web', 0)" for i, text in odd)
    duckdb.connect().execute(f"""copy (select * from '{FOLDER}/documents.parquet' union all
      select i::bigint, t::varchar, l, s, n::bigint from (values {rows}) v(i, t, l, s, n)) to '{out}/documents.parquet' (format parquet)""")
    return str(out)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return made(tmp_path_factory.mktemp("odd"), True)


@pytest.fixture(scope="module")
def given(tmp_path_factory):
    return made(tmp_path_factory.mktemp("given"), False)


def same(spark, folder, name):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = entry.queries()[name](spark, folder)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert canonical(df.collect(), df.columns) == canonical(cur.fetchall(), names)


@pytest.mark.parametrize("name", CHUNKED)
def test_chunks(spark, folder, name):
    same(spark, folder, name)


@pytest.mark.parametrize("name", HASHED)
def test_hashes(spark, folder, name):
    same(spark, folder, name)


def test_identity(spark, given):
    """Its SQL has no row for a missing text, which cleaning takes as an empty one; so all texts are given here."""
    same(spark, given, "content_identity")
