import os

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])

PROSE = "the quick brown fox jumps over the lazy dog while nine wise owls watch from an old oak tree near the river bank".split()


def prose(seed: int, n: int) -> str:
    """Words that hardly repeat in the same order."""
    out, x = [], seed * 7919 + 13
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(PROSE[x // 65536 % len(PROSE)] + "abcdefghijklmnop"[x // 7 % 16])
    return " ".join(out)


@pytest.fixture(scope="session")
def table(spark):
    """A documents table from (doc_id, text[, source]) tuples, or from none."""

    def make(*rows):
        return spark.createDataFrame([(i, t, "en", *(s or ["src"]), None if t is None else len(t)) for i, t, *s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(table):
    """Nulls, empty, blank and very long texts, repeated rows, and columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = table(
        (1, None), (2, ""), (3, " \t\n\n \x0b"), (4, "one two"), (5, "x" * 300_000), (6, "word " * 60_000), (7, "a\nb\na\n\nb"),
        (None, "null id text"), (9, "same row twice"), (9, "same row twice"), (10, "héllo wörld 🙂 \x00 ﬁ"), (11, None, None), (12, "12 34 +49 (30) 1234567 \n<b>&amp;"),
    )
    clash = ("row_key", "fp", "h", "key", "batch", "kept", "uid", "found", "row", "mix_source", "gone_keys", "n", "score", "bands", "lines")
    return df.withColumns({c: F.lit(c) for c in clash})


def rows(df, *columns):
    order = lambda r: tuple((x is not None, x) for x in r)
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=order)


SF = "/root/testdata/sf0.001"
