"""Line dedup over levelled sorted runs of line hashes (operator 9).

Documents arrive in batches.  A batch becomes (key hash, number of its documents that hold the key), sorted by hash
within ranges.  It merge-anti-joins the runs: a key that a run already counts often enough needs no further
counting.  What remains is added as a run of level 0; when a level holds ``FANOUT`` runs they are merged into one run
of the next level, so a key is rewritten a logarithmic number of times.  At the end a key's counts in all runs are
summed.  Keys are 64-bit hashes, which a corpus of 10**9 different lines leaves with a collision chance of 3 %.

Defined results: a null or empty text is one empty line, which is never dropped; a row counts as one document, however
often it holds a line, so repeated rows count each; extra columns are ignored (a stage keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import BROADCAST_ROWS, Shared, documents, releasing, row_key, slices, spaces, span_hashes

MIN_DOCS = 10
MIN_CHARS = 1
BATCHES = 3
FANOUT = 2


def line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line and of its stripped key, and where each text's lines begin (one more at the end)."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    texts = len(offsets) - 1
    count = np.bincount(owner, minlength=texts) + 1 if len(breaks) else np.ones(texts, np.int64)
    at = np.concatenate([[0], np.cumsum(count)])
    start, end = np.empty(at[-1], np.int64), np.empty(at[-1], np.int64)
    head = np.zeros(at[-1], bool)
    head[at[:-1]] = True
    tail = np.zeros(at[-1], bool)
    tail[at[1:] - 1] = True
    start[head], start[~head] = offsets[:-1], breaks + 1
    end[tail], end[~tail] = offsets[1:], breaks
    # the first byte from each place on, and the last up to it, that is no white space
    full = np.flatnonzero(~spaces(data)) if n else np.zeros(0, np.int64)
    after = np.append(full, n)[np.searchsorted(full, start)]
    before = np.concatenate([[-1], full])[np.searchsorted(full, end)] + 1
    key_start = np.minimum(after, end)
    key_end = np.maximum(before, key_start)
    return start, end, key_start, key_end, at


def line_keys(data: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, ...]:
    """(line start, line end, key hash, whether the key is long enough, first line of each text)."""
    start, end, key_start, key_end, at = line_spans(data, offsets)
    if min_chars <= 1:
        long_enough = key_end - key_start >= min_chars
    else:
        chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        long_enough = chars[key_end] - chars[key_start] >= min_chars
    return start, end, span_hashes(data, key_start, key_end, lower=True).view(np.int64), long_enough, at


def document_keys(docs: DataFrame, batches: int, min_chars: int) -> DataFrame:
    """(batch, key) with each document's distinct keys once."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            which, done = batch.column("batch").to_numpy(), 0
            for first, last, data, offsets in slices(batch.column("text")):
                _, _, key, ok, at = line_keys(data, offsets, min_chars)
                owner = np.repeat(np.arange(last - first), np.diff(at))[ok]
                key = key[ok]
                order = np.lexsort((key, owner))
                owner, key = owner[order], key[order]
                new = np.ones(len(key), bool)
                new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(which[done + owner[new]]), pa.array(key[new])], names=["batch", "key"])
                done += last - first

    batch = F.pmod(F.xxhash64("doc_id", F.lit("batch")), F.lit(batches)).cast("int")
    return docs.select(batch.alias("batch"), "text").mapInArrow(releasing(run), "batch int, key long")


class LineRuns:
    """Levelled runs of (key, n), each sorted by key within ranges of keys."""

    def __init__(self, shared: Shared, enough: int, fanout: int = FANOUT):
        self.shared, self.enough, self.fanout = shared, enough, fanout
        self.levels: list[list[DataFrame]] = []

    def _run(self, counts: DataFrame) -> DataFrame:
        n = int(self.shared.spark.conf.get("spark.sql.shuffle.partitions"))
        return self.shared.put(counts.repartitionByRange(n, "key").sortWithinPartitions("key"))

    def add(self, keys: DataFrame) -> None:
        """One batch of (key) rows, a row for each document that holds the key."""
        counts = keys.groupBy("key").agg(F.count("*").alias("n"))
        for level in self.levels:
            for run in level:
                known = run.where(F.col("n") >= self.enough).select("key")
                counts = counts.join(known, "key", "left_anti")
        run = self._run(counts)
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            run = self._run(_summed(old))
            self.shared.drop(*old)

    def frequent(self) -> DataFrame:
        """(key) of the keys that enough documents hold."""
        runs = [run for level in self.levels for run in level]
        return _summed(runs).where(F.col("n") >= self.enough).select("key")


def _summed(runs: list[DataFrame]) -> DataFrame:
    both = runs[0]
    for run in runs[1:]:
        both = both.union(run)
    return both.groupBy("key").agg(F.sum("n").alias("n"))


def frequent_keys(docs: DataFrame, shared: Shared, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    distinct = shared.put(document_keys(docs.select("doc_id", "text"), batches, min_chars), by=["batch"])
    runs = LineRuns(shared, min_docs)
    for i in range(batches):
        runs.add(distinct.where(F.col("batch") == i).select("key"))
    out = shared.put(runs.frequent())
    shared.drop(distinct, *[run for level in runs.levels for run in level])
    return out


def _cleaner(find, names, min_chars, with_text):
    """Rows with the dropped lines left out; ``find`` tells which hashes are dropped in each text of a slice."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            texts, n_lines, n_dropped, digest = [], [], [], []
            column = batch.column("text")
            for first, last, data, offsets in slices(column):
                start, end, key, ok, at = line_keys(data, offsets, min_chars)
                gone = ok & find(batch, first, last, key, at)
                total = np.concatenate([[0], np.cumsum(gone)])
                raw = data.tobytes()
                for i in range(last - first):
                    a, b = at[i], at[i + 1]
                    n = int(total[b] - total[a])
                    text = raw[offsets[i]:offsets[i + 1]]
                    if n:
                        text = b"\n".join([raw[start[j]:end[j]] for j in range(a, b) if not gone[j]])
                    n_lines.append(b - a)
                    n_dropped.append(n)
                    if with_text:
                        texts.append(text.decode() if n or column[first + i].is_valid else None)
                    else:
                        digest.append(hashlib.sha256(text).hexdigest())
            made = {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_sha256": pa.array(digest, pa.string())} if with_text else {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
            yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in names], names=names)

    return run


def without_lines(docs: DataFrame, frequent: DataFrame, min_chars: int = MIN_CHARS, with_text: bool = True, most: int = BROADCAST_ROWS) -> DataFrame:
    """The rows without the lines whose keys are in ``frequent``.

    With ``with_text`` the columns of ``docs``, text replaced (a null text stays null); else doc_id, n_lines,
    n_dropped and kept_sha256.  Up to ``most`` frequent keys go to every task as one sorted array; with more
    of them the keys of each document meet them in a join, and the document gets the list of its own.
    """
    spark = docs.sparkSession
    columns = docs.columns if with_text else ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    schema = docs.schema if with_text else "doc_id long, n_lines long, n_dropped long, kept_sha256 string"
    source = docs if with_text else docs.select(F.col("doc_id").cast("long"), "text")
    if frequent.count() <= most:
        known = spark.sparkContext.broadcast(np.sort(frequent.toPandas()["key"].to_numpy(np.int64)))

        def find(batch, first, last, key, at):
            keys = known.value
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return keys[place] == key if len(keys) else np.zeros(len(key), bool)
    else:
        own = docs.select(row_key().alias("row_key"), "text").mapInArrow(releasing(_keys_of(min_chars)), "row_key long, key long")
        lists = own.join(frequent, "key").groupBy("row_key").agg(F.collect_set("key").alias("gone_keys"))  # no more than a document's lines
        extra = "gone_keys" + "_" * max(map(len, source.columns))  # no column's name
        rows = source.select(F.struct("*").alias("row"), row_key().alias("row_key")).join(lists, "row_key", "left")
        source = rows.select("row.*", F.col("gone_keys").alias(extra))

        def find(batch, first, last, key, at):
            out = np.zeros(len(key), bool)
            for i in range(last - first):
                gone = batch.column(extra)[first + i].as_py()
                if gone:
                    out[at[i]:at[i + 1]] = np.isin(key[at[i]:at[i + 1]], np.array(gone, np.int64))
            return out

    return source.mapInArrow(releasing(_cleaner(find, columns, min_chars, with_text)), schema)


def _keys_of(min_chars):
    def run(found):
        for batch in found:
            for first, last, data, offsets in slices(batch.column("text")):
                _, _, key, ok, at = line_keys(data, offsets, min_chars)
                rows = batch.column("row_key").to_numpy()[first + np.repeat(np.arange(last - first), np.diff(at))]
                yield pa.RecordBatch.from_arrays([pa.array(rows[ok]), pa.array(key[ok])], names=["row_key", "key"])

    return run


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs, shared = documents(spark, folder), Shared(spark)
    return without_lines(docs, frequent_keys(docs, shared), with_text=False)


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents without their frequent lines."""
    shared = Shared(spark)
    return without_lines(docs, frequent_keys(docs, shared))


QUERIES = {"op9_line_dedup": op9_line_dedup}
#: The contract in SQL: keys stripped of ASCII white space and lower-cased in A-Z, found in at least 10 documents.
SQL = {"op9_line_dedup": """
with d as (select row_number() over () r, doc_id, string_split(coalesce(text, ''), chr(10)) ls from documents),
l as (select r, doc_id, unnest(ls) line, generate_subscripts(ls, 1) i from d),
k as (select r, doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k from l),
f as (select k from k where length(k) >= 1 group by k having count(distinct r) >= 10)
select doc_id, count(*)::bigint n_lines, count(f.k)::bigint n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (f.k is null), '')) kept_sha256
from k left join f using (k) group by r, doc_id
"""}
