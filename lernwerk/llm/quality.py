"""Quality rules with cross-document line frequency (operator 5).

One pass over the texts gives the base figures of each document and its distinct normalised lines (white space
stripped, A-Z lower-cased).  A line of any length is counted per host (``source``) over the distinct documents that
hold it; copies, which have the same lines, are one document, so that a group of copies reaches the near-duplicate
stage, which keeps one.  A line that more documents of a host hold than the limit is template text and is removed; a
document that keeps less than ``MIN_KEPT_PERCENT`` of its words is depleted and rejected.

Defined results: a null or empty text has no words and fails the base rules; a null source is a host of its own;
equal rows get equal results; extra columns are ignored (a stage keeps them); a null text stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import BROADCAST_ROWS, Shared, documents, mix, releasing, slices, small, span_hashes, word_spans
from .lines import line_keys, line_spans

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A template line is in more distinct documents of its host than this number and this share.
LIMIT_TEXTS, LIMIT_SHARE = 20, 0.002
MIN_KEPT_PERCENT = 30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _key() -> Column:
    """Names a row by id, text and host; equal rows share it."""
    return F.xxhash64("doc_id", "text", F.col("source").cast("string"))


def _first_of(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each value is the first of its kind in its text."""
    order = np.lexsort((values, owner))  # stable, so the first place comes first
    v, o = values[order], owner[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    out = np.empty(len(v), bool)
    out[order] = first
    return out


def _repeated(values: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether each value is in its text twice or more."""
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    same = np.zeros(len(v) + 1, bool)
    same[1:-1] = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    out = np.empty(len(v), bool)
    out[order] = same[1:] | same[:-1]
    return out


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, row_key, source, n_words, the four base figures, and the distinct lines with their words, once and in all."""
    item = pa.list_(pa.int64())
    names = ["doc_id", "row_key", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines", "line_words", "line_total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column("text")):
                texts = last - first
                start, end, at = word_spans(data, offsets)
                owner = np.repeat(np.arange(texts), np.diff(at))
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                chars = np.bincount(owner, lead[end] - lead[start], texts)
                marks = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
                symbols = marks[offsets[1:]] - marks[offsets[:-1]]
                # windows of three words of one text
                word = span_hashes(data, start, end, lower=False)
                inside = np.flatnonzero(owner[2:] == owner[:-2]) if len(word) > 2 else np.zeros(0, np.int64)
                windows = mix((word[inside] * np.uint64(0xC2B2AE3D27D4EB4F) + word[inside + 1]) * np.uint64(0xD6E8FEB86659FD93) + word[inside + 2])
                twice = inside[_repeated(windows, owner[inside])]
                hit = np.zeros(len(word), bool)
                for j in range(3):
                    hit[twice + j] = True
                repeat = np.bincount(owner, hit, texts)
                # lines with a word
                ls, le, ks, ke, lat = line_spans(data, offsets)
                lowner = np.repeat(np.arange(texts), np.diff(lat))
                full = ke > ks
                ls, le, ks, ke, lowner = ls[full], le[full], ks[full], ke[full], lowner[full]
                dup = np.bincount(lowner, ~_first_of(span_hashes(data, ls, le, lower=False), lowner), texts)
                key = span_hashes(data, ks, ke, lower=True)
                n_in = np.searchsorted(start, le) - np.searchsorted(start, ls)
                order = np.lexsort((key, lowner))
                k, o, w = key[order], lowner[order], n_in[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
                heads = np.flatnonzero(new)
                total = np.add.reduceat(w, heads) if len(heads) else w
                cut = np.searchsorted(o[heads], np.arange(texts + 1)).astype(np.int32)
                column = lambda c: batch.column(c).slice(first, texts)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([
                    column("doc_id"), column("row_key"), column("source"),
                    *[pa.array(x.astype(np.int64)) for x in (np.diff(at), chars, symbols, dup, repeat)],
                    pa.ListArray.from_arrays(pa.array(cut), pa.array(k[heads].view(np.int64))).cast(item),
                    *[pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int64))).cast(item) for x in (w[heads], total)],
                ], names=names)

    return docs.select(F.col("doc_id").cast("long"), _key().alias("row_key"), F.col("source").cast("string"), "text").mapInArrow(
        releasing(run), "doc_id long, row_key long, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lines array<long>, line_words array<long>, line_total array<long>"
    )


def ruled(
    docs: DataFrame, limit_texts: int = LIMIT_TEXTS, limit_share: float = LIMIT_SHARE, min_kept_percent: int = MIN_KEPT_PERCENT
) -> tuple[DataFrame, DataFrame]:
    """Two tables: the verdict on each row (see ``verdicts``), and the template lines (source, line) by their hashes.

    A template line is in more than ``limit_texts`` distinct documents of its host and in more than the share
    ``limit_share`` of them, so a host has at most 1 / ``limit_share`` times the lines of a mean document of them."""
    shared = Shared(docs.sparkSession)
    doc = shared.put(measures(docs))
    lines = doc.select("row_key", "source", F.xxhash64("lines").alias("same"), F.explode(F.arrays_zip("lines", "line_words", "line_total")).alias("l")).select(
        "row_key", "source", "same", F.col("l.lines").alias("line"), F.col("l.line_total").alias("words")
    )
    texts = doc.select("source", F.xxhash64("lines").alias("same")).distinct().groupBy("source").agg(F.count("*").alias("texts"))
    held = lines.select("source", "line", "same").distinct().groupBy("source", "line").agg(F.count("*").alias("n"))
    limit = F.greatest(F.lit(limit_texts), F.col("texts") * limit_share)
    template = held.where(F.col("n") > limit_texts).join(texts, held["source"].eqNullSafe(texts["source"])).where(F.col("n") > limit).select(held["source"], "line")
    template = shared.put(template)
    t = small(template.withColumnRenamed("source", "host"))
    hit = lines.join(t, (lines["line"] == t["line"]) & lines["source"].eqNullSafe(t["host"]))
    # equal rows have one sum: each counts its own lines
    lost = hit.select("row_key", lines["line"], "words").distinct().groupBy("row_key").agg(F.sum("words").alias("template_words"))
    lost = shared.put(lost)
    out = doc.drop("lines", "line_words", "line_total", "source").join(small(lost), "row_key", "left").withColumn("template_words", F.coalesce("template_words", F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = 100 * (F.col("n_words") - F.col("template_words")) < min_kept_percent * F.col("n_words")
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted), template


def verdicts(docs: DataFrame, **limits) -> DataFrame:
    """doc_id, row_key, the base figures, template_words, base_failed and kept for each row."""
    return ruled(docs, **limits)[0]


def without_templates(docs: DataFrame, template: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with the lines of ``template`` (source, line) removed from the texts of their host.

    Up to ``most`` template lines go to every task as one sorted array; with more of them the lines of each document
    meet them in a join, and the document gets the list of its own."""
    names, schema, spark = docs.columns, docs.schema, docs.sparkSession
    host, own = (x + "_" * max(map(len, names)) for x in ("host", "own"))  # no column's name
    of_host = lambda c: F.xxhash64(F.col(c).cast("string"))
    known = None
    source = docs.withColumn(host, of_host("source"))
    if template.count() <= most:
        rows = template.select(of_host("source").alias("host"), "line").toPandas()
        known = spark.sparkContext.broadcast(np.sort(_in_host(rows["line"].to_numpy(np.int64).view(np.uint64), rows["host"].to_numpy(np.int64).view(np.uint64))))
    else:
        held = docs.select(_key().alias("row_key"), F.col("source").cast("string"), "text").mapInArrow(releasing(_lines_of), "row_key long, source string, line long")
        t = template.select(F.col("source").alias("host"), F.col("line").alias("key"))
        met = held.join(t, (held["line"] == t["key"]) & held["source"].eqNullSafe(t["host"]))
        lists = met.groupBy("row_key").agg(F.collect_set("line").alias(own))  # no more than a document's lines
        source = source.select(F.struct("*").alias("row"), _key().alias("row_key")).join(lists, "row_key", "left").select("row.*", own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, column = [], batch.column("text")
            hosts = batch.column(host).to_numpy().view(np.uint64)
            for first, last, data, offsets in slices(column):
                start, end, key, ok, at = line_keys(data, offsets, 1)
                if known is not None:
                    keys = known.value
                    key = _in_host(key.view(np.uint64), np.repeat(hosts[first:last], np.diff(at)))
                    gone = ok & (keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key) if len(keys) else np.zeros(len(key), bool)
                else:
                    gone = np.zeros(len(key), bool)
                    for i in range(last - first):
                        if mine := batch.column(own)[first + i].as_py():
                            gone[at[i]:at[i + 1]] = ok[at[i]:at[i + 1]] & np.isin(key[at[i]:at[i + 1]].view(np.int64), np.array(mine, np.int64))
                raw, total = data.tobytes(), np.concatenate([[0], np.cumsum(gone)])
                for i in range(last - first):
                    a, b = at[i], at[i + 1]
                    text = raw[offsets[i]:offsets[i + 1]]
                    if total[b] > total[a]:
                        text = b"\n".join([raw[start[j]:end[j]] for j in range(a, b) if not gone[j]])
                    texts.append(text.decode() if column[first + i].is_valid else None)
            made = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([made if c == "text" else batch.column(c) for c in names], names=names)

    return source.mapInArrow(releasing(run), schema)


def _in_host(line: np.ndarray, host: np.ndarray) -> np.ndarray:
    """One number for a line of a host."""
    return mix(line * np.uint64(0xC2B2AE3D27D4EB4F) + host)


def _lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in slices(batch.column("text")):
            _, _, key, ok, at = line_keys(data, offsets, 1)
            row = (first + np.repeat(np.arange(last - first), np.diff(at)))[ok]
            yield pa.RecordBatch.from_arrays([batch.column("row_key").take(row), batch.column("source").take(row), pa.array(key[ok].view(np.int64))], names=["row_key", "source", "line"])


def clean_documents(docs: DataFrame, **limits) -> DataFrame:
    """The rows that the rules keep, their texts without template lines; all columns of ``docs``."""
    shared = Shared(docs.sparkSession)
    rows, template = ruled(docs, **limits)
    gone = shared.put(rows.where("not kept").select("row_key").distinct())
    kept = docs.select(F.struct("*").alias("row"), _key().alias("row_key")).join(small(gone), "row_key", "left_anti").select("row.*")
    return without_templates(kept, template)


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return verdicts(documents(spark, folder)).drop("row_key")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The documents that the rules keep, without template lines."""
    return clean_documents(docs)


QUERIES = {"op5_quality_rules": op5_quality_rules}
#: The rules in SQL; a text is told from its copies by its sorted distinct lines.
SQL = {"op5_quality_rules": rf"""
with d as (select row_number() over () r, doc_id, source, coalesce(text, '') t from documents),
w as (select r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') ws from d),
tri as (select r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from (select r, ws, unnest(range(1, len(ws) - 1)) i from w) x),
twice as (select r, i from tri qualify count(*) over (partition by r, g) > 1),
rep as (select r, count(distinct i + j) n from twice, (values (0), (1), (2)) o(j) group by r),
l as (select r, source, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) n,
  translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') k
  from (select r, source, unnest(string_split(t, chr(10))) line from d) x where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct line) n from l group by r),
same as (select d.r, d.source, coalesce(string_agg(distinct k, chr(10) order by k), '') same from d left join l using (r) group by 1, 2),
texts as (select source, count(distinct same) texts from same group by source),
held as (select l.source, k, count(distinct same) n from l join same using (r) group by 1, 2),
tpl as (select h.source, k from held h join texts t on h.source is not distinct from t.source where n > greatest({LIMIT_TEXTS}, texts * {LIMIT_SHARE})),
lost as (select r, sum(n) n from l join tpl on l.k = tpl.k and l.source is not distinct from tpl.source group by r),
a as (select doc_id, len(ws) n_words, list_sum(list_transform(ws, lambda x: length(x)))::bigint word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) n_symbols, coalesce(dup.n, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words, coalesce(lost.n, 0)::bigint template_words
  from d join w using (r) left join rep using (r) left join dup using (r) left join lost using (r))
select doc_id, n_words, coalesce(word_chars, 0) word_chars, n_symbols, n_dup_lines, n_repeat_words, template_words,
  n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) and 100 * (n_words - template_words) >= {MIN_KEPT_PERCENT} * n_words kept
from a
"""}
