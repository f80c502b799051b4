"""MinHash near-duplicates with SuperMinHash signatures (operator 2).

One pass over the texts gives each document the number of its distinct word shingles, a fingerprint of the set, and
the bands of a SuperMinHash signature.  Documents with equal sets become one node.  Nodes that share a band hash are
candidates; a bucket proposes links to a pivot instead of all pairs, every link is confirmed on the full sets, and
union-find groups what is linked.  Buckets that still hold several groups get further pivots; what is open then is
compared pair by pair across groups, as far as the sizes of the sets and of their shared parts allow a link, so that
no candidate link between groups is lost.

Defined results: a null or empty text, or one of white space, has an empty set and links with nothing; equal rows
are all returned; a null doc_id takes part but is never the smallest id (alone it has component_id null and is not
kept); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import Shared, components, documents, mix, releasing, row_key, shingles, slices, small, span_hashes, without_rows, word_spans

SHINGLE = 5  # words
PERCENT = 75  # least similarity
#: A pair at the least similarity misses all bands with probability (1 - 0.75**4)**32, about 5 in a million.
BANDS, ROWS = 32, 4
#: Sizes of sets are compared by classes, each so many times the one before.
CLASS = 1.15
#: The items of a set are counted by so many classes of their hashes.
PARTS = 32
#: Further pivots of an open bucket before all its pairs across groups.
PIVOT_ROUNDS = 1
#: Bytes of texts that a task works on at a time, and sets that meet one copy of their pivot's set.
SLICE = 1 << 20
PER_PIVOT = 200


def super_minhash(items: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signature of distinct 64-bit hashes.

    Level j gives every element a value in [j, j + 1) at the j-th place of its own random permutation of the m
    slots; a slot keeps its smallest value.  Once every slot holds less than j, later levels cannot change any.
    """
    values = np.full(m, np.inf)
    n = len(items)
    if not n:
        return values
    rows, places = np.arange(n), None
    seed = items
    for j in range(m):
        seed = mix(seed + np.uint64(0x9E3779B97F4A7C15))
        r = (seed >> np.uint64(11)).astype(np.float64) * 2.0**-53
        k = j + (mix(seed) % np.uint64(m - j)).astype(np.int64)
        if j == 0:
            slot = k
        else:
            if places is None:
                places = np.tile(np.arange(m, dtype=np.int32), (n, 1))
                places[rows, first] = 0
                places[:, 0] = first
            slot = places[rows, k]
            places[rows, k] = places[:, j]
            places[:, j] = slot
        if j == 0:
            first = k
        np.minimum.at(values, slot, r + j)
        if values.max() < j + 1:
            break
    return values


def band_hashes(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    bits = values[:bands * rows].view(np.uint64).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + bits[:, i])
    return out.view(np.int64)


def _fingerprint(items: np.ndarray) -> bytes:
    return hashlib.blake2b(items.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, row_key, n_shingles, fp, bands) for each row; fp and bands are null for an empty set."""

    def run(batches):
        for batch in batches:
            ids, keys = batch.column("doc_id"), batch.column("row_key")
            for first, last, data, offsets in slices(batch.column("text"), SLICE):
                start, end, at = word_spans(data, offsets)
                words = span_hashes(data, start, end, lower=True)
                n, fp, band = [], [], []
                for i in range(last - first):
                    items = np.unique(shingles(words[at[i]:at[i + 1]], k))
                    n.append(len(items))
                    fp.append(_fingerprint(items) if len(items) else None)
                    band.append(band_hashes(super_minhash(items, bands * rows), bands, rows) if len(items) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids[first:last], keys[first:last], pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(band, pa.list_(pa.int64()))],
                    names=["doc_id", "row_key", "n_shingles", "fp", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), "text").mapInArrow(
        releasing(run), "doc_id long, row_key long, n_shingles long, fp binary, bands array<long>"
    )


def shingle_sets(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(fp, pivot, items, parts) for rows of (fp, pivot, text); parts are the numbers of items in each of ``PARTS`` classes."""

    def run(batches):
        for batch in batches:
            at = 0
            for first, last, data, offsets in slices(batch.column("text"), SLICE):
                start, end, cut = word_spans(data, offsets)
                words = span_hashes(data, start, end, lower=True)
                items = [np.unique(shingles(words[cut[i]:cut[i + 1]], k)).view(np.int64) for i in range(last - first)]
                parts = [np.bincount(x & (PARTS - 1), minlength=PARTS) for x in items]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("fp").slice(at, last - first), batch.column("pivot").slice(at, last - first), pa.array(items, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.int32()))],
                    names=["fp", "pivot", "items", "parts"],
                )
                at += last - first

    return docs.select("fp", "pivot", "text").mapInArrow(releasing(run), "fp long, pivot long, items array<long>, parts array<int>")


def _confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs (x, y, items_x, items_y) that are similar enough, a > b."""
    both = F.size(F.array_intersect("items_x", "items_y")).cast("long")
    return pairs.withColumn("both", both).where(
        F.col("both") * 100 >= (F.size("items_x").cast("long") + F.size("items_y") - F.col("both")) * percent
    ).select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))


def _bounds(open_: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int, shared: Shared) -> DataFrame:
    """(fp, n, most, parts): the open nodes that can have a partner at all.

    Two sets of sizes n and m need an intersection of percent * (n + m) / (100 + percent), and a node's intersections
    hold only items that it shares with any other open node.  ``parts`` counts those by class, so the sum of the
    smaller counts bounds an intersection; ``most`` is the largest size of a partner by their total.  Most variants of
    one text that missed their pivot have too many words of their own, or miss other words than their partners.
    """
    ids = shared.put(open_.select("fp").distinct())
    own = sets.join(ids, "fp", "left_semi")
    items = own.select(F.xxhash64("fp").alias("node"), F.explode("items").alias("item"))
    alone = items.groupBy("item").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    part = F.col("item").bitwiseAND(F.lit(PARTS - 1))
    alone = alone.groupBy("node").agg(*[F.count_if(part == k).alias(f"a{k}") for k in range(PARTS)])
    left = F.struct(*[(F.col("parts")[k] - F.coalesce(f"a{k}", F.lit(0))).cast("int").alias(f"p{k}") for k in range(PARTS)])
    size = own.select("fp", F.size("items").cast("long").alias("n"), "parts", F.xxhash64("fp").alias("node")).join(alone, "node", "left").select("fp", "n", left.alias("parts"))
    common = sum(F.col(f"parts.p{k}").cast("long") for k in range(PARTS))
    size = size.withColumn("most", F.floor(common * (100 + percent) / percent - F.col("n")))
    return shared.put(size.where(F.col("most") * 100 >= F.col("n") * percent))


def _open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, fp, ..., root) of the buckets whose nodes are in several groups."""
    grouped = members.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    mixed = grouped.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    return grouped.join(mixed, "h")


def _could_link(percent: int) -> str:
    return (
        "fp_a <> fp_b and root_a <> root_b and n_b <= most_a and n_a <= most_b "
        f"and least(n_a, n_b) * 100 >= greatest(n_a, n_b) * {percent} "
        f"and ({' + '.join(f'least(parts_a.p{k}, parts_b.p{k})' for k in range(PARTS))}) * {100 + percent} >= (n_a + n_b) * {percent}"
    )


def _side(rows: DataFrame, side: str, *more: str) -> DataFrame:
    return rows.select("h", *more, *[F.col(c).alias(f"{c}_{side}") for c in ("fp", "root", "n", "most", "parts")])


def _pairs(found: DataFrame) -> DataFrame:
    return found.select(F.greatest("fp_a", "fp_b").alias("a"), F.least("fp_a", "fp_b").alias("b")).distinct()


def _to_pivots(rows: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    return _pairs(_side(rows, "a").join(_side(pivots, "b"), "h").where(_could_link(percent)))


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b): every pair of nodes of a bucket that are in different groups and could still be similar enough."""
    step = lambda c: F.floor(F.log(c) / F.log(F.lit(CLASS)))
    low = F.greatest(F.lit(1), F.floor(F.col("n") * percent / 100))
    high = F.least(F.col("most"), F.ceil(F.col("n") * 100 / percent))
    ask = _side(rows.withColumn("class", F.explode(F.sequence(step(low), step(high)))), "a", "class")
    give = _side(rows.withColumn("class", step(F.col("n"))), "b", "class")
    return _pairs(ask.join(give, ["h", "class"]).where(_could_link(percent)).where("fp_a > fp_b"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, row_key, n_shingles, component_id, kept) for each row of ``docs``; see the module's docstring."""
    spark = docs.sparkSession
    shared = Shared(spark)
    whole = shared.put(signatures(docs, k, bands, rows))
    nodes = whole.where("n_shingles > 0").groupBy("fp").agg(
        F.min("doc_id").alias("rep"), F.min("row_key").alias("row_key"), F.max("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    # a node has a number from here on, which is half of its fingerprint
    numbered = shared.put(nodes.withColumnRenamed("fp", "print").withColumn("fp", F.monotonically_increasing_id()))
    sig = shared.put(whole.drop("bands").withColumnRenamed("fp", "print"))
    shared.drop(whole)
    banded = numbered.select("fp", F.explode("bands").alias("h"))
    shared_bands = shared.put(banded.groupBy("h").agg(F.count("*").alias("size")).where("size > 1"))
    sized = shared.put(banded.join(small(shared_bands), "h"))
    nodes = shared.put(numbered.drop("bands"))
    shared.drop(numbered, shared_bands)
    scored = shared.put(sized.groupBy("fp").agg(F.sum("size").alias("score")))
    members = shared.put(sized.join(scored, "fp").select("h", "fp", "score"))
    shared.drop(sized, scored)
    # the pivot of a bucket is the node that sits in the fullest buckets: the text the others were made from
    pivots = shared.put(members.groupBy("h").agg(F.max(F.struct("score", "fp")).alias("top")).select("h", F.col("top.score").alias("top_score"), F.col("top.fp").alias("pivot")))
    proposed = members.select("h", "fp").join(pivots, "h").groupBy("fp").agg(F.max(F.struct("top_score", "pivot")).alias("p")).select("fp", F.col("p.pivot").alias("pivot"))
    wanted = shared.put(proposed.join(nodes.select("fp", "row_key", "n"), "fp"))
    shared.drop(pivots)
    text = docs.select(row_key().alias("row_key"), "text").join(small(wanted), "row_key").drop("row_key")
    sets = shared.put(shingle_sets(text, k))
    shared.drop(wanted)
    # what sizes and items by class can't rule out meets its pivot; whole sets travel for these alone
    slim = sets.select("fp", "pivot", F.size("items").cast("long").alias("n"), "parts")
    centre = slim.join(slim.select("pivot").distinct().withColumnRenamed("pivot", "fp"), "fp", "left_semi").select(F.col("fp").alias("pivot"), F.col("n").alias("m"), F.col("parts").alias("parts_y"))
    most = F.aggregate(F.zip_with("parts", "parts_y", lambda x, y: F.least(x, y).cast("long")), F.lit(0).cast("long"), lambda acc, x: acc + x)
    tested = shared.put(slim.where("fp <> pivot").select(F.greatest("fp", "pivot").alias("a"), F.least("fp", "pivot").alias("b")))
    could = shared.put(slim.where("fp <> pivot").join(small(shared.put(centre), 200_000), "pivot").where(
        (most * (100 + percent) >= (F.col("n") + F.col("m")) * percent)).select(F.col("fp").alias("x"), F.col("pivot").alias("y")))
    # a pivot with many copies is sent to several tasks
    salts = shared.put(could.groupBy("y").agg(F.ceil(F.count("*") / PER_PIVOT).cast("int").alias("salts")))
    centre = sets.join(salts.withColumnRenamed("y", "fp"), "fp").select(F.col("fp").alias("y"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("items").alias("items_y"))
    first = sets.select(F.col("fp").alias("x"), F.col("items").alias("items_x")).join(small(could), "x").join(small(salts), "y")
    first = first.withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts")).cast("int")).drop("salts").join(centre, ["y", "salt"])
    links = shared.put(_confirmed(first, percent))
    roots = shared.put(components(links, shared))
    shared.drop(could, salts, links)
    size = _bounds(_open(members.select("h", "fp"), roots), nodes, sets, percent, shared)
    rows = shared.put(members.select("h", "fp").join(size, "fp"))
    used = None
    for turn in range(PIVOT_ROUNDS + 1):
        now = shared.put(_open(rows, roots))
        if now.isEmpty():
            break
        if turn < PIVOT_ROUNDS:
            # the next pivot of a bucket: the node with the fewest items of its own that was none yet
            left = now if used is None else now.join(used, ["h", "fp"], "left_anti")
            best = left.groupBy("h").agg(F.max(F.struct((F.col("most") / F.col("n")).alias("share"), "fp", "root", "n", "most", "parts")).alias("p"))
            pivots = shared.put(best.select("h", "p.fp", "p.root", "p.n", "p.most", "p.parts"))
            used = pivots.select("h", "fp") if used is None else used.union(pivots.select("h", "fp"))
            pairs = _to_pivots(now, pivots, percent)
        else:
            pairs = _across(now, percent)
        pairs = shared.put(pairs.join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            continue
        left = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).join(sets.select(F.col("fp").alias("x"), F.col("items").alias("items_x")), "x")
        more = shared.put(_confirmed(left.join(sets.select(F.col("fp").alias("y"), F.col("items").alias("items_y")), "y"), percent))
        tested = tested.union(pairs)
        roots = shared.put(components(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).union(more), shared))
    label = nodes.select("print", "fp", "rep").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = label.groupBy("root").agg(F.min("rep").alias("component_id"))
    label = shared.put(label.join(least, "root").select("print", "component_id"))
    shared.drop(sets, members, nodes)
    out = sig.join(label, "print", "left")
    own = F.when(F.col("print").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "row_key", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder)).drop("row_key")


def stage(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id."""
    shared = Shared(spark)
    gone = shared.put(near_duplicates(docs).where("not kept and doc_id is not null").select("row_key").distinct())
    return without_rows(docs, gone)


QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}
#: The exact groups by brute force: all pairs that share a shingle, then everything that can be reached.
SQL = {"op2_minhash_near_dedup": rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as materialized (select distinct doc_id, hash(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) g from (select doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) i from d where len(w) > 0) x),
n as materialized (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id > b.doc_id group by all),
l as materialized (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {PERCENT} * (x.n + y.n - c)),
e as materialized (select a, b from l union select b, a from l),
reach as (select distinct doc_id a, doc_id b from d union select r.a, e.b from reach r join e on r.b = e.a)
select d.doc_id, coalesce(any_value(n), 0) n_shingles, min(b) component_id, d.doc_id = min(b) kept
from d join reach on d.doc_id = a left join n on n.doc_id = d.doc_id group by d.doc_id
"""}
