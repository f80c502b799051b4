"""Fuzzy repeated passages by collinear chaining of k-mer seeds (operator 10).

Documents with equal word sequences become one.  Seeds are winnowed k-mers of words: of ``WINDOW`` neighbouring k-mers
the one with the smallest hash, so two documents that share ``SEED + WINDOW - 1`` words in a row share a seed.  Each
seed of two or more documents links its documents to one of them, the pivot, instead of to each other, and the pivot's
further places of the seed to the last of the others; what a document shares with several pivots is joined again at the end.  Where documents share more than their pivot does, those
that leave it at the same place next to the end of a chain are compared from there on.

The anchors of a document and a pivot are chained: ordered in both, scored by matched words less a cost of the gaps,
the best predecessor found in a Fenwick tree over the pivot's places.  Chains break at gaps of more than ``GAP`` words
or shifts of more than ``SHIFT``.  Both ends of a chain are then aligned word by word, with up to ``EDIT`` words at a place
replaced, left out or added on the way, for which only the words next to the ends are fetched; chains on both sides of
an edit meet there.  The intervals of a document that touch are one passage; passages of ``MIN_WORDS`` words or more are returned.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased.  Defined results: null, empty and shorter texts have no passage;
repeated rows and documents of equal words repeat as a whole, from word 0 to the last; a null doc_id takes part;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import Shared, documents, releasing, row_key, shingles, slices, small, span_hashes, word_spans
from .minhash import _fingerprint

SEED, WINDOW = 8, 16
MIN_WORDS = 50
GAP, SHIFT = 16, 6
GAP_COST = 0.25
TAIL = SEED + WINDOW  # words compared beyond a pivot's share; a run holds a seed of its own after fewer
EDIT = 5  # words that may be replaced, left out or added at one place
# words fetched beyond the ends of a chain: up to an edit, the edit, and what may follow it without a seed
REACH = 2 * (SEED + WINDOW)
WANTED = 1_000_000  # places whose words are asked for by broadcast; beyond, texts are shuffled to them
FEW = 5  # words that are compared first
BITMAPS = 16_384  # bitmaps of 4 KB that are sent to all tasks
HOT = 10_000  # rows of one key beyond which its rows stay where they are
# (words of one side, words of the other, equal words that must follow)
_EDITS = [(1, 1, 3), (1, 0, 3), (0, 1, 3)] + sorted(((i, j, 4) for i in range(EDIT + 1) for j in range(EDIT + 1) if max(i, j) > 1), key=lambda e: (max(e[:2]), e[0] + e[1]))


def winnowed(kmers: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The places of the smallest hash of each window, the last one on ties.

    A stretch of one repeated k-mer gives a place per word.  All next to its two ends stay, where it is told from the
    words around it; inside, as few as leave one in each window and no word between them that had a seed."""
    n = len(kmers)
    if n <= window:
        return np.array([n - 1 - int(np.argmin(kmers[::-1]))]) if n else np.zeros(0, np.int64)
    back = kmers[::-1]
    first = np.lib.stride_tricks.sliding_window_view(back, window).argmin(axis=1) + np.arange(n - window + 1)
    at = n - 1 - np.unique(first)[::-1]
    begin = np.flatnonzero(np.concatenate([[True], kmers[at[1:]] != kmers[at[:-1]]]))
    past = np.append(begin[1:], len(at))
    keep = np.ones(len(at), bool)
    for low, high in zip(*(v[past - begin > 2 * SEED + 1].tolist() for v in (begin, past)), strict=True):
        i, stop = low + SEED - 1, high - SEED
        keep[i + 1:stop] = False
        while True:
            # the farthest place that the words of the last one still touch
            i = max(i + 1, int(np.searchsorted(at[i:stop + 1], at[i] + SEED, "right")) - 1 + i)
            if i >= stop:
                break
            keep[i] = True
    return at[keep]


def seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, fp, n_words, seeds, places) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in slices(batch.column("text")):
                fps, n, hashes, places = [], [], [], []
                start, end, at = word_spans(data, offsets)
                words = span_hashes(data, start, end, lower=True)
                for i in range(len(at) - 1):
                    own = words[at[i]:at[i + 1]]
                    n.append(len(own))
                    fps.append(_fingerprint(own))
                    if len(own) < SEED:
                        hashes.append(own[:0].view(np.int64))
                        places.append(np.zeros(0, np.int32))
                        continue
                    kmers = shingles(own, SEED)
                    keep = winnowed(kmers)
                    hashes.append(kmers[keep].view(np.int64))
                    places.append(keep.astype(np.int32))
                ids, keys = (batch.column(c).slice(first, last - first) for c in ("doc_id", "row_key"))
                yield pa.RecordBatch.from_arrays([
                    ids, keys, pa.array(fps, pa.binary()), pa.array(n, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))
                ], names=["doc_id", "row_key", "fp", "n_words", "seeds", "places"])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row_key"), "text").mapInArrow(
        releasing(run), "doc_id long, row_key long, fp binary, n_words long, seeds array<long>, places array<int>"
    )


class Fenwick:
    """Prefix maxima over ranks, with who holds them."""

    def __init__(self, n: int):
        self.value, self.who = [float("-inf")] * (n + 1), [-1] * (n + 1)

    def put(self, at: int, value: float, who: int) -> None:
        at += 1
        while at < len(self.value):
            if value > self.value[at]:
                self.value[at], self.who[at] = value, who
            at += at & -at

    def best(self, before: int) -> tuple[float, int]:
        """The largest of the ranks below ``before``."""
        value, who = float("-inf"), -1
        while before > 0:
            if self.value[before] > value:
                value, who = self.value[before], self.who[before]
            before -= before & -before
        return value, who


def chains(anchors: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, pivot start, pivot end), in words, of the collinear chains of (place, pivot place)."""
    anchors = sorted(set(anchors))
    ranks = {p: i for i, p in enumerate(sorted({p for _, p in anchors}))}
    tree = Fenwick(len(ranks))
    score, before = [0.0] * len(anchors), [-1] * len(anchors)
    at = 0
    while at < len(anchors):
        to = at
        while to < len(anchors) and anchors[to][0] == anchors[at][0]:
            to += 1
        for i in range(at, to):  # those at one place cannot follow each other
            x, p = anchors[i]
            value, who = tree.best(ranks[p])
            gain = value - GAP_COST * (x + p)
            if who >= 0 and gain > 0:
                score[i], before[i] = SEED + gain, who
            else:
                score[i] = SEED
        for i in range(at, to):
            x, p = anchors[i]
            tree.put(ranks[p], score[i] + GAP_COST * (x + p), i)
        at = to
    used = [False] * len(anchors)
    out = []
    for i in sorted(range(len(anchors)), key=lambda i: -score[i]):
        if used[i]:
            continue
        x, p = anchors[i]
        low, high, plow, phigh = x, x + SEED, p, p + SEED
        used[i] = True
        j = before[i]
        while j >= 0 and not used[j]:
            used[j] = True
            x, p = anchors[j]
            if low - (x + SEED) > GAP or plow - (p + SEED) > GAP or abs((low - x) - (plow - p)) > SHIFT:
                out.append((low, high, plow, phigh))
                high, phigh = x + SEED, p + SEED
            low, plow = x, p
            j = before[j]
        out.append((low, high, plow, phigh))
    return out


def aligned(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """How many words from the start of ``a`` and ``b`` belong together.

    Equal words go on; a word replaced, left out or added is passed if three equal words follow it, up to ``EDIT``
    words if four do, the fewest first."""
    a, b = a.tolist(), b.tolist()
    i = j = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        for di, dj, k in _EDITS:
            if i + di + k <= n and j + dj + k <= m and a[i + di] == b[j + dj] and a[i + di:i + di + k] == b[j + dj:j + dj + k]:
                i, j = i + di, j + dj
                break
        else:
            break
    return i, j


_CHAIN = "x long, p long, s long, e long, ps long, pe long"


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for x, p, xs, ps in zip(*(batch.column(c).to_pylist() for c in ("x", "p", "xs", "ps")), strict=True):
            rows += [(x, p, *c) for c in chains(list(zip(xs, ps, strict=True)))]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(6)], names=["x", "p", "s", "e", "ps", "pe"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts for the way to another task."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_string()).view(pa.large_binary())
        yield pa.RecordBatch.from_arrays([batch.column("row_key"), pa.array([zlib.compress(t.as_buffer() or b"") for t in texts], pa.binary())], names=["row_key", "packed"])


def _runs(batch: pa.RecordBatch, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``slices`` of the texts, which are packed if they came from another task."""
    if "text" in batch.schema.names:
        yield from slices(batch.column("text"), most)
        return
    at, packed = 0, batch.column("packed")
    while at < len(packed):
        first, size, texts = at, 0, []
        while at < len(packed) and size < most:
            texts.append(zlib.decompress(packed[at].as_buffer()))
            size, at = size + len(texts[-1]), at + 1
        yield first, at, np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])


def _ends(reach: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The words next to the wanted places: before an even request, from an odd one on, at most ``reach``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in _runs(batch):
                start, end, at = word_spans(data, offsets)
                words = (span_hashes(data, start, end, lower=True) >> np.uint64(32)).astype(np.uint32)
                keys, wants, found = [], [], []
                for i in range(last - first):
                    own = words[at[i]:at[i + 1]]
                    key = batch.column("doc")[first + i].as_py()
                    for want in batch.column("wants")[first + i].as_py():
                        place = want >> 1
                        part = own[place:place + reach] if want & 1 else own[max(0, place - reach):place][::-1]
                        keys.append(key)
                        wants.append(want)
                        found.append(part.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(wants, pa.int64()), pa.array(found, pa.binary())], names=["doc", "want", "words"])

    return releasing(run)


def _words_at(docs: DataFrame, rows: DataFrame, wants: DataFrame, reach: int, shared: Shared) -> DataFrame:
    """(doc, want, words) for the different ``wants(doc, want)``, by one pass over the texts of their documents."""
    lists = shared.put(wants.distinct().groupBy("doc").agg(F.collect_list("want").alias("wants")).join(rows.select("doc", "row_key"), "doc"))  # at most twice a document's words
    n = lists.agg(F.sum(F.size("wants") + 1)).first()[0] or 0
    text = docs.select(row_key().alias("row_key"), "text")
    # of repeated rows one is asked, so that no words come twice
    again = shared.put(rows.groupBy("row_key").count().where("count > 1").join(lists, "row_key", "left_semi").select("row_key"))
    if not again.isEmpty():
        repeated = text.join(small(again), "row_key", "left_semi").dropDuplicates(["row_key"])
        text = text.join(small(again), "row_key", "left_anti").union(repeated)
    if n <= WANTED:
        asked = text.join(F.broadcast(lists), "row_key")
    else:
        if lists.count() <= WANTED:
            text = text.join(F.broadcast(lists.select("row_key")), "row_key", "left_semi")
        asked = text.mapInArrow(releasing(_packed), "row_key long, packed binary").join(lists, "row_key")
    ends = shared.put(asked.mapInArrow(_ends(reach), "doc long, want long, words binary"))
    shared.drop(lists, again)
    return ends


def _without(wide: DataFrame, gone: DataFrame, shared: Shared) -> DataFrame:
    """``wide`` without the rows whose ``doc`` is in ``gone``: a bit for each is sent to the rows, which stay where they are."""
    bits = shared.put(gone.groupBy(F.bitmap_bucket_number("doc").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc")).alias("bits")))
    place = F.bitmap_bit_position("doc")
    byte = F.conv(F.hex(F.substring("bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    named = wide.withColumn("bucket", F.bitmap_bucket_number("doc")).join(small(bits, BITMAPS), "bucket", "left")
    held = byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) > 0
    return named.where(F.col("bits").isNull() | ~held).drop("bucket", "bits")


def _at_hot(left: DataFrame, right: DataFrame, on: list[str], shared: Shared) -> DataFrame:
    """``left`` joined with ``right``, whose keys are unique: rows of keys that ``HOT`` rows of ``left`` share stay in place."""
    hot = shared.put(left.groupBy(*on).count().where(F.col("count") > HOT).select(*on))
    if hot.isEmpty():
        return left.join(right, on)
    of_hot = shared.put(right.join(small(hot), on, "left_semi"))
    return left.join(small(of_hot), on).unionByName(left.join(small(hot), on, "left_anti").join(right, on))


_FULL = f"{_CHAIN}, el long, er long, tl binary, tr binary, cs long, ce long, cps long, cpe long"


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains with both ends aligned, and per end how many words equal the pivot's and the ``TAIL`` words after these."""
    for batch in batches:
        xl, pl, xr, pr = ([np.frombuffer(v or b"", np.uint32) for v in batch.column(c).to_pylist()] for c in ("xl", "pl", "xr", "pr"))
        move = [(*aligned(a, b), *aligned(c, d)) for a, b, c, d in zip(xl, pl, xr, pr, strict=True)]
        equal = [[_equal(a, b) for a, b in zip(*side, strict=True)] for side in ((xl, pl), (xr, pr))]
        tails = [[a[k:k + TAIL].tobytes() for a, k in zip(side, ks, strict=True)] for side, ks in zip((xl, xr), equal, strict=True)]
        m = np.array(move, np.int64).reshape(-1, 4)
        s, e, ps, pe = (batch.column(c).to_numpy() for c in ("s", "e", "ps", "pe"))
        yield pa.RecordBatch.from_arrays([
            batch.column("x"), batch.column("p"), pa.array(s - m[:, 0]), pa.array(e + m[:, 2]), pa.array(ps - m[:, 1]), pa.array(pe + m[:, 3]),
            *(pa.array(k, pa.int64()) for k in equal), *(pa.array(t, pa.binary()) for t in tails), batch.column("s"), batch.column("e"), batch.column("ps"), batch.column("pe"),
        ], names=["x", "p", "s", "e", "ps", "pe", "el", "er", "tl", "tr", "cs", "ce", "cps", "cpe"])


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _beyond(full: DataFrame, shared: Shared) -> DataFrame:
    """(doc, s, e, y): what documents that leave a pivot at the same place have in common from there on.

    Equal beginnings of the words after that place are counted, so a document meets all others that leave there,
    however many, without a pair of them; those whose first word no other has leave before."""
    place = full.select("x", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.struct("p", (F.col("cps") - F.col("el")).alias("at")).alias("k"), (F.col("cs") - F.col("el")).alias("at"), F.col("ce").alias("far"), F.col("tl").alias("tail")),
        F.struct(F.lit(1).alias("side"), F.struct("p", (F.col("cpe") + F.col("er")).alias("at")).alias("k"), (F.col("ce") + F.col("er")).alias("at"), F.col("cs").alias("far"), F.col("tr").alias("tail")),
    )).alias("v")).select("x", "v.*").where(F.length("tail") > 0)

    def part(n: int | Column) -> Column:
        return F.xxhash64("side", "k.p", "k.at", F.substring("tail", F.lit(1), 4 * n if isinstance(n, Column) else F.lit(4 * n)))

    def common(rows: DataFrame) -> DataFrame:
        return rows.groupBy("h").agg(F.min("x").alias("y"), F.max("x").alias("z")).where("y <> z")

    first = place.withColumn("h", part(1))
    met = shared.put(first.join(common(first).select("h"), "h", "left_semi").drop("h").withColumn("id", F.monotonically_increasing_id()))
    # only those that share some words are compared in all lengths
    deep = met.where(F.length("tail") >= 4 * FEW).withColumn("h", part(FEW))
    deep = deep.join(common(deep).select("h"), "h", "left_semi").select("id", F.lit(TAIL).alias("most"))
    long = met.join(deep, "id", "left").withColumn("most", F.least((F.length("tail") / 4).cast("int"), F.coalesce("most", F.lit(FEW - 1))))
    every = long.select("id", "x", "side", "k", "tail", F.explode(F.sequence(F.lit(1), F.col("most"))).alias("n")).withColumn("h", part(F.col("n"))).select("id", "x", "n", "h")
    longest = every.select("id", "n", "h").join(common(every), "h").groupBy("id").agg(F.max(F.struct("n", "y", "z")).alias("m"))
    left = F.col("side") == 0
    return met.join(longest, "id").select(
        F.col("x").alias("doc"), F.when(left, F.col("at") - F.col("m.n")).otherwise(F.col("far")).alias("s"), F.when(left, F.col("far")).otherwise(F.col("at") + F.col("m.n")).alias("e"), F.when(F.col("x") == F.col("m.y"), F.col("m.z")).otherwise(F.col("m.y")).alias("y")
    )


def _islands(rows: DataFrame, slack: int) -> DataFrame:
    """``rows(doc, s, e, ...)`` with ``island``: intervals of a document that are at most ``slack`` words apart share it.

    There is a row for each (doc, s) at most, so a document's rows are bounded by its words."""
    order = W.partitionBy("doc").orderBy("s")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(F.coalesce(reach, F.lit(-1 << 40)) + slack < F.col("s"), 1).otherwise(0)
    return rows.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order)).drop("fresh")


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words, source_doc_id, n_links) of each repeated passage of each row.

    ``source_doc_id`` is the smallest id of another document linked by the passage, ``n_links`` the number of links
    that make it up."""
    shared = Shared(docs.sparkSession)
    # rows are named by numbers that rise with them, which are half as long in a shuffle as hashes
    wide = shared.put(seeds(docs).withColumn("doc", F.monotonically_increasing_id()))
    rows = shared.put(wide.drop("seeds", "places"))
    nodes = shared.put(rows.groupBy("fp").agg(
        F.min("doc_id").alias("doc_id"), F.min("doc").alias("doc"), F.max("n_words").alias("n_words"), F.count("*").alias("copies"), F.max("doc_id").alias("last_id")
    ))
    seed = _without(wide, rows.join(nodes.select("doc"), "doc", "left_anti"), shared).select("doc", F.explode(F.arrays_zip("seeds", "places")).alias("a")).select("doc", F.col("a.seeds").alias("h"), F.col("a.places").cast("long").alias("at"))
    # most seeds are alone; they leave by their hashes only
    twice = seed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    linked = shared.put(seed.join(twice, "h"))
    shared.drop(wide)
    pivot = linked.groupBy("h").agg(F.min(F.struct("doc", "at")).alias("m"), F.max(F.struct("doc", "at")).alias("q")).where("m.doc <> q.doc")
    # a pivot's further places of a seed are linked to another document that holds it
    own = F.col("doc") == F.col("m.doc")
    link = _at_hot(linked, pivot, ["h"], shared).where(~own | (F.col("at") > F.col("m.at"))).select(
        F.col("doc").alias("x"), F.when(own, F.col("q.doc")).otherwise(F.col("m.doc")).alias("p"), "at", F.when(own, F.col("q.at")).otherwise(F.col("m.at")).alias("pat")
    )
    anchors = link.groupBy("x", "p").agg(F.collect_list(F.struct("at", "pat")).alias("a"))
    found = anchors.select("x", "p", F.transform("a", lambda a: a["at"]).alias("xs"), F.transform("a", lambda a: a["pat"]).alias("ps")).mapInArrow(releasing(_chained), _CHAIN)
    found = shared.put(found.withColumn("id", F.monotonically_increasing_id()))
    shared.drop(linked)
    want = found.select("id", F.explode(F.array(*[
        F.struct(F.lit(k).alias("k"), F.col(d).alias("doc"), (F.col(c) * 2 + side).alias("want")) for k, d, c, side in (("xl", "x", "s", 0), ("pl", "p", "ps", 0), ("xr", "x", "e", 1), ("pr", "p", "pe", 1))
    ])).alias("w")).select("id", "w.*")
    ends = _words_at(docs, rows, want.select("doc", "want"), REACH, shared)
    sides = _at_hot(want, ends, ["doc", "want"], shared).groupBy("id").agg(*[F.max(F.when(F.col("k") == k, F.col("words"))).alias(k) for k in ("xl", "pl", "xr", "pr")])
    full = shared.put(found.join(sides, "id", "left").mapInArrow(releasing(_extended), _FULL))
    ids = nodes.select("doc", "doc_id")
    named = full.join(ids.select(F.col("doc").alias("x"), F.col("doc_id").alias("xid")), "x").join(ids.select(F.col("doc").alias("p"), F.col("doc_id").alias("pid")), "p")
    both = named.select(F.col("x").alias("doc"), "s", "e", F.col("pid").alias("other")).union(named.select(F.col("p").alias("doc"), F.col("ps").alias("s"), F.col("pe").alias("e"), F.col("xid").alias("other")))
    beyond = _beyond(full, shared)
    both = both.union(beyond.join(ids.select(F.col("doc").alias("y"), F.col("doc_id").alias("other")), "y").select("doc", "s", "e", "other"))
    spans = both.groupBy("doc", "s").agg(F.max("e").alias("e"), F.min("other").alias("other"), F.count("*").alias("n"))
    merged = _islands(spans, 0).groupBy("doc", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.min("other").alias("other"), F.sum("n").alias("n")).where(F.col("e") - F.col("s") >= min_words)
    merged = merged.select("doc", "s", "e", "other", "n")
    # copies repeat as a whole
    copied = rows.join(nodes.where((F.col("copies") > 1) & (F.col("n_words") >= min_words)).select("fp", F.col("doc_id").alias("rep"), "last_id", "copies"), "fp").select(
        "doc_id", F.lit(0).cast("long").alias("start_word"), F.col("n_words").alias("end_word"), F.when(F.col("doc_id") == F.col("rep"), F.col("last_id")).otherwise(F.col("rep")).alias("source_doc_id"), (F.col("copies") - 1).alias("n_links")
    )
    single = merged.join(nodes.where("copies = 1").select("doc", "doc_id"), "doc").select("doc_id", F.col("s").alias("start_word"), F.col("e").alias("end_word"), F.col("other").alias("source_doc_id"), F.col("n").alias("n_links"))
    out = copied.union(single)
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "source_doc_id", "n_links")


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(documents(spark, folder))


QUERIES = {"op10_substring_dedup": op10_substring_dedup}
SQL: dict[str, str] = {}
