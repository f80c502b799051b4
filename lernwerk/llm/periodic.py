"""Periodic runs of words by internal pattern matching (operator 12).

A run is a stretch of words with smallest period q, at least max(6, 4 * q) words long, that can't be extended.  Texts are
laid one after the other and their words numbered per text.  Rounds of prefix doubling give the suffix array and, on the
way, a name for every stretch of 2**k words.  For each k the stretches at multiples of 2**k are asked for in the window
of the next 2**k .. 2**(k+1) - 1 starts: their interval of the suffix array is known from their name, and a wavelet tree
over the array answers "smallest place at or after x" in it.  Occurrences of a stretch in such a window form one
arithmetic progression: up to two are candidates themselves, and a longer progression, whose difference p is the
stretch's period, leaves only the two shifts that bring the ends of its runs of period p together.  Every run has a
stretch with 2**k <= q < 2**(k+1) among its first words whose next occurrence lies q further, so its period is always a
candidate.  Each is checked and extended both ways by comparing names, exactly.

Tasks work on about 2 MB of whole texts at a time; a text of n words takes about 5 bytes for the tree and 4 per word and
name level, of which there are log2 of its longest repeat.  Defined results: a null, empty or blank text has no runs and
an empty collapsed text; every row gives a row, repeated rows and null ids too; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.common import let
from .common import dictionary, documents, slices, word_spans

#: The least length of a run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4


class WaveletTree:
    """Ranges of an array of numbers below 2**bits: a bit vector with counted words per level, the high bits first."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels = bits, []
        for b in reversed(range(bits)):
            zero = (values >> b & 1) == 0
            packed = np.packbits(zero, bitorder="little")
            held = np.zeros(len(packed) // 8 + 1, np.uint64)
            held.view(np.uint8)[:len(packed)] = packed
            count = np.zeros(len(held) + 1, np.int64)
            np.cumsum(np.bitwise_count(held), out=count[1:])
            self.levels.append((b, held, count, int(count[-1])))
            values = np.concatenate([values[zero], values[~zero]])

    @staticmethod
    def _zeros(level: tuple, i: np.ndarray) -> np.ndarray:
        """How many zeros stand before place i."""
        _, held, count, _ = level
        at = i >> 6
        return count[at] + np.bitwise_count(held[at] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of each range [low, high) are smaller than x."""
        n = np.zeros(len(low), np.int64)
        for level in self.levels:
            a, z = self._zeros(level, low), self._zeros(level, high)
            one = (x >> level[0] & 1) == 1
            n += np.where(one, z - a, 0)
            low, high = np.where(one, level[3] + low - a, a), np.where(one, level[3] + high - z, z)
        return n

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of rank k (from 0) in each range."""
        value = np.zeros(len(low), np.int64)
        for level in self.levels:
            a, z = self._zeros(level, low), self._zeros(level, high)
            one = k >= z - a
            value |= one.astype(np.int64) << level[0]
            k = np.where(one, k - (z - a), k)
            low, high = np.where(one, level[3] + low - a, a), np.where(one, level[3] + high - z, z)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The smallest value of at least x in each range; 2**bits where there is none."""
        k = self.below(low, high, x)
        out = np.full(len(low), 1 << self.bits, np.int64)
        have = np.flatnonzero(k < high - low)
        out[have] = self.smallest(low[have], high[have], k[have])
        return out


def names(seq: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each k the name of the 2**k words from every place on, and the suffix array.

    A name is where its group begins in the suffix array, so equal stretches, and only they, share one; the last level
    tells all places apart."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    new = np.ones(n, bool)
    new[1:] = seq[order[1:]] != seq[order[:-1]]
    name = np.empty(n, np.int32)
    name[order] = np.flatnonzero(new)[np.cumsum(new) - 1]
    levels, half = [name], 1
    while True:
        alone = new.copy()
        alone[:-1] &= new[1:]
        open_ = np.flatnonzero(~alone)
        if not len(open_):
            return levels, order
        at = order[open_]
        then = np.where(at + half < n, name[np.minimum(at + half, n - 1)], -1).astype(np.int64)
        key = name[at].astype(np.int64) * (n + 1) + then + 1
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[open_] = at
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        new[open_] = first
        name = name.copy()
        name[at] = open_[np.flatnonzero(first)][np.cumsum(first) - 1]
        levels.append(name)
        half *= 2


def ahead(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words are equal from places i and j on."""
    n, same = len(levels[0]), np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        a, b = i + same, j + same
        ok = (a < n) & (b < n)
        same += np.where(ok & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)]), 1 << k, 0)
    return same


def behind(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words are equal just before places i and j."""
    same = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        a, b = i - same - (1 << k), j - same - (1 << k)
        ok = (a >= 0) & (b >= 0)
        same += np.where(ok & (levels[k][np.maximum(a, 0)] == levels[k][np.maximum(b, 0)]), 1 << k, 0)
    return same


def candidates(levels: list[np.ndarray], order: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of every possible run; ``left`` is how many words of its own text stand from a place on."""
    n = len(order)
    tree = WaveletTree(order.astype(np.int64), max(1, n.bit_length()))
    places, periods = [], []
    for k, name in enumerate(levels):
        size = 1 << k
        low = name[::size].astype(np.int64)
        # a run holds its first stretch at three places or more, that of one word at six
        high = low + np.bincount(name, minlength=n)[low]
        at = np.flatnonzero((high - low >= (LEAST_WORDS if k == 0 else 3)) & (left[::size] >= size))
        i, low, high = at * size, low[at], high[at]
        if not len(i):
            continue
        end = i + 2 * size
        one = tree.successor(low, high, i + size)
        have = np.flatnonzero(one < end)
        i, low, high, end, one = i[have], low[have], high[have], end[have], one[have]
        places.append(i)
        periods.append(one - i)
        if size == 1 or not len(i):
            continue
        two = tree.successor(low, high, one + 1)
        have = np.flatnonzero(two < end)
        i, end, one, two = i[have], end[have], one[have], two[have]
        p = two - one
        places += [i, i, i]
        periods += [
            two - i,
            (one - behind(levels, one, one + p)) - (i - behind(levels, i, i + p)),
            (one + ahead(levels, one, one + p)) - (i + ahead(levels, i, i + p)),
        ]
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, d = np.concatenate(places), np.concatenate(periods)
    good = (d > 0) & (d * LEAST_PERIODS <= n) & (i + d < n)
    return i[good], d[good]


def runs(seq: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of the runs in ``seq``, whose texts end in 0 and share no other number, by start, then period."""
    levels, order = names(seq)
    i, d = candidates(levels, order, left)
    start, end = i - behind(levels, i, i + d), i + d + ahead(levels, i, i + d)
    good = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * d)
    found = np.unique(np.stack([start[good], end[good], d[good]], 1), axis=0).reshape(-1, 3)
    # of several periods of one stretch the smallest counts
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :2] != found[:-1, :2]).any(1)
    start, end, d = found[first].T
    by = np.lexsort((d, start))
    return start[by], (end - start)[by], d[by]


def slice_runs(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs of each text of a slice, with starts counted in the words of the text."""
    start, end, first = word_spans(data, offsets)
    sizes = np.diff(first)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    long = np.flatnonzero(sizes >= LEAST_WORDS)
    if not len(long):
        return out
    code, values = dictionary(data, start, end)
    sizes = sizes[long]
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    n, text = int(base[-1]), np.repeat(np.arange(len(long)), sizes)
    inner = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seq = np.zeros(n, np.int64)
    seq[base[text] + inner] = text * np.int64(len(values)) + code[first[long][text] + inner] + 1
    left = np.zeros(n, np.int64)
    left[base[text] + inner] = sizes[text] - inner
    s, length, period = runs(seq, left)
    where = np.searchsorted(base, s, "right") - 1
    for t, a, b, c in zip(where.tolist(), (s - base[where]).tolist(), length.tolist(), period.tolist(), strict=True):
        out[long[t]].append((a, b, c))
    return out


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length and period in words, by start, then period) and collapsed: the words without any that a
    run holds after its first period, joined by one space."""
    schema = "doc_id long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def collapsed(raw: bytes, found: list[tuple[int, int, int]]) -> str:
        words = raw.split()
        if found:
            gone = np.zeros(len(words) + 1, np.int64)
            for start, length, period in found:
                gone[start + period] += 1
                gone[start + length] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0)]
        return b" ".join(words).decode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for a, z, data, offsets in slices(batch.column("text")):
                found = slice_runs(data, offsets)
                text = [collapsed(data[offsets[t]:offsets[t + 1]].tobytes(), found[t]) for t in range(z - a)]
                rows = [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in found]
                yield pa.RecordBatch.from_arrays([ids[a:z], pa.array(rows, pa.list_(triple)), pa.array(text, pa.string())], names=["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def planted(docs: DataFrame) -> DataFrame:
    """The contract's texts: where crc32(doc_id) ends in 0, the words from a place on repeat a few words; null ids stay as they are."""
    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        made = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, place(i).cast("int")))
        return F.when(n > 0, F.array_join(made, " ")).otherwise(F.lit(""))

    words = F.filter(F.split(F.col("text"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select("doc_id", F.when(h % 10 == 0, let(words, repeated)).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    # the greatest length / period by products, so exactly; runs are in the order of ties
    better = lambda best, r: F.when(best["start"].isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    none = F.struct(*[F.lit(None).cast("long").alias(c) for c in ("start", "length", "period")])
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    found = periodic_runs(planted(documents(spark, folder)))
    best = F.aggregate("runs", none, better)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
        F.sha2(F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    ).select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
SQL: dict[str, str] = {}
