"""Toxicity by subword-bag embeddings and a linear softmax (operator 1).

A text is cut into words (runs of letters, digits and bytes of other scripts, A-Z lower-cased); a word is the bag of
its character n-grams with its borders, hashed into buckets, so unseen misspellings and inflections share vectors with
known words.  A passage of ``WINDOW`` words is the average of its n-gram vectors, and a linear softmax over two
classes scores it.  Vectors and softmax are trained jointly in numpy on a bounded sample of labelled rows: at most
``TRAIN_DOCS`` toxic and four times as many other documents, texts of at most ``TRAIN_CHARS`` characters first, in the
order of a hash of the id.  Of longer ones, where there are too few others, the model learns from ``LONG_PIECES``
stretches of ``TRAIN_CHARS`` characters spread over the text, as one bag; a class gives at most ``TRAIN_CHARS``
characters a document in all, rounded up to whole documents.  A toxic document is a bag of passages of which some are toxic: each round keeps as
positive only those that the round before found.  A text's score is that of its worst passage, with any start, so it
does not depend on the text's length; a logistic curve fitted on the sample turns it into a probability.

For prediction a bucket's vector and the softmax are one number, so tasks get one small array.

Defined results: a null or empty text, or one without words, scores 0; without labelled rows of both classes all
scores are 0; several labels of one id count as toxic if any is; equal rows get equal scores; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from .common import documents, slices

GRAMS = (3, 4, 5)
BUCKETS = 1 << 17
WIDTH = 8
WINDOW = 8
TRAIN_DOCS = 1000
TRAIN_CHARS = 5_000
LONG_PIECES = 8
ROUNDS, EPOCHS, STEPS, BATCH, RATE = 3, 3, 150, 4096, 0.6
THRESHOLD = 0.3
HELD_OUT = 2  # of crc32(doc_id) mod 4

_FOLD = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _FOLD[_a:_b] = np.arange(_a, _b)
_FOLD[65:91] = np.arange(97, 123)


def gram_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram, word of each n-gram, first word of each text and one more)."""
    texts = len(offsets) - 1
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    padded = np.full(len(data) + texts + 2 + max(GRAMS), 32, np.uint8)
    padded[np.arange(len(data)) + owner + 1] = _FOLD[data]
    inside = padded != 32
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    word_at = np.cumsum(head) - 1
    starts = np.flatnonzero(head)
    cut = np.searchsorted(starts, offsets + np.arange(texts + 1))
    space = np.flatnonzero(~inside)
    n = len(padded) - max(GRAMS)
    # the place of the next space from each place on
    following = space[np.searchsorted(space, np.arange(1, n + 1))]
    code = padded[:n].astype(np.uint32)
    place = np.arange(n)
    ids, words = [], []
    for size in range(2, max(GRAMS) + 1):
        code = code * np.uint32(0x01000193) + padded[size - 1:size - 1 + n]
        if size in GRAMS:
            ok = np.flatnonzero((following >= place + size - 1) & inside[1:n + 1])
            h = code[ok] * np.uint32(0x9E3779B1) + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            ids.append((h >> np.uint32(32 - 17)).astype(np.int32))
            words.append(word_at[ok + 1])
    return np.concatenate(ids), np.concatenate(words), cut


class Bags:
    """Passages as bags of buckets: ``ids`` of all, where each begins, and the text each belongs to."""

    def __init__(self, texts: list[str]):
        ids, begins, owners, base = [], [], [], 0
        for first, last, data, offsets in slices(pa.array(texts, pa.string())):
            gram, word, cut = gram_ids(data, offsets)
            text = np.repeat(np.arange(last - first), np.diff(cut))
            within = np.arange(len(text)) - np.repeat(cut[:-1], np.diff(cut))
            passage_of_word = np.cumsum(within % WINDOW == 0) - 1
            passage = passage_of_word[word]
            order = np.argsort(passage, kind="stable")
            heads = np.flatnonzero(np.diff(passage[order], prepend=-1))
            ids.append(gram[order])
            begins.append(heads + base)
            owners.append(text[within % WINDOW == 0][passage[order][heads]] + first)
            base += len(gram)
        self.ids, self.begin, self.owner = np.concatenate(ids), np.concatenate(begins), np.concatenate(owners)
        self.size = np.diff(np.append(self.begin, base))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.size[which]
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        at = np.arange(size.sum()) - np.repeat(begin, size) + np.repeat(self.begin[which], size)
        return self.ids[at], begin, size


class Model:
    """Embeddings (buckets x width) and softmax (width x 2), trained jointly by AdaGrad."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.rng = rng
        self.e = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
        self.w = rng.uniform(-1, 1, (WIDTH, 2)).astype(np.float32)
        self.b = np.zeros(2, np.float32)
        self.ge, self.gw, self.gb = np.full_like(self.e, 1e-6), np.full_like(self.w, 1e-6), np.full_like(self.b, 1e-6)

    def step(self, ids: np.ndarray, begin: np.ndarray, size: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        mean = np.add.reduceat(self.e[ids], begin, axis=0) / size[:, None]
        z = mean @ self.w + self.b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = p
        g[np.arange(len(y)), y] -= 1
        g *= weight[:, None] / len(y)
        # every n-gram of a passage moves along the same direction, so one number per bucket and class is enough
        share = g[:, 1] / size
        pull = np.bincount(ids, np.repeat(share, size), BUCKETS).astype(np.float32)
        de = pull[:, None] * (self.w[:, 1] - self.w[:, 0])[None, :] * len(y)
        touched = np.flatnonzero(pull)
        de = de[touched]
        for value, total, grad in ((self.w, self.gw, mean.T @ g), (self.b, self.gb, g.sum(0))):
            total += grad * grad
            value -= RATE * grad / np.sqrt(total)
        self.ge[touched] += de * de
        self.e[touched] -= RATE * de / np.sqrt(self.ge[touched])

    def table(self) -> tuple[np.ndarray, float]:
        w = self.w[:, 1] - self.w[:, 0]
        return (self.e @ w).astype(np.float32), float(self.b[1] - self.b[0])


def worst(table: np.ndarray, bias: float, gram: np.ndarray, word: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The highest logit of each text's windows of words; minus infinity without words."""
    n = int(cut[-1])
    total = np.concatenate([[0], np.cumsum(np.bincount(word, table[gram], n))])
    count = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])
    out = np.full(len(cut) - 1, -np.inf)
    if not n:
        return out
    end = np.repeat(cut[1:], np.diff(cut))
    start = np.arange(n)
    start = np.maximum(np.minimum(start, end - WINDOW), np.repeat(cut[:-1], np.diff(cut)))
    stop = np.minimum(start + WINDOW, end)
    z = (total[stop] - total[start]) / np.maximum(count[stop] - count[start], 1) + bias
    full = np.flatnonzero(np.diff(cut))
    out[full] = np.maximum.reduceat(z, cut[full])
    return out


def train(texts: list[str], toxic: list[int]) -> tuple[np.ndarray, float, float, float]:
    """(bucket scores, bias, slope, intercept); the last two turn a text's worst logit into a probability's logit."""
    bags, label = Bags(texts), np.array(toxic)
    y = label[bags.owner]
    use = np.arange(len(y))
    for turn in range(ROUNDS):
        model = Model()
        rng = np.random.default_rng(turn)
        positive = max(1, int(y[use].sum()))
        balance = min(20.0, max(1.0, (len(use) - positive) / positive * 0.5))
        # small samples take smaller steps and more turns
        size = min(BATCH, max(128, len(use) // 32))
        for _ in range(max(EPOCHS, STEPS * size // len(use))):
            order = rng.permutation(use)
            for at in range(0, len(order), size):
                part = order[at:at + size]
                model.step(*bags.take(part), y[part], np.where(y[part] == 1, balance, 1.0).astype(np.float32))
        table, bias = model.table()
        z = np.add.reduceat(table[bags.ids], bags.begin) / bags.size + bias
        top = np.full(len(label), -np.inf)
        np.maximum.at(top, bags.owner, z)
        # of a toxic text: its worst passage, and all that look toxic
        # of the others the quarter that looks most toxic, and as many at random
        found = (y == 1) & ((z >= top[bags.owner]) | (z > np.maximum(0, top[bags.owner] / 2)))
        hard = (y == 0) & ((z > np.quantile(z[y == 0], 0.75)) | (rng.random(len(y)) < 0.25))
        use = np.flatnonzero(found | hard)
    x = np.concatenate([worst(table, bias, *gram_ids(d, o)) for _, _, d, o in slices(pa.array(texts, pa.string()))])
    fine = np.isfinite(x)
    x, t = np.clip(x[fine], -30, 30), label[fine].astype(float)
    # targets short of 0 and 1 keep the curve finite where the classes are apart
    t = np.where(t == 1, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + shift, -30, 30)))
        h = p * (1 - p) + 1e-9
        a = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
        move = np.linalg.solve(a, np.array([((t - p) * x).sum(), (t - p).sum()]))
        slope, shift = slope + move[0], shift + move[1]
        if np.abs(move).max() < 1e-8:
            break
    return table, bias, float(slope), float(shift)


def held_out() -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == HELD_OUT, F.lit(False))


def _stretches(text: Column) -> Column:
    """A text of up to ``TRAIN_CHARS`` characters itself, else stretches of as many spread from its start to its end."""
    size = F.length(text)
    n = F.least(F.lit(LONG_PIECES), F.ceil(size / TRAIN_CHARS)).cast("int")
    begin = lambda i: F.floor(i * (size - TRAIN_CHARS) / (n - 1)).cast("int") + 1
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, begin(i), F.lit(TRAIN_CHARS)))
    return F.when(size <= TRAIN_CHARS, text).otherwise(F.array_join(pieces, "\n"))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the bounded sample that the model learns from."""
    own = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out())
    # ids and lengths first: the texts are fetched by a join with at most a few thousand rows
    order = F.xxhash64("doc_id")
    sizes = docs.select("doc_id", (F.length("text") > TRAIN_CHARS).alias("long")).where("long is not null").join(own, "doc_id").groupBy("doc_id", "toxic").agg(F.min("long").alias("long"))
    some = sizes.where("toxic = 1").orderBy("long", order).limit(2 * TRAIN_DOCS).union(sizes.where("toxic = 0").orderBy("long", order).limit(8 * TRAIN_DOCS))
    rows = docs.select("doc_id", "text", (F.length("text") > TRAIN_CHARS).alias("long")).where("text <> ''").join(F.broadcast(some.select("doc_id", "toxic")), "doc_id")
    parts = []
    for toxic, most in ((1, TRAIN_DOCS), (0, 4 * TRAIN_DOCS)):
        first = rows.where(F.col("toxic") == toxic).orderBy("long", order, "text").limit(most).withColumn("text", _stretches(F.col("text")))
        before = F.sum(F.length("text")).over(W.orderBy("long", order, "text").rowsBetween(W.unboundedPreceding, -1))  # of at most ``most`` rows
        parts.append(first.withColumn("before", before).where(F.coalesce("before", F.lit(0)) < most * TRAIN_CHARS).select("text", "toxic"))
    return parts[0].union(parts[1])


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    spark = docs.sparkSession
    rows = sample(docs, labels).toPandas()
    toxic = [int(x) for x in rows["toxic"]]
    learned = spark.sparkContext.broadcast(train(list(rows["text"]), toxic) if 0 < sum(toxic) < len(toxic) else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            if learned.value is not None:
                table, bias, slope, shift = learned.value
                for first, last, data, offsets in slices(batch.column("text")):
                    z = worst(table, bias, *gram_ids(data, offsets))
                    p = 1 / (1 + np.exp(-np.clip(slope * np.clip(z, -30, 30) + shift, -30, 30)))
                    out[first:last] = np.where(np.isfinite(z), p, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(out), pa.array((out >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return scores(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


QUERIES = {"op1_toxicity": op1_toxicity}
SQL: dict[str, str] = {}
