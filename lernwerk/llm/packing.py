"""Packing of token sequences in the order of a space-filling curve (operator 11).

Each document becomes token ids (the tokenizers library, a piece between white space at a time, as no token reaches over
white space) and a last id.  Its token buckets, weighted by the logarithm of their counts, form a hashed vector that a
fixed random matrix projects to four numbers.  These are scaled by their mean and spread over all documents and turned
into a place along a Hilbert curve, so that documents of like content get near keys.  Documents are range-sorted by that key
and laid end to end; sequence k holds the tokens from ``k * size`` on.  So every sequence but the last is full, and a
sequence holds neighbours along the curve.  What remains at the end is cut into pieces whose sizes are powers of two,
which need no padding either.

Only per-partition totals leave the tasks; a hot text is spread by doc_id, as the key alone does not order it.  Defined
results: a null or empty text is the last id alone; null ids sort first; repeated rows are packed each; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from .bpe import word_file
from .common import Shared, dictionary, documents, mix, slices, spaces

SIZE, END = 2_048, 1
#: Numbers a document is projected to, bits of each along the curve, and buckets of its hashed vector.
AXES, BITS, BUCKETS = 4, 10, 1_024
#: Pieces whose ids a task keeps; it starts anew beyond that.
CACHE = 1_000_000
#: A range of the sorted documents holds about so many bytes of ids.
RANGE_BYTES = 32 << 20

_LETTER = np.array([chr(b).isalpha() and b < 128 for b in range(256)])
_STOP = np.array([b in b".,;:!?" for b in range(256)])


class Pieces:
    """Token ids of pieces without white space, kept for the next call.  The file must lower texts and drop white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.loads(self.tokenizer.to_str())
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        suffix = spec["model"].get("end_of_word_suffix")
        if "Lowercase" not in steps or not suffix:
            raise ValueError(f"{path} does not lower texts or mark the ends of words")
        n = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        self.last = np.zeros(n, bool)
        self.last[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(suffix)]] = True
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.ends = np.zeros(1, np.int64)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        # letters alone are one word of the file, so their tokens end where a word's last token stands: one text for all
        texts = [p.decode() for p in new]
        whole = [p.isalpha() and p.lower().isalpha() for p in texts]
        plain, other = [p for p, w in zip(new, whole, strict=True) if w], [p for p, w in zip(new, whole, strict=True) if not w]
        tokens = np.array(self._encode([" ".join([t for t, w in zip(texts, whole, strict=True) if w])])[0], np.int32)
        ends = np.flatnonzero(self.last[tokens]) + 1
        if len(ends) != len(plain):
            # letters that only one of the two libraries knows
            tokens, ends, plain, other, whole = tokens[:0], ends[:0], [], new, [False] * len(new)
        rest = self._encode([t for t, w in zip(texts, whole, strict=True) if not w])
        tail = np.fromiter((i for ids in rest for i in ids), np.int32)
        more = len(tokens) + np.cumsum(np.fromiter(map(len, rest), np.int64, len(rest)))
        for piece in (*plain, *other):
            self.known[piece] = len(self.known)
        self.ends = np.concatenate([self.ends, len(self.flat) + ends, len(self.flat) + more])
        self.flat = np.concatenate([self.flat, tokens, tail])

    def numbers(self, pieces: list[bytes]) -> np.ndarray:
        """The number of each piece: piece k has the ids flat[ends[k]:ends[k + 1]]."""
        for _ in range(2):
            at = np.fromiter(map(self.known.get, pieces, repeat(-1)), np.int64, len(pieces))
            new = [pieces[i] for i in np.flatnonzero(at < 0)]
            if not new:
                break
            if len(self.known) + len(new) > CACHE:
                self._forget()
                new = pieces
            self._learn(new)
        return np.fromiter(map(self.known.get, pieces), np.int64, len(pieces)) if new else at


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(1)
def directions() -> np.ndarray:
    """The fixed projection: a row of AXES numbers per bucket."""
    return np.random.default_rng(11).standard_normal((BUCKETS, AXES))


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """The slice's bytes with letters lowered, and spans that encode apart: starts, ends, where each text's spans begin.

    Words between white space are parted further between an ASCII letter and one of ``.,;:!?``, where no token reaches
    over.  Lowering here only makes fewer different spans; a letter before a non-ASCII byte (it may combine) and a slice
    that may hold special tokens are left to the library."""
    n = len(data)
    letter, stop = _LETTER[data], _STOP[data]
    if b"<|" not in data.tobytes():
        plain = np.ones(n, bool)
        plain[:-1] = data[1:] < 128
        data = np.where(letter & plain, data | 32, data)
    word = ~spaces(data)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[1:n] |= letter[1:] & stop[:-1] | stop[1:] & letter[:-1]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1] | cut[1:n]
    end[:-1] &= ~word[1:] | cut[1:n]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return data, start, end, np.searchsorted(start, offsets)


def slice_ids(data: np.ndarray, offsets: np.ndarray, encoder: Pieces, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of a slice's texts with ``end`` after each text, and where each text's ids begin (one more at the end)."""
    data, first, last, text = spans(data, offsets)
    code, values = dictionary(data, first, last)
    number = encoder.numbers(values.to_pylist())[code] if len(code) else np.zeros(0, np.int64)
    begin, n = encoder.ends[number], encoder.ends[number + 1] - encoder.ends[number]
    before = np.concatenate([[0], np.cumsum(n)])
    source = np.repeat((begin - before[:-1]).astype(np.int32), n)
    source += np.arange(len(source), dtype=np.int32)
    # one more id per text
    tokens = before[text] + np.arange(len(text))
    out = np.full(tokens[-1], end, np.int32)
    inside = np.ones(len(out), bool)
    inside[tokens[1:] - 1] = False
    out[inside] = encoder.flat[source]
    return out, tokens


@lru_cache(1)
def buckets(n: int) -> np.ndarray:
    """The bucket of each of ``n`` ids."""
    return (mix(np.arange(n, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int32)


def vectors(ids: np.ndarray, tokens: np.ndarray, known: int) -> np.ndarray:
    """The projected hashed vector of each text; ``known`` is the size of the vocabulary."""
    n = len(tokens) - 1
    kind = np.int32 if n * BUCKETS < 1 << 31 else np.int64
    cell = np.repeat(np.arange(n, dtype=kind) * BUCKETS, np.diff(tokens))
    cell += buckets(known)[ids]
    cell.sort()
    head = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    cell, count = cell[head], np.diff(np.append(head, len(cell)))
    weight, text = np.log1p(count), cell // BUCKETS
    norm = np.sqrt(np.bincount(text, weight * weight, n))
    row = directions()[cell % BUCKETS]
    total = np.stack([np.bincount(text, weight * row[:, a], n) for a in range(AXES)], 1)
    return total / norm[:, None]


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place of each cell (a row of whole numbers below 2**bits) along the Hilbert curve through all cells.

    Skilling's transform (2004): undo the turns from the highest bit down, Gray-decode across the axes, interleave."""
    x = [c.astype(np.int64) for c in cells.T]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(len(x)):
            turned = x[i] >> b & 1 == 1
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] >> b & 1 == 1, (1 << b) - 1, 0)
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for axis in x:
            key = key << 1 | (axis ^ flip) >> b & 1
    return key


def tokenised(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, ids (bytes of the smallest unsigned numbers that hold the vocabulary), tokens, p0 .. of each row."""
    schema = "doc_id long, ids binary, tokens long, " + ", ".join(f"p{a} double" for a in range(AXES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = pieces(path)
        for batch in batches:
            rows = batch.column("doc_id")
            for a, z, data, offsets in slices(batch.column("text"), 1 << 23):
                ids, tokens = slice_ids(data, offsets, encoder, end)
                at = vectors(ids, tokens, len(encoder.last))
                raw, width = ids.astype(encoder.kind).tobytes(), encoder.kind.itemsize
                cuts = (tokens * width).tolist()
                held = [raw[s:e] for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows[a:z], pa.array(held, pa.binary()), pa.array(np.diff(tokens)), *[pa.array(np.ascontiguousarray(c)) for c in at.T]],
                    names=["doc_id", "ids", "tokens", *[f"p{i}" for i in range(AXES)]],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def along_curve(rows: DataFrame) -> DataFrame:
    """``rows`` with ``key``, their place along the curve through the cells of their scaled vectors."""
    axes = [f"p{a}" for a in range(AXES)]
    spread = rows.agg(*[F.struct(F.avg(a), F.stddev_pop(a)) for a in axes]).first()
    mean = np.array([s[0] or 0.0 for s in spread])
    width = np.array([s[1] or 1.0 for s in spread])

    @F.pandas_udf("long")
    def key(p0: pd.Series, p1: pd.Series, p2: pd.Series, p3: pd.Series) -> pd.Series:
        z = (np.stack([p0, p1, p2, p3], 1) - mean) / width
        share = 1 / (1 + np.exp(-1.702 * np.clip(z, -20, 20)))
        return pd.Series(hilbert(np.minimum((share * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)))

    return rows.withColumn("key", key(*axes)).drop(*axes)


def cuts(total: int, size: int) -> tuple[int, np.ndarray]:
    """How many sequences are full, and where the powers of two that hold the rest begin (one more at the end)."""
    full, rest = divmod(total, size)
    parts = [1 << b for b in reversed(range(size.bit_length())) if rest >> b & 1]
    return full, full * size + np.concatenate([[0], np.cumsum(parts, dtype=np.int64)]).astype(np.int64)


def pack(docs: DataFrame, shared: Shared, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The pieces of all documents: doc_id, start (its document's ids before it), length, ids (little-endian 32-bit numbers, as
    a token file holds them), doc_tokens, sequence_id, offset (in its sequence)."""
    kind = pieces(path).kind
    rows = shared.put(tokenised(docs, path, end))
    total = rows.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    spark = docs.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, total * kind.itemsize // RANGE_BYTES + 1)
    order = ["key", "doc_id", F.xxhash64("ids")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column("tokens").to_numpy()
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("ids"), batch.column("tokens"), pa.array(np.full(len(n), part, np.int32)), pa.array(at)],
                names=["doc_id", "ids", "tokens", "part", "at"],
            )

    ranged = along_curve(rows).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = shared.put(ranged.mapInArrow(place, "doc_id long, ids binary, tokens long, part int, at long"))
    shared.drop(rows)
    sizes = placed.groupBy("part").agg(F.sum("tokens").alias("n"))
    earlier = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    # one row per range
    whole = placed.join(F.broadcast(earlier), "part").select("doc_id", "ids", "tokens", (F.col("at") + F.col("earlier")).alias("at"))
    full, rest = cuts(total, size)
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            held = 0
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for doc, ids, n, at in zip(*[batch.column(c) for c in ("doc_id", "ids", "tokens", "at")], strict=True):
                doc, n, at = doc.as_py(), n.as_py(), at.as_py()
                ids, begin = np.frombuffer(ids.as_buffer(), kind), 0
                while begin < n:
                    place = at + begin
                    if place < full * size:
                        seq, inner = divmod(place, size)
                        until = size - inner
                    else:
                        k = int(np.searchsorted(rest, place, "right")) - 1
                        seq, inner, until = full + k, place - int(rest[k]), int(rest[k + 1]) - place
                    length = min(until, n - begin)
                    row = doc, begin, length, ids[begin:begin + length].astype("<u4").tobytes(), n, seq, inner
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    begin += length
                    held += length
                if held > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)
                    out, held = [[] for _ in names], 0
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return whole.mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op11_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack(documents(spark, folder), Shared(spark), word_file())
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op11_packing": op11_packing}
SQL: dict[str, str] = {}
