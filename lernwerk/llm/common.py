"""What the operators share: tables in the shared folder, joins on checked sizes, components, vectorised text hashing."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

#: A side of a join is broadcast only when it was counted and has at most so many rows of a few numbers each.
BROADCAST_ROWS = 1_000_000


class Shared:
    """Tables in the folder of ``spark.checkpoint.dir``: they survive lost executors and cut lineage."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
        self.n = 0

    def put(self, df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
        """``df`` as a written table, read back with its own schema."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.partitionBy(*by).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._llm_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._llm_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        # shuffle files go when the driver's collector finds that nothing reads them
        jvm.System.gc()


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is (a shuffled join).

    ``df`` should be a written table: the count then reads no data."""
    return F.broadcast(df) if df.count() <= rows else df


def row_key(text: str = "text", doc_id: str = "doc_id") -> Column:
    """Names a row by its id and text, also where ids are null or repeated; equal rows share it."""
    return F.xxhash64(F.col(doc_id), F.col(text))


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``row_key`` is in ``gone``; its own columns stay aside, whatever their names."""
    rows = docs.select(F.struct("*").alias("row"), row_key().alias("row_key"))
    return rows.join(small(gone), "row_key", "left_anti").select("row.*")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over the batches of a task; what it freed goes back to the system when it ends.

    A Python worker outlives its task, and what its allocators keep would count against the executor in later stages."""

    def work(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return work


def components(edges: DataFrame, shared: Shared) -> DataFrame:
    """(node, root) for each node of ``edges(a, b)``; root is the smallest node that can be reached.

    Union-find in two steps: each task replaces its own edges by a star forest (its memory is bounded by its
    share of the edges), then rounds of large-star and small-star (aggregates and joins only) contract what
    the tasks found until nothing changes.  A hub costs one row per task in the aggregates.
    """
    schema = edges.select("a", "b").schema

    def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        kind = None
        for batch in batches:
            kind = batch.schema
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        if kind is not None:
            rest = [x for x in parent if root(x) != x]
            for at in range(0, len(rest), 100_000):
                part = rest[at:at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, kind.field(0).type), pa.array([root(x) for x in part], kind.field(1).type)], names=["a", "b"])

    # a > b throughout
    now = shared.put(edges.select("a", "b").mapInArrow(releasing(forest), schema).distinct())
    state = None
    while True:
        both = now.select(F.col("a").alias("node"), F.col("b").alias("near")).union(now.select(F.col("b").alias("node"), F.col("a").alias("near")))
        low = both.groupBy("node").agg(F.least("node", F.min("near")).alias("m"))
        large = both.where("near > node").join(low, "node").select(F.col("near").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = shared.put(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small_star = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = shared.put(small_star)
        shared.drop(now, large)
        now = after
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == state:
            break
        state = tuple(seen)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


# ---- vectorised work on the bytes of Arrow string columns (inside tasks)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229).integers(0, 1 << 64, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[int, np.ndarray] = {}


def _power_table(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = np.empty(size, np.uint64)
        have[0], done = 1, 1
        while done < size:
            have[done:2 * done] = have[:done] * np.uint64(pow(base, done, 1 << 64))
            done *= 2
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span, by one running sum over ``data``."""
    n = len(data)
    table = _RANDOM[_LOWER] if lower else _RANDOM
    base, back = int(_BASE), pow(int(_BASE), -1, 1 << 64)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(table[data] * _power_table(max(n, 1), base)[:n], out=total[1:])
    size = (end - start).astype(np.uint64)
    return mix((total[end] - total[start]) * _power_table(n + 1, back)[start] + size * np.uint64(0xD6E8FEB86659FD93))


def spaces(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def slices(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of whole texts of about ``most`` bytes; a null is empty."""
    column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to, data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words `[^\\x20\\x09-\\x0D]+`, and where each text's words begin (one more at the end)."""
    n = len(data)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | cut[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word windows of one text; of the whole sequence if it has fewer words; empty without words."""
    n = len(words)
    if not n:
        return words
    k = min(n, k)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + words[j:n - k + 1 + j]
    return mix(out)


def dictionary(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """The spans data[start:end], in order and apart, as codes into their different values (an exact table, no hashes)."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[start] += 1
    inside[end] -= 1
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    held = pa.py_buffer(np.ascontiguousarray(data[np.cumsum(inside[:-1], dtype=np.int8).astype(bool)]))
    coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), held]).dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary
