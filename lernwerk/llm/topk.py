"""Exact top-k search by tiled matrix products (operator 7).

Candidates are packed into shards and queries into blocks of a bounded number of vectors.  A tile is a shard and a
block: one matrix product, then partial selection of the k best of each query.  A shard is copied once per block of
queries, so what moves is shards x blocks.  The lists of a query's tiles are merged in a tree: groups of
``FAN`` lists, then groups of those, each merge with at most FAN * k entries.

Scores are integer inner products of floor(1024 * x).  A tile multiplies in double precision where the largest
possible sum stays below 2**53, else in Python integers, so scores are exact; a score beyond 64 bits is an error.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor do rows without
an id; a query meets only vectors of its own length and never rows of its own id; repeated rows of other ids are
results of their own; without queries or candidates the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import Shared

K = 10
SCALE = 1024
EVERY = 100
SHARD, BLOCK = 4096, 1024  # vectors
FAN = 16


def _usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & finite


def packed(rows: DataFrame, per: int, shared: Shared) -> DataFrame:
    """(pack, dim, ids, values): at most about ``per`` vectors in each pack, values as little-endian doubles in row order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            size = np.diff(lists.offsets.to_numpy())
            values = np.floor(lists.values.to_numpy(zero_copy_only=False).astype(np.float64)[lists.offsets[0].as_py():] * SCALE)
            begin = np.concatenate([[0], np.cumsum(size)])
            ids = batch.column("vec_id").to_numpy()
            for dim in np.unique(size):
                rows_of = np.flatnonzero(size == dim)
                for at in range(0, len(rows_of), per):
                    part = rows_of[at:at + per]
                    m = values[begin[part][:, None] + np.arange(dim)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(dim)], pa.int32()), pa.array([ids[part].tolist()], pa.list_(pa.int64())), pa.array([m.astype("<f8").tobytes()], pa.binary())], names=["dim", "ids", "m"])

    vec = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    # batches of one partition become packs, so partitions are dealt out evenly first
    return shared.put(vec.mapInArrow(run, "dim int, ids array<long>, m binary").withColumn("pack", F.monotonically_increasing_id()))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of whole numbers held as doubles."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.array([[int(x) for x in r] for r in a], object) @ np.array([[int(x) for x in r] for r in b], object).T
    return exact.astype(np.int64)


def _tiles(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                q_ids, c_ids = (batch.column(c)[i].values.to_numpy() for c in ("q_ids", "ids"))
                q, c = (np.frombuffer(batch.column(x)[i].as_buffer(), "<f8").reshape(-1, dim) for x in ("q_m", "m"))
                score = _product(q, c)
                rows, ids, values = [], [], []
                for j in range(len(q_ids)):
                    other = np.flatnonzero(c_ids != q_ids[j])
                    s = score[j, other]
                    if len(s) > k:
                        bar = np.partition(s, len(s) - k)[len(s) - k]
                        other, s = other[s >= bar], s[s >= bar]  # ties at the bar stay until the ids decide
                    best = np.lexsort((c_ids[other], -s.astype(object) if s.min(initial=0) == np.iinfo(np.int64).min else -s))[:k]
                    rows += [q_ids[j]] * len(best)
                    ids += c_ids[other][best].tolist()
                    values += s[best].tolist()
                tile = batch.column("pack")[i].as_py()
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([tile] * len(rows), pa.int64()), pa.array(ids, pa.int64()), pa.array(values, pa.int64())], names=["query_id", "tile", "vec_id", "score"])

    return run


def _merged(lists: DataFrame, k: int) -> DataFrame:
    """The k best of the rows of each (query_id, query, tile)."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k)
    return lists.groupBy("query_id", "tile").agg(best.alias("b"))


def top_k(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each query; both have (vec_id, embedding)."""
    spark = rows.sparkSession
    shared = Shared(spark)
    ok = lambda df: df.where(F.col("vec_id").isNotNull() & _usable(F.col("embedding")))
    cores = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = packed(ok(rows), SHARD, shared)
    blocks = packed(ok(queries).repartition(1) if queries.limit(BLOCK + 1).count() <= BLOCK else ok(queries), BLOCK, shared)
    blocks = blocks.select("dim", F.col("pack").alias("block"), F.col("ids").alias("q_ids"), F.col("m").alias("q_m"))
    names = shared.put(blocks.groupBy("dim").agg(F.collect_list("block").alias("blocks")))  # a number per block
    pairs = shards.join(F.broadcast(names), "dim").withColumn("block", F.explode("blocks")).drop("blocks")
    tiles = pairs.repartition(cores, "pack", "block").join(blocks.drop("dim"), "block")
    lists = tiles.select("dim", "pack", "q_ids", "q_m", "ids", "m").mapInArrow(_tiles(k), "query_id long, tile long, vec_id long, score long")
    # a number for each shard, so that the tree's groups are even
    lists = shared.put(lists)
    count = shards.count()
    numbers = lists.withColumn("tile", F.pmod(F.xxhash64("tile"), F.lit(max(1, -(-count // FAN)))))
    width = max(1, -(-count // FAN))
    merged = _merged(numbers, k)
    while width > 1:
        width = -(-width // FAN)
        flat = merged.select("query_id", F.pmod(F.xxhash64("tile", F.lit(width)), F.lit(width)).alias("tile"), F.explode("b").alias("e"))
        merged = _merged(flat.select("query_id", "tile", (-F.col("e.s")).alias("score"), "e.vec_id"), k)
    return merged.select("query_id", F.posexplode("b").alias("at", "e")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), (-F.col("e.s")).alias("score")
    )


def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select(F.col("vec_id").cast("long"), "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0).distinct())


QUERIES = {"op7_topk": op7_topk}
SQL = {"op7_topk": """
with v as (
  select vec_id, [floor(1024 * x::double)::hugeint for x in embedding] e from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len([x for x in embedding if x is not null and isfinite(x)]) = len(embedding)),
s as (
  select q.vec_id query_id, c.vec_id, list_sum([p[1] * p[2] for p in list_zip(q.e, c.e)]) score
  from (select distinct * from v where vec_id % 100 = 0) q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) rank from s)
select query_id, rank::int rank, vec_id, score::bigint score from r where rank <= 10
"""}
