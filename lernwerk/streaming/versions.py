"""Append-only versions of keyed states: a run of rows per micro-batch, merged in levels, newest version by key on read.

Batch ``b`` writes the states it changed as the run of batch ``b``; nothing is rewritten in place.  Every ``fanout`` runs of a
level become one run of the next, so a state is rewritten once per level and a read meets at most
``(fanout - 1) * log(batches)`` runs.  Which runs are live after ``n`` batches follows from ``n`` alone (its digits to the
base ``fanout``), so there is no manifest to lose: a batch that is replayed after a lost executor or driver reads the
same runs and writes the same rows, and a run whose writing broke off is built again from its parts.  Parts are deleted
two batches after they were merged.

With ``idle_us``, states whose last event is so much older than the newest one of a merge leave the merged run for the cold
part of the table, by bucket of their key.  A batch looks there only for keys that it did not find live, in the buckets
of those keys, so a late event finds its state and live runs hold what is in use.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Keys of a batch are broadcast when so many of them were counted at most.
BROADCAST_KEYS = 500_000


class Versions:
    """Rows with one row per key at ``path``; the column ``version`` is the batch that wrote them.

    ``spark`` is the session of the batch; ``schema`` is that of the rows.  ``time`` names the microseconds of a state's last
    event, needed with ``idle_us``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, fanout: int = 8, idle_us: int | None = None, time: str = "last_us", buckets: int = 64):
        self.spark, self.path, self.keys, self.fanout = spark, path, keys, fanout
        self.schema = f"{schema}, version long"
        self.idle_us, self.time, self.buckets = idle_us, time, buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())

    # which runs there are

    def runs(self, batches: int) -> list[tuple[int, int]]:
        """(first batch, number of batches) of the live runs after ``batches`` batches."""
        size, first, out = 1, 0, []
        while size * self.fanout <= batches:
            size *= self.fanout
        while size:
            while first + size <= batches:
                out.append((first, size))
                first += size
            size //= self.fanout
        return out

    def batches(self) -> int:
        """How many batches the table holds."""
        ends = [int(name.split("-")[1]) for name in self._names("live") if self._done(f"live/{name}")]
        return max(ends, default=-1) + 1

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._files.listStatus(at)] if self._files.exists(at) else []

    def _done(self, run: str) -> bool:
        return bool(self._files.exists(self._hadoop(f"{self.path}/{run}/_SUCCESS")))

    @staticmethod
    def _name(first: int, size: int) -> str:
        return f"{first:012d}-{first + size - 1:012d}"

    # writing

    def put(self, batch: int, rows: DataFrame) -> DataFrame:
        """``rows`` as the run of ``batch``, read back; older runs are merged where their level is full."""
        path = f"{self.path}/live/{self._name(batch, 1)}"
        rows.withColumn("version", F.lit(batch).cast("long")).write.mode("overwrite").parquet(path)
        for first, size in self.runs(batch + 1):
            self._ensure(first, size)
        self._forget(batch - 1)
        return self.spark.read.schema(self.schema).parquet(path)

    def _ensure(self, first: int, size: int) -> None:
        name = self._name(first, size)
        if self._done(f"live/{name}"):
            return
        if size == 1:
            raise ValueError(f"{self.path} holds no run of batch {first}; it belongs to another checkpoint")
        part = size // self.fanout
        parts = [(first + i * part, part) for i in range(self.fanout)]
        for run in parts:
            self._ensure(*run)
        merged = self._newest(self._read(parts))
        if self.idle_us is not None:
            newest = self._read(parts).agg(F.max(self.time)).first()[0]
            idle = F.coalesce(F.col(self.time) < (newest or 0) - self.idle_us, F.lit(False))
            cold = merged.where(idle).withColumn("bucket", self._bucket())
            cold.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/cold/{name}")
            merged = merged.where(~idle)
        merged.write.mode("overwrite").parquet(f"{self.path}/live/{name}")

    def _forget(self, batches: int) -> None:
        """Delete the runs that larger ones have replaced for a batch or more."""
        keep = self.runs(batches)
        for name in self._names("live"):
            low, high = map(int, name.split("-"))
            if any(first <= low and high < first + size and high - low + 1 < size for first, size in keep):
                self._files.delete(self._hadoop(f"{self.path}/live/{name}"), True)

    # reading

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/live/{self._name(*run)}" for run in runs])

    def _cold(self) -> Iterator[str]:
        return (f"{self.path}/cold/{name}" for name in self._names("cold") if self._done(f"cold/{name}"))

    def _newest(self, rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "version").alias("s")).select(*self.keys, "s.*")

    def current(self, batches: int | None = None) -> DataFrame:
        """The newest version of every key, live or cold."""
        batches = self.batches() if batches is None else batches
        if not batches:
            return self.spark.createDataFrame([], self.schema)
        rows = self._read(self.runs(batches))
        for path in self._cold():
            rows = rows.unionByName(self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).drop("bucket"))
        return self._newest(rows)

    def of(self, keys: DataFrame, batch: int) -> DataFrame | None:
        """The states that the distinct ``keys`` had before ``batch``; None before the first."""
        if not batch:
            return None
        keys = keys.select(*self.keys)
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
        found = self._newest(self._read(self.runs(batch)).join(keys, self.keys, "left_semi"))
        cold = list(self._cold())
        if not cold:
            return found
        rest = keys.join(found.select(*self.keys), self.keys, "left_anti").withColumn("bucket", self._bucket())
        touched = [r["bucket"] for r in rest.select("bucket").distinct().collect()]       # at most ``buckets`` numbers
        for path in cold:
            rows = self.spark.read.schema(f"{self.schema}, bucket int").parquet(path).where(F.col("bucket").isin(touched))
            found = found.unionByName(rows.join(rest.select(*self.keys), self.keys, "left_semi").drop("bucket"))
        return self._newest(found)
