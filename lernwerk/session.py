"""Session helpers: configuration for local runs and lineage cutting on any cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "lernwerk", memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark.  On a cluster, use the session you are given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.log.level", "ERROR")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp")))
    )
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; one is chosen only in local mode when it is unset."""
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the checkpoint folder and read it back.

    The table survives lost executors and has no lineage.  Unlike a checkpointed plan it also carries no
    inferred constraints, which multiply from round to round of an iterative operator, and it knows its
    size, so later joins are planned on real numbers.
    """
    return Parts(df.sparkSession).add(df)


class Parts:
    """A table that grows by written parts and is read in one scan, however many there are."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.schema = spark, [], None

    def add(self, df: DataFrame) -> DataFrame:
        """Write ``df`` as a part and read that part back."""
        path = f"{ensure_checkpoint_dir(self.spark)}/cut-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths.append(path)
        self.schema = self.schema or df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def table(self) -> DataFrame | None:
        return self.spark.read.schema(self.schema).parquet(*self.paths) if self.paths else None


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores when the input has fewer partitions than the cluster has cores.

    Meant for text-heavy work on a table that arrives in a few files; a large table passes unchanged.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
