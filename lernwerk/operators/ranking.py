"""Row numbers over whole tables or hot keys, without one task seeing them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut

SMALL = 200_000      # rows one task may number by itself


def global_rank(df: DataFrame, order: list[Column], out: str, rows: int | None = None) -> DataFrame:
    """``df`` with the 0-based position of each row in the total order ``order``.

    Range partitioning sorts the table over all tasks; a row's position is its index inside its
    partition plus the size of the partitions before it.  The sorted rows are checkpointed, so that the
    partition sizes and the rows come from the same split.  Only one number per partition is broadcast.
    Inputs known to be small (``rows``) take a plain window.
    """
    rows = df.count() if rows is None else rows
    if rows <= SMALL:
        return df.withColumn(out, (F.row_number().over(W.orderBy(*order)) - 1).cast("long"))
    parts = max(2, rows // SMALL + 1)
    # the row's place as Spark deals it out; its name meets neither ``out`` nor a column of ``df``
    at = next(name for n in range(len(df.columns) + 2) if (name := f"_place{n}") != out and name not in df.columns)
    placed = cut(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    )
    part, i = F.shiftright(at, 33), F.col(at) % 2 ** 33
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offset = sizes.select(F.struct("part", F.coalesce(before, F.lit(0)).alias("rows")).alias(f"{at}_off"))
    joined = placed.join(F.broadcast(offset), part == F.col(f"{at}_off.part"))
    return joined.withColumn(out, F.col(f"{at}_off.rows") + i).drop(at, f"{at}_off")
