"""Ranks over a whole table without one task that sorts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.session import materialise

_BITS = 33  # of the number within a partition, in monotonically_increasing_id()


def global_rank(df: DataFrame, *order: Column, name: str = "pos") -> DataFrame:
    """df with each row's place (from 1) in the order.

    Rows are range-partitioned, sorted and numbered by partition, and written; the partitions' counts, a row each, give the offsets.
    """
    numbered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows, _ = materialise(numbered, "ranked")
    part = F.shiftright("_id", _BITS)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    out = rows.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND((1 << _BITS) - 1) + 1).select(*df.columns, name)
