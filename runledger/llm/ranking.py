"""Numbers of rows in a total order, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.session import stage

_ROW_BITS = 33


def positions(df: DataFrame, order: Sequence[str | Column], name: str) -> tuple[DataFrame, int]:
    """``df`` with the place of each row in ``order``, from 0, and the number of rows.

    Rows are range-partitioned, sorted and written once; a row's place is its place in
    its range plus the rows of the ranges before. Only the ranges' counts, one row per
    shuffle partition, meet in one task. Equal keys fall into one range, so ``order``
    should end in columns that tell rows apart.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranges")
    part = F.shiftrightunsigned("__at", _ROW_BITS)
    within = F.col("__at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    counts = stage(counts, "counts")
    total = counts.agg(F.coalesce(F.sum("__n"), F.lit(0))).first()[0]
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__from"))
    numbered = placed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    return numbered.withColumn(name, F.col("__from") + within).drop("__at", "__part", "__from"), total
