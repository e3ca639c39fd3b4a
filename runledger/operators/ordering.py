"""Positions in a total order, without a task that sees a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.session import stage


def cluster_by_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Range-partition and sort by ``columns``, with the range's number as ``range_id``.

    The number of ranges is the session's number of shuffle partitions; AQE joins
    neighbouring ones that turn out small, which keeps their order.
    """
    ranged = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return ranged.withColumn("range_id", F.spark_partition_id())


def ordered_positions(
    df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str = "position"
) -> DataFrame:
    """Number the rows of each group in ``order`` from 0.

    The rows are range-partitioned on group and order, sorted and written once; a range
    then holds a bounded stretch of a group, however large the group is. A row's number is
    its distance from the first row of its stretch, which needs no further sort, plus the
    lengths of the stretches before. ``groups`` with ``order`` must identify a row.
    """
    ranged = cluster_by_range(df, [*groups, *order])
    placed = stage(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    before = W.partitionBy(*groups).orderBy("range_id").rowsBetween(W.unboundedPreceding, -1)
    stretches = placed.groupBy(*groups, "range_id").agg(
        F.count("*").alias("_n"), F.min("_at").alias("_first")
    )
    stretches = stretches.select(
        *groups, "range_id", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    place = (F.col("_before") + F.col("_at") - F.col("_first")).cast("bigint")
    numbered = placed.join(stretches, [*groups, "range_id"]).withColumn(name, place)
    return numbered.drop("range_id", "_at", "_first", "_before")


def report_order(df: DataFrame, columns: Sequence[str], tie: str = "os") -> DataFrame:
    """Report order, nulls first, with a last column that makes it total."""
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in [*columns, tie]])
