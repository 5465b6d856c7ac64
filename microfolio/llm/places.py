"""Positions of rows in an order, for groups of any size: no window or task holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

_ROW_BITS = 33  # fixed by monotonically_increasing_id: the partition's number lies above these bits


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """``df`` with ``pos`` (0, 1, ... in its group by ``order``, nulls first) and ``n`` (rows of the group), written once.

    ``group`` must not be null. The rows are dealt by range of (group, order), so a group of any size is spread;
    of each partition only the count and the first place per group are summed over the partitions before it.
    Rows equal in ``order`` are told apart by where they were read, so copies are spread, too; their positions may be
    swapped on another run.
    """
    keys = [group, *order, "uid__"]
    df = staged(df, f"{name}-rows")  # the range partitioner reads its input twice
    laid = df.withColumn("uid__", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    rows = staged(laid.drop("uid__").withColumn("at__", F.monotonically_increasing_id()), f"{name}-order")
    rows = rows.withColumn("part__", F.shiftright("at__", _ROW_BITS))
    before = Window.partitionBy(group).orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy(group, "part__").agg(F.min("at__").alias("first__"), F.count(F.lit(1)).alias("rows__"))
    runs = runs.select(
        group, "part__",
        (F.coalesce(F.sum("rows__").over(before), F.lit(0)) - F.col("first__")).alias("shift__"),
        F.sum("rows__").over(Window.partitionBy(group)).alias("n"),
    )
    placed = rows.join(runs, [group, "part__"]).withColumn("pos", F.col("at__") + F.col("shift__"))
    return staged(placed.drop("at__", "part__", "shift__"), f"{name}-places")
