"""Ordered computations that stay spread out when one key holds a large part of all rows.

A plain window sends all rows of a key to one task. Here rows are first reduced to one row
per (key, order value) by an aggregation with map-side partial sums. That grain holds at
most one row per calendar day and key when the order is a date, so an ordinary window over it
is bounded. Finer orders (timestamps) and orders of single rows are cut into blocks by
sampled splitters of (key, order): the blocks hold about equal numbers of rows, whatever the keys and times, and
the totals of earlier blocks are carried over. Grain results are joined back by (key, order value): an equi-join whose
row side adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import staged
from .joins import null_safe_join


def _ordered(c: str, desc: bool):
    return F.col(c).desc() if desc else F.col(c).asc()


def in_blocks(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """``df`` as a stage table ordered by (keys, order) over its blocks, with ``__block`` and the row's place ``__at``.

    ``order`` names columns or gives sort expressions. Rows equal in it are told apart by where they were read, so they can lie in
    several blocks, too.
    """
    place = [*keys, *order, "__uid"]
    df = staged(df, "block-rows")  # the range partitioner reads its input twice
    laid = df.withColumn("__uid", F.monotonically_increasing_id()).repartitionByRange(*place).sortWithinPartitions(*place)
    return staged(laid.drop("__uid").withColumns({"__block": F.spark_partition_id(), "__at": F.monotonically_increasing_id()}), "blocks")


def running_over_blocks(blocks: DataFrame, keys: list[str], cols: dict[str, str]) -> DataFrame:
    """Running sums {source: output} in the order of ``in_blocks``, in two levels: inside a block and over the blocks before."""
    totals = blocks.groupBy(*keys, "__block").agg(*[F.sum(s).alias(f"__t_{o}") for s, o in cols.items()])
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        *keys, "__block", *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__c_{o}") for o in cols.values()]
    )
    inside = Window.partitionBy(*keys, "__block").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    part = blocks.withColumns({o: F.sum(s).over(inside) for s, o in cols.items()})
    out = null_safe_join(part, carried, [*keys, "__block"])
    return out.withColumns({o: F.col(o) + F.col(f"__c_{o}") for o in cols.values()}).drop(
        "__block", "__at", *[f"__c_{o}" for o in cols.values()]
    )


def running_over_grain(
    grain: DataFrame, keys: list[str], order: str, cols: dict[str, str], desc: bool = False
) -> DataFrame:
    """Running sums {source: output} over a frame with one row per (keys, order)."""
    if isinstance(grain.schema[order].dataType, T.DateType):
        w = Window.partitionBy(*keys).orderBy(_ordered(order, desc))
        return grain.withColumns({out: F.sum(src).over(w) for src, out in cols.items()})
    return running_over_blocks(in_blocks(grain, keys, [_ordered(order, desc)]), keys, cols)


def running_sum(
    df: DataFrame, keys: list[str], order: str, cols: dict[str, str], desc: bool = False
) -> DataFrame:
    """Running sums with peers sharing their total (RANGE frame), for any number of rows per key."""
    grain = df.groupBy(*keys, order).agg(*[F.sum(s).alias(s) for s in cols])
    run = running_over_grain(grain, keys, order, cols, desc).drop(*cols)
    return null_safe_join(df, run, [*keys, order])


def previous(df: DataFrame, keys: list[str], order: list[str], cols: dict[str, str], default=0) -> DataFrame:
    """Value of the row before, ``default`` where there is none or it is NULL.

    For frames with one row per (keys, date): the group is bounded by the calendar.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    lagged = {out: F.lag(src).over(w) for src, out in cols.items()}
    if default is not None:
        lagged = {o: F.coalesce(e, F.lit(default)) for o, e in lagged.items()}
    return df.withColumns(lagged)


def fill(
    df: DataFrame, keys: list[str], order: str, cols: list[str], backward: bool = False, suffix: str = "_filled"
) -> DataFrame:
    """Last non-NULL value so far (or next one when ``backward``), peers sharing the result.

    Rows are reduced to one per (keys, order); each column keeps its non-NULL value, the
    largest one where peers disagree.
    """
    grain = df.groupBy(*keys, order).agg(*[F.max(c).alias(c) for c in cols])
    w = (
        Window.partitionBy(*keys)
        .orderBy(_ordered(order, backward))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    filled = grain.select(*keys, order, *[F.last(c, ignorenulls=True).over(w).alias(c + suffix) for c in cols])
    return null_safe_join(df, filled, [*keys, order])


def row_number(df: DataFrame, keys: list[str], order: list, out: str = "row_no") -> DataFrame:
    """Row number by sorted group, for groups of any size; ``order`` names columns or gives sort expressions."""
    blocks = in_blocks(df, keys, order).withColumn("__one", F.lit(1))
    return running_over_blocks(blocks, keys, {"__one": out}).drop("__one").withColumn(out, F.col(out).cast("int"))


def priority_number(df: DataFrame, keys: list[str], order: list, value: str | Column, out: str = "priority") -> DataFrame:
    """Running count of non-NULL values in a given order, for groups of any size."""
    value = F.col(value) if isinstance(value, str) else value
    blocks = in_blocks(df, keys, order).withColumn("__filled", F.when(value.isNotNull(), 1).otherwise(0))
    return running_over_blocks(blocks, keys, {"__filled": out}).drop("__filled")


def group_max(df: DataFrame, keys: list[str], col: str, out: str) -> DataFrame:
    """Maximum of the group on every row: partial maxima first, then a join back."""
    return null_safe_join(df, df.groupBy(*keys).agg(F.max(col).alias(out)), keys)
