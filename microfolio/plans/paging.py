"""Pages of a long ordered table by an index of its ranges.

The table is written once in ranges of its order with the number of rows of each. A page by offset reads the ranges that
the offset falls into; a page after a given row reads the ranges from that row on. No read sorts more than these.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.writers import write_table

Order = Sequence[tuple[str, bool]]  # (column, whether descending); the last column makes rows unique


def _sorts(order: Order) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]


def write_pages(df: DataFrame, order: Order, path: str, ranges: int | None = None) -> None:
    """Write ``df`` in ranges of ``order`` and the index of the ranges: number, rows, rows before, bounds of the first order column.

    ``ranges`` is the number of ranges (by default that of shuffle partitions); sampled splitters make them about equally long.
    """
    sorts = _sorts(order)
    laid = df.repartitionByRange(ranges, *sorts) if ranges else df.repartitionByRange(*sorts)
    rows = laid.sortWithinPartitions(*sorts).withColumn("page_range", F.spark_partition_id())
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("page_range").parquet(f"{path}/rows")
    kept = df.sparkSession.read.parquet(f"{path}/rows")
    lead = order[0][0]
    counts = kept.groupBy("page_range").agg(
        F.count(F.lit(1)).alias("n"), F.min(lead).alias("low"), F.max(lead).alias("high"), F.count_if(F.col(lead).isNull()).alias("nulls")
    )
    before = Window.orderBy("page_range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    write_table(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), f"{path}/index")


def page(spark: SparkSession, path: str, order: Order, limit: int, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the order."""
    index = spark.read.parquet(f"{path}/index")
    met = index.where((F.col("start") < offset + limit) & (F.col("start") + F.col("n") > offset))
    parts = sorted((r["start"], r["page_range"]) for r in met.select("start", "page_range").collect())  # ranges of one page
    rows = spark.read.parquet(f"{path}/rows").where(F.col("page_range").isin([p for _, p in parts])).drop("page_range")
    return rows.orderBy(*_sorts(order)).offset(offset - parts[0][0] if parts else 0).limit(limit)


def _after(order: Order, last: dict) -> Column:
    """Whether a row comes behind the given keys; NULLs are last in descending columns, first in ascending ones."""
    found, same = F.lit(False), F.lit(True)
    for c, down in order:
        value, key = F.col(c), last[c]
        if key is None:
            behind = F.lit(False) if down else value.isNotNull()
        else:
            behind = (value < F.lit(key)) | value.isNull() if down else value > F.lit(key)
        found = found | (same & F.coalesce(behind, F.lit(False)))
        same = same & value.eqNullSafe(F.lit(key))
    return found


def page_after(spark: SparkSession, path: str, order: Order, limit: int, last: dict) -> DataFrame:
    """The ``limit`` rows behind the row with the keys ``last``.

    Read are the ranges that may hold the row's own first key and, of those wholly behind it, as many as the page takes.
    """
    (lead, down), key = order[0], last[order[0][0]]
    low, high, nulls = F.col("low"), F.col("high"), F.col("nulls")
    if key is None:
        reaches, behind = (nulls > 0, F.lit(False)) if down else (F.lit(True), nulls == 0)
    elif down:
        reaches, behind = (low <= F.lit(key)) | (nulls > 0), high.isNull() | (high < F.lit(key))
    else:
        reaches, behind = high >= F.lit(key), (low > F.lit(key)) & (nulls == 0)
    index = spark.read.parquet(f"{path}/index").withColumn("behind", F.coalesce(behind, F.lit(False)))
    wanted, n = [], 0
    for r in index.where(reaches).orderBy("page_range").select("page_range", "n", "behind").toLocalIterator():
        if r["behind"] and n >= limit:
            break
        wanted.append(r["page_range"])
        n += r["n"] if r["behind"] else 0
    rows = spark.read.parquet(f"{path}/rows").where(F.col("page_range").isin(wanted)).drop("page_range")
    return rows.where(_after(order, last)).orderBy(*_sorts(order)).limit(limit)
