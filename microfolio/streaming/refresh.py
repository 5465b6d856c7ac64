"""Refreshing marts when a new load lands.

A file stream over the landing folder notices new loads; its checkpoint makes sure that a load is taken up once, also after a
restart. Marts that merge (sums, counts, extremes per day and key) are kept up from the load alone: its partial results
go to a state table under the load's number, and the days it touched are merged anew from the state (``merged_by_load``). Other marts
are built again from whole tables (``rebuilt_days``, ``rebuilt``). In both, a second load of a day, or a late row, is never
lost.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.writers import append_snapshot, truncate_table


def landing_of(spark: SparkSession, path: str) -> tuple[str, str]:
    """(folder to watch, file name pattern) for a table that is a folder of part files or one file."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(target) and not files.getFileStatus(target).isDirectory():
        folder, _, name = path.rpartition("/")
        return folder, name
    return path, "*.parquet"


def refresh_on_load(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    checkpoint: str,
    refresh: Callable[[DataFrame], None] | Callable[[DataFrame, int], None],
    glob: str = "*.parquet",
):
    """Run ``refresh(new rows)`` for everything that has landed since the last run, then stop.

    ``refresh`` must be repeatable, because a batch that failed half-way is run again; ``merged_by_load``, ``rebuilt_days``
    and ``rebuilt`` are. If it takes two arguments, the second is the batch's number, the same one when it is run again. ``glob``
    picks the files of one table. Returns the finished query.
    """
    numbered = len(inspect.signature(refresh).parameters) > 1
    stream = spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(landing)

    def handle(batch: DataFrame, batch_id: int) -> None:
        refresh(batch, batch_id) if numbered else refresh(batch)

    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


@dataclass(frozen=True)
class Measure:
    """An output that merges: how it is taken from rows and how partial results are put together."""

    from_rows: Column
    merge: Callable[[str], Column]


def summed(value: Column | str) -> Measure:
    return Measure(F.sum(value), F.sum)


def counted(condition: Column | None = None) -> Measure:
    return Measure(F.count(F.lit(1)) if condition is None else F.count_if(condition), F.sum)


def smallest(value: Column | str) -> Measure:
    return Measure(F.min(value), F.min)


def largest(value: Column | str) -> Measure:
    return Measure(F.max(value), F.max)


def merged_by_load(
    day: Column, keys: dict[str, Column], measures: dict[str, Measure], state: str, path: str, date_col: str = "update_date"
) -> Callable[[DataFrame, int], None]:
    """A refresh of a mart of one row per day and ``keys`` that reads the load and the state of its days, and nothing else.

    ``state`` holds partial results by day and load number. A load that is run again replaces its own partials, so it
    changes nothing; a late row is a further partial of its day. Rows without a day are a day of their own.
    """

    def refresh(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        groups = [day.cast("date").alias(date_col), *[k.alias(n) for n, k in keys.items()]]
        partial = batch.groupBy(*groups).agg(*[m.from_rows.alias(n) for n, m in measures.items()])
        partial = partial.withColumn("load", F.lit(batch_id).cast("long"))
        writer = partial.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("load", date_col).parquet(state)
        kept = spark.read.schema(partial.schema).parquet(state)
        touched = [r[0] for r in kept.where(F.col("load") == batch_id).select(date_col).distinct().collect()]  # days of one load
        if not touched:
            return
        these = F.col(date_col).isin([d for d in touched if d is not None])
        these = these | F.col(date_col).isNull() if None in touched else these
        merged = kept.where(these).groupBy(date_col, *keys).agg(*[m.merge(n).alias(n) for n, m in measures.items()])
        append_snapshot(merged, path, date_col)

    return refresh


def rebuilt_days(
    whole: Callable[[], DataFrame], day: str, build: Callable[[DataFrame], DataFrame], path: str, date_col: str = "update_date"
) -> Callable[[DataFrame], None]:
    """A refresh that builds the changed days anew from all rows of the landed table and replaces them.

    ``day`` is an SQL expression of a row's day; ``build`` gives one or more rows per day in
    ``date_col``. Days are compared null-safely, so rows without a day are a day of their own.
    """

    def refresh(batch: DataFrame) -> None:
        changed = batch.select(F.expr(day).alias("__changed")).distinct()
        rows = whole().withColumn("__day", F.expr(day))
        rows = rows.join(changed, rows["__day"].eqNullSafe(changed["__changed"]), "left_semi").drop("__day")
        append_snapshot(build(rows), path, date_col)

    return refresh


def rebuilt(build: Callable[[], DataFrame], sink: Callable[[DataFrame], None]) -> Callable[[DataFrame], None]:
    """A refresh that builds a mart from whole tables, whatever the new rows are."""
    return lambda batch: sink(build())


def truncated(path: str) -> Callable[[DataFrame], None]:
    return lambda mart: truncate_table(mart, path)


def appended(path: str, date_col: str = "update_date") -> Callable[[DataFrame], None]:
    return lambda mart: append_snapshot(mart, path, date_col)
