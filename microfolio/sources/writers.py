"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_bucket(df: DataFrame, column: str, low: int = 0, high: int = 200, out: str = "bucket") -> DataFrame:
    """Unit-wide buckets low <= x < high; values outside, and NULL, get a NULL bucket."""
    x = F.col(column)
    return df.withColumn(out, F.when((x >= low) & (x < high), F.floor(x).cast("int")))


def by_partition(df: DataFrame, columns: list[str]) -> DataFrame:
    """Bring rows of a partition value together in tasks of about equal size.

    The rebalance hint lets adaptive execution split values that hold many rows and merge small ones,
    so one value may hold any part of the table.
    """
    return df.hint("rebalance", *[F.col(c) for c in columns])


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None):
    """Parquet directory, optionally partitioned by columns."""
    writer = (by_partition(df, partition_by) if partition_by else df).write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_range_bucketed(df: DataFrame, path: str, column: str, low: int = 0, high: int = 200):
    """Table partitioned by unit buckets of a column."""
    write_table(range_bucket(df, column, low, high), path, "overwrite", ["bucket"])


def append_snapshot(df: DataFrame, path: str, date_col: str = "update_date"):
    """Add a run's rows to a table partitioned by run date.

    Only the partitions present in the frame are replaced, so running a day again does not
    double its rows.
    """
    (
        by_partition(df, [date_col])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(date_col)
        .parquet(path)
    )


def truncate_table(df: DataFrame, path: str):
    """Replace the whole table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def publish(df: DataFrame, name: str, overwrite: bool = False):
    """Save under a catalog name; fails on an existing table unless told to overwrite."""
    df.write.mode("overwrite" if overwrite else "errorifexists").saveAsTable(name)


def write_csv(df: DataFrame, path: str, sep: str = ","):
    """Delimited text with a header row; values with separators or quotes are quoted, quotes inside doubled,
    blanks at their ends kept."""
    options = {"header": True, "sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite").options(**options).csv(path)
