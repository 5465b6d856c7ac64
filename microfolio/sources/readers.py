"""Readers. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import SCHEMAS

# Raw load prefixes and the tables they hold (fixed values).
PREFIXES = {
    "dic": "dictionary",
    "cur": "currency",
    "txn": "transaction",
    "pfm": "portfolio_manager",
    "cus": "customer",
    "aba": "account_balance",
    "acc": "account",
    "loa": "loan",
    "lap": "loan_application",
    "sch": "schedule",
    "lba": "loan_balance",
    "eve": "event",
}


def scan_raw(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """All loads of one raw table: every directory or file ``<root>/<prefix>_*`` as one frame."""
    return spark.read.schema(SCHEMAS[PREFIXES[prefix]]).parquet(f"{root}/{prefix}_*")


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by its qualified name."""
    return spark.table(name)


def scan_snapshot(spark: SparkSession, path: str, date, column: str = "snapshot_date") -> DataFrame:
    """One day of a table partitioned by snapshot date; other partitions are not read."""
    return spark.read.parquet(path).where(F.col(column) == F.lit(date).cast("date"))


def read_delimited(
    spark: SparkSession, path, schema: T.StructType, sep: str = ";", quote: str = '"', null: str = "", header: bool = True
) -> DataFrame:
    """Delimited text from any file system Spark reaches; ``null`` is the text for NULL, quoted or not.

    Quotes inside a quoted value are doubled.
    """
    reader = spark.read.schema(schema).option("sep", sep).option("header", header)
    return reader.option("quote", quote).option("escape", quote).option("nullValue", null).option("mode", "PERMISSIVE").csv(path)


def stack_extracts(frames: list[DataFrame]) -> DataFrame:
    """Extracts of one table under each other, matched by column name."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
