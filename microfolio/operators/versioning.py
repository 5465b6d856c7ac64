"""Versioned rows: counters, validity ends, newest and oldest versions.

The version number of a row is the number of rows of its key that are at least as new.
Rows that tie share that number, so a key whose newest rows tie has no version 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import path_exists, staged
from .joins import null_safe_join
from .windows import running_over_grain


def version_counter(
    df: DataFrame, keys: list[str], order: str, out: str = "version", oldest_first: bool = False
) -> DataFrame:
    """Add the peer-sharing version number, newest = 1 (oldest = 1 on request)."""
    grain = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("__n"))
    run = running_over_grain(grain, keys, order, {"__n": out}, desc=not oldest_first).drop("__n")
    return null_safe_join(df, run, [*keys, order])


def with_history(
    df: DataFrame,
    keys: list[str],
    order: str,
    tiebreak: list[str],
    version: str = "version",
    end: str = "valid_to",
) -> DataFrame:
    """Add version number and validity end (the update date of the following row) in one pass.

    Among tied rows only the last one by ``tiebreak`` ends at the next date; the others end
    where they start. ``tiebreak`` must be unique within (keys, order); ``order`` is a date, so
    a key has at most one grain row per calendar day.
    """
    tie = F.col(tiebreak[0]) if len(tiebreak) == 1 else F.struct(*tiebreak)
    grain = df.groupBy(*keys, order).agg(F.count(F.lit(1)).alias("__n"), F.max(tie).alias("__last"))
    every = Window.partitionBy(*keys)
    w = every.orderBy(F.col(order).asc())
    # counting from the newest = all rows - rows up to here + rows here; one sort serves both columns
    newer = F.sum("__n").over(every) - F.sum("__n").over(w) + F.col("__n")
    run = grain.select(*keys, order, "__last", newer.alias(version), F.lead(order).over(w).alias("__next"))
    out = null_safe_join(df, run, [*keys, order])
    ends = F.when(tie.eqNullSafe(F.col("__last")), F.col("__next")).otherwise(F.col(order))
    return out.withColumn(end, ends).drop("__next", "__last")


def merge_history(
    load: DataFrame, path: str, keys: list[str], order: str, tiebreak: list[str], buckets: int = 64, version: str = "version", end: str = "valid_to"
) -> None:
    """Bring a load into a version table kept at ``path`` in buckets of its keys; equals ``with_history`` over all loads.

    Only the buckets that hold keys of the load are read and written: their rows and the load's are numbered and ended
    together, so open rows of changed keys are closed, late rows go between their neighbours, and rows that are there already
    change nothing. The buckets' rows are staged before they replace the old ones; a run that failed half-way is repeated.
    """
    spark = load.sparkSession
    load = load.withColumn("key_bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    touched = [r[0] for r in load.select("key_bucket").distinct().collect()]  # as many as there are buckets
    if not touched:
        return
    if path_exists(spark, path):
        kept = spark.read.parquet(path).where(F.col("key_bucket").isin(touched)).select(load.columns)
        load = kept.unionByName(load)
    rows = with_history(load.distinct(), keys, order, tiebreak, version, end)
    rows = staged(rows, "history")
    by_bucket = rows.hint("rebalance", F.col("key_bucket")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    by_bucket.partitionBy("key_bucket").parquet(path)


def first_version(df: DataFrame, keys: list[str], order: str, cols: list[str], oldest: bool = False) -> DataFrame:
    """The single newest (or oldest) row per key, only for keys whose newest date is not tied.

    Same rows as filtering the version counter on 1, computed by two map-side combined
    aggregations: no window and no group in one task.
    """
    grain = df.groupBy(*keys, order).agg(
        F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*cols)).alias("__p")
    )
    # NULL dates sort first ascending and last descending, as in the window they replace
    rank = F.struct(F.col(order).isNotNull(), F.col(order))
    pick = F.min_by if oldest else F.max_by
    best = grain.groupBy(*keys).agg(pick(F.struct("__n", "__p", order), rank).alias("__c"))
    return best.where(F.col("__c.__n") == 1).select(
        *keys, F.col(f"__c.{order}").alias(order), *[F.col(f"__c.__p.{c}").alias(c) for c in cols]
    )


def latest_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """All rows at the newest date of their key (ties kept): aggregate, then semi-join."""
    newest = df.groupBy(*keys).agg(F.max(order).alias(order)).where(F.col(order).isNotNull())
    return null_safe_join(df, newest, [*keys, order], "left_semi")


def latest_snapshot(df: DataFrame, order: str) -> DataFrame:
    """Rows of the newest date in the whole table (scalar subquery, no global window)."""
    return df.where(F.col(order) == df.select(F.max(order)).scalar())


def numbered_versions(df: DataFrame, keys: list[str], order: str, out: str = "version") -> DataFrame:
    """Distinct (keys, order) with 1 for the newest: at most one row per day and key."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.select(*keys, order).distinct().withColumn(out, F.row_number().over(w))


def primary_department(
    loans: DataFrame,
    departments: DataFrame,
    amount: str = "capital_disbursed_amount",
    out: str = "department_id_scoring",
) -> DataFrame:
    """Scoring department of each customer's largest loan (smaller loan id first on equal amounts).

    The loan id makes the order unique, so the best row is one ``min_by`` with partial aggregation.
    """
    rank = F.struct(F.col(amount).isNull(), -F.col(amount), F.col("loan_id"))
    tops = loans.groupBy("customer_id").agg(F.min_by("department_id", rank).alias("department_id"))
    dep = departments.select(F.col("department_id").alias("__d"), out)
    return tops.join(dep, F.col("department_id") == F.col("__d"), "left").select("customer_id", "department_id", out)
