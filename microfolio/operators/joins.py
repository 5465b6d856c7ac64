"""Join helpers.

No broadcast hints here: Spark broadcasts a side by itself when its measured or estimated size
is under ``spark.sql.autoBroadcastJoinThreshold``, and otherwise joins by shuffle, where
adaptive execution splits skewed partitions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the key columns come from the left."""
    twin = {c: f"__r_{c}" for c in on}
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(t)) for c, t in twin.items()])
    out = left.join(right.withColumnsRenamed(twin), cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*twin.values())


def join_on_shared(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join on every column name both sides have."""
    theirs = {c.lower() for c in right.columns}
    on = [c for c in left.columns if c.lower() in theirs]
    if not on:
        raise ValueError("the two frames share no column")
    return left.join(right, on, how)


def join_renamed(left: DataFrame, right: DataFrame, pairs: dict[str, str], how: str = "left") -> DataFrame:
    """Join on differently named keys {left: right}; the result keeps the left names."""
    renamed = right.withColumnsRenamed({r: l for l, r in pairs.items()})
    return left.join(renamed, list(pairs), how)


def not_in(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None) -> DataFrame:
    """Rows whose key is not in the list, with SQL's NULL rules.

    One NULL in the list keeps nothing, and a NULL key is kept only when the list is empty.
    The list is reduced to one row of facts and a plain anti-join, which stays a shuffle join
    at any size (the built-in null-aware anti-join broadcasts its list).
    """
    right_key = right_key or key
    keys = right.select(F.col(right_key).alias("__k"))
    n_null = keys.select(F.count_if(F.col("__k").isNull())).scalar()
    n_all = keys.select(F.count(F.lit(1))).scalar()
    listed = keys.where(F.col("__k").isNotNull()).distinct()
    kept = left.where(n_null == 0).join(listed, F.col(key) == F.col("__k"), "left_anti")
    return kept.where(F.col(key).isNotNull() | (n_all == 0))


def keep_in(left: DataFrame, right: DataFrame, key: str, right_key: str | None = None, negate: bool = False) -> DataFrame:
    """Two-valued membership filter: NULL meets NULL, as in R's %in%."""
    right_key = right_key or key
    listed = right.select(F.col(right_key).alias("__k")).distinct()
    return left.join(listed, F.col(key).eqNullSafe(F.col("__k")), "left_anti" if negate else "left_semi")


def coverage(a: DataFrame, b: DataFrame, key_a: str, key_b: str, flag: str = "found") -> DataFrame:
    """How many distinct keys of ``a`` exist in ``b``: one row per flag value (1 or NULL) with its count."""
    left = a.select(F.col(key_a).alias("k")).distinct()
    right = b.select(F.col(key_b).alias("k2")).distinct().withColumn(flag, F.lit(1))
    return (
        left.join(right, F.col("k") == F.col("k2"), "left")
        .groupBy(flag)
        .agg(F.count(F.lit(1)).alias("obs"))
    )
