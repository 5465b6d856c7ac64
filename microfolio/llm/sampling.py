"""Bounded samples of labelled rows for the classifiers: the rows with the smallest id hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def smallest_hashes(rows: DataFrame, most: int) -> Column:
    """A condition that about ``most`` distinct ids of ``rows`` fulfil, the same ones on every run."""
    hashed = F.xxhash64("doc_id")
    last = rows.select(hashed.alias("h")).distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return hashed <= last if last is not None else F.lit(False)
