"""Registration helpers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


@dataclass
class Source:
    """The supplied tables (``src.table``) and the portfolio views over them (``src["loan"]``)."""

    spark: SparkSession
    sf_dir: str

    def __getitem__(self, name: str) -> DataFrame:
        return fixtures.view(self.spark, self.sf_dir, name)

    def table(self, name: str) -> DataFrame:
        return fixtures.table(self.spark, self.sf_dir, name)


def query(name: str, sql: str | None = None, views: str = ""):
    """Register a query; ``sql`` is its counterpart over the named ``views``."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Source(spark, sf_dir))
        if sql is not None:
            ctes = [f"{v} AS ({fixtures.view_sql(v)})" for v in views.split()]
            text = sql.strip()
            if ctes and text.upper().startswith("WITH "):
                ORACLE[name] = "WITH " + ",\n".join(ctes) + ",\n" + text[5:]
            elif ctes:
                ORACLE[name] = "WITH " + ",\n".join(ctes) + "\n" + text
            else:
                ORACLE[name] = text
        return fn

    return register
