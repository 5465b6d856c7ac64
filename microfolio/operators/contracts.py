"""Declared contracts of tables: formats, filled columns, cross-column and cross-table rules, keys and measures.

A contract is data. Its formats, filled columns and cross-column rules become conditions of one scan of the table,
its keys one exchange of their columns, its references one count per pair of tables, its measures exact order statistics. Shares are
in millionths.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import per_million
from . import quality


@dataclass(frozen=True)
class TableContract:
    """``formats``: column → name in ``quality.PATTERNS``. ``filled``: columns that must not be NULL, empty or the null marker.
    ``rules``: name → SQL condition of a violation. ``references``: column → (table, column). ``keys``: name → columns."""

    formats: Mapping[str, str] = field(default_factory=dict)
    filled: tuple[str, ...] = ()
    rules: Mapping[str, str] = field(default_factory=dict)
    references: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    measures: tuple[str, ...] = ()


def _stacked(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _of(table: str, df: DataFrame) -> DataFrame:
    return df.select(F.lit(table).alias("table"), *df.columns)


def conditions(contract: TableContract) -> dict[str, F.Column]:
    """All conditions that one row decides: formats that hold, columns that are empty, rules that are broken."""
    out = {f"format {c}": F.col(c).cast("string").rlike(quality.PATTERNS[p]) for c, p in contract.formats.items()}
    out |= {f"empty {c}": F.coalesce(F.col(c).cast("string").isin("", "[NULL]"), F.lit(True)) for c in contract.filled}
    return out | {f"broken {n}": F.expr(e) for n, e in contract.rules.items()}


def row_report(tables: Mapping[str, DataFrame], contracts: Mapping[str, TableContract]) -> DataFrame:
    """table, rule, matches, obs, share: one scan per table for all its row conditions."""
    return _stacked([_of(t, quality.rule_report(tables[t], conditions(c))) for t, c in contracts.items() if conditions(c)])


def reference_report(tables: Mapping[str, DataFrame], contracts: Mapping[str, TableContract]) -> DataFrame:
    """table, rule, matches (distinct values of a column that the other table lacks), obs (distinct values)."""
    parts = []
    for t, contract in contracts.items():
        for column, (other, key) in contract.references.items():
            values = tables[t].select(F.col(column).alias("v")).where("v is not null").distinct()
            known = tables[other].select(F.col(key).alias("k")).where("k is not null").distinct()
            counted = values.join(known, F.col("v") == F.col("k"), "left").agg(
                F.count_if(F.col("k").isNull()).alias("matches"), F.count(F.lit(1)).alias("obs")
            )
            parts.append(_of(t, counted.select(F.lit(f"{column} not in {other}").alias("rule"), "matches", "obs")))
    return _stacked(parts)


def key_report(tables: Mapping[str, DataFrame], contracts: Mapping[str, TableContract]) -> DataFrame:
    """table, rule, matches (distinct combinations), obs, share; 1,000,000 means unique."""
    parts = []
    for t, contract in contracts.items():
        if contract.keys:
            counts = quality.key_report(tables[t], {n: list(c) for n, c in contract.keys.items()})
            rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("matches")) for n in contract.keys]))
            counts = counts.select("obs", rows.alias("x")).select("x.rule", "x.matches", "obs")
            parts.append(_of(t, counts.withColumn("share", per_million("matches", "obs"))))
    return _stacked(parts)


def column_report(tables: Mapping[str, DataFrame], contracts: Mapping[str, TableContract]) -> DataFrame:
    """The profile of every column of every table."""
    return _stacked([_of(t, quality.profile(tables[t])) for t in contracts])


def measure_report(tables: Mapping[str, DataFrame], contracts: Mapping[str, TableContract], probs: list[float]) -> DataFrame:
    """Exact quantiles of every measure of every table."""
    return _stacked([_of(t, quality.quantiles(tables[t], list(c.measures), probs)) for t, c in contracts.items() if c.measures])
