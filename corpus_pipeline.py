"""The corpus pipeline: toxic documents, exact copies, near copies and repeated passages go, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of
``documents``. A stage sees all rows its predecessor kept and nothing else, but for the labels the
first one learns from. The stages hold nothing SQL could say with the same result (a trained network,
tokenizers and sets of shingles), so there is no SQL counterpart; tests compare with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from microfolio.llm import catalog, exact_dedup, near_dedup, packing, suffix_dedup, toxicity
from microfolio.llm.common import documents, not_in, scratch, staged

NEAR_PERCENT = 80


def _one_of_each(docs: DataFrame, label: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Of the rows that ``label`` puts into one group, the one with the smallest id stays, ids before none.

    Rows are told apart by a key written once, not by their ids, so copies without an id, different texts of one id
    and repeated rows are judged each by itself, and one row of each group stays. ``label`` takes (doc_id, text)
    with the key as id and returns doc_id and group.
    """
    keyed = staged(docs.withColumn("row__", F.monotonically_increasing_id()), "pipeline-rows")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row__")
    with scratch(docs.sparkSession) as keep:
        groups = label(keyed.select(F.col("row__").alias("doc_id"), "text")).select(F.col("doc_id").alias("row__"), "group")
        named = staged(keyed.select("row__", "doc_id").join(groups, "row__"), "pipeline-groups")
        stays = named.groupBy("group").agg(F.min(first).getField("row__").alias("stays"), F.count(F.lit(1)).alias("n")).where("n > 1")
        goes = keep(named.join(stays, "group").where("row__ <> stays").select("row__"), "pipeline-goes")
    return not_in(keyed, goes, "row__").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model rejects go, each judged by its text; a null text has nothing to reject."""
    columns = docs.columns
    flagged = toxicity.score_rows(docs, catalog.toxicity_model(spark, sf_dir))
    return flagged.where("toxic_predicted__ = 0").select(columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts (null: empty) the row with the smallest id stays."""
    return _one_of_each(docs, lambda rows: exact_dedup.exact_duplicates(rows).withColumnRenamed("keep_id", "group"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8) the row with the smallest id stays; texts without words all stay."""
    return _one_of_each(docs, lambda rows: near_dedup.near_duplicates(rows, NEAR_PERCENT).withColumnRenamed("component_id", "group"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes that also start elsewhere are cut out; ``n_chars`` follows. Ids play no part; null texts stay null."""
    return suffix_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences."""
    return packing.pack(docs, catalog.vocabulary("byte_bpe_50k.json"), added_tokens=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for number, (name, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = staged(docs, f"pipeline-{name}")
    return docs
