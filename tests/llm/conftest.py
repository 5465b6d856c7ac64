import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) pairs; lang by a third entry."""
    from microfolio.llm.common import documents

    documents(spark, SF)  # lets workers import the library

    def make(rows):
        return spark.createDataFrame([(r[0], r[1], r[2] if len(r) > 2 else "en", None, None) for r in rows], DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def supplied(spark):
    """(doc_id, text) of the smallest supplied table."""
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


#: Nulls, empty and blank texts, ties, repeated rows, odd characters.
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (5, "one"), (None, "one"), (None, None), (7, "a b   c\u0000d"),
    (8, "日本語 😀 naïve's\r\n\r\n  x"), (9, "<s></s><|endoftext|><unk> ▁▁x"), (10, "long " * 30000),
]
