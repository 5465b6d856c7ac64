"""The registered queries and the pipeline on the smallest supplied tables."""

import hashlib
import pathlib
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from microfolio.llm import catalog, suffix_dedup
from microfolio.llm.common import staged

from .conftest import DOCUMENTS, SF


def test_all_are_registered():
    names = set(entry_points.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))


def test_exact_dedup_matches_its_sql(spark):
    want = duckdb.sql(catalog.ORACLE["op2_exact_dedup"].replace("FROM documents", f"FROM read_parquet('{SF}/documents.parquet')")).df()
    got = catalog.QUERIES["op2_exact_dedup"](spark, SF).toPandas()[list(want.columns)]
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


@pytest.mark.parametrize("name", ["op1_toxicity", "op3_language"])
def test_models_give_a_row_for_each_document(spark, name):
    got = catalog.QUERIES[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.where("score is null or score < 0 or score > 1").count() == 0


def test_stages_against_brute_force(spark):
    from .test_copies import near_components, removed_by_hand

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, SF), f"test-{name}")
        kept[name] = (before, docs)
        if name != "packing":
            assert docs.columns == before.columns
    rows = lambda df: [(r.doc_id, r.text) for r in df.collect()]
    before, after = kept["toxicity"]
    flagged = {r.doc_id for r in catalog.QUERIES["op1_toxicity"](spark, SF).where("predicted = 1").collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - flagged
    before, after = kept["exact_dedup"]
    groups = {}
    for i, t in rows(before):
        key = " ".join(t.replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" "))
        while "  " in key:
            key = key.replace("  ", " ")
        groups[key] = min(i, groups.get(key, i))
    assert {i for i, _ in rows(after)} == set(groups.values())
    before, after = kept["near_dedup"]
    assert {i for i, _ in rows(after)} == {i for i, _, _, keep in near_components(rows(before), corpus_pipeline.NEAR_PERCENT) if keep}
    before, after = kept["suffix_dedup"]
    want = {i: n - gone for i, n, gone, _, _ in removed_by_hand(rows(before), suffix_dedup.WIDTH)}
    assert {i for i, _ in rows(after)} == set(want)
    cut = {r.doc_id: r.kept_sha256 for r in suffix_dedup.removal_digests(before).collect()}
    whole = [(i, t) for i, t in rows(after) if hashlib.sha256(t.encode()).hexdigest() == cut[i]]
    assert all(want[i] == len(t.encode()) for i, t in whole) and len(whole) > 0.9 * len(want)
    before, after = kept["packing"]
    assert {r.doc_id for r in after.select("doc_id").distinct().collect()} == {r.doc_id for r in before.collect()}
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def awkward_table(spark):
    long = lambda c, n=90: " ".join(f"{c}{k}" for k in range(n))
    near = long("n").replace("n50", "other")
    rows = [(None, long("a")), (None, long("a")), (None, long("a").replace(" ", "  ")), (3, long("a"))]
    rows += [(7, long("b")), (7, long("b")), (7, long("c")), (2, long("c"))]
    rows += [(None, long("n")), (None, near), (9, long("d")), (9, long("e")), (12, long("e").replace("e50", "x"))]
    rows += [(20, None), (21, ""), (None, None), (30, long("z", 4000))]
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], DOCUMENTS).withColumn("row__extra", F.lit(1))


def test_stages_judge_rows_and_not_ids(spark, docs_of):
    docs = awkward_table(spark).repartition(3)
    once = corpus_pipeline.drop_copies(spark, docs, SF).collect()
    texts = sorted(" ".join((r.text or "").split()) for r in once)
    assert texts == sorted({" ".join((r.text or "").split()) for r in docs.collect()})  # one row of each text stays
    assert {r.doc_id for r in once if (r.text or "").startswith("a0")} == {3} and {r.doc_id for r in once if (r.text or "").startswith("c0")} == {2}
    near = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(once, docs.schema), SF)
    assert near.columns == docs.columns
    kept = [(r.doc_id, (r.text or "")[:2]) for r in near.collect()]
    assert sum(t == "n0" for _, t in kept) == 1 and [i for i, t in kept if t == "e0"] == [9] and (9, "d0") in kept
    cut = corpus_pipeline.cut_repeats(spark, docs, SF).collect()
    assert len(cut) == docs.count() and sorted(r.text for r in cut if r.doc_id == 30) == [r.text for r in docs.collect() if r.doc_id == 30]
    assert corpus_pipeline.pack(spark, docs, SF).where("doc_id = 30").count() > 0
    nothing = docs.where("false")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, nothing, SF).count() == 0


def test_entry_module_without_the_optional_libraries():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    root = pathlib.Path(corpus_pipeline.__file__).parent
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root).stdout.split()
    assert int(out[0]) > 180 and out[1] == "False"
