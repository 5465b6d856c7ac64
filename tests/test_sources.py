"""Readers, writers and the stream refresh on files."""

import datetime as dt
import re
import uuid

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from microfolio.sources import readers, schemas, writers
from microfolio.operators import versioning
from microfolio.plans import paging
from microfolio.streaming.refresh import counted, landing_of, largest, merged_by_load, rebuilt, rebuilt_days, refresh_on_load, summed, truncated


def test_range_buckets_and_pruning(spark, tmp_path):
    df = spark.createDataFrame([(0,), (199,), (200,), (-1,), (None,), (7,)], "department_id_scoring int")
    path = str(tmp_path / "t")
    writers.write_range_bucketed(df, path, "department_id_scoring")
    back = spark.read.parquet(path)
    assert back.where(F.col("bucket").isNull()).count() == 3
    plan = back.where(F.col("bucket") == 7)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    assert back.where(F.col("bucket") == 7).count() == 1


def test_append_is_repeatable_and_truncate_replaces(spark, tmp_path):
    path = str(tmp_path / "m")
    one = spark.createDataFrame([(1,), (2,)], "x int").withColumn("update_date", F.lit("2024-01-01").cast("date"))
    two = one.withColumn("update_date", F.lit("2024-01-02").cast("date"))
    for df in (one, two, one):
        writers.append_snapshot(df, path)
    assert spark.read.parquet(path).count() == 4
    assert readers.scan_snapshot(spark, path, "2024-01-02", "update_date").count() == 2
    writers.truncate_table(one.limit(1), str(tmp_path / "n"))
    writers.truncate_table(one, str(tmp_path / "n"))
    assert spark.read.parquet(str(tmp_path / "n")).count() == 2


def test_raw_shards_are_one_table(spark, tmp_path):
    schema = schemas.SCHEMAS["dictionary"]
    for i in range(3):
        row = ("r", "DEPARTMENT_ID", str(i), f"name {i}", None, None, dt.date(2020, 1, 1 + i))
        spark.createDataFrame([row], schema).write.parquet(str(tmp_path / f"dic_2020010{i}"))
    out = readers.scan_raw(spark, str(tmp_path), "dic")
    assert out.count() == 3 and out.schema == schema


def test_delimited_text(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.DecimalType(18, 2))])
    for sep in (";", "^", ","):
        f = tmp_path / f"x{ord(sep)}.csv"
        f.write_text(f'id{sep}v\n"007"{sep}1.50\n8{sep}\n')
        got = readers.read_delimited(spark, str(f), schema, sep=sep).collect()
        assert [(r["id"], None if r["v"] is None else float(r["v"])) for r in got] == [("007", 1.5), ("8", None)]
    df = readers.read_delimited(spark, str(tmp_path / "x59.csv"), schema)
    writers.write_csv(df, str(tmp_path / "out"), ";")
    assert readers.read_delimited(spark, str(tmp_path / "out"), schema).count() == 2


SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("load", T.StringType())])


def land(spark, folder, n, load, first=0):
    rows = spark.range(first, first + n).select(F.col("id").alias("k"), F.lit(load).cast("string").alias("load"))
    rows.write.mode("append").parquet(folder)


def per_load(rows):
    return rows.groupBy(F.col("load").alias("update_date")).agg(F.count(F.lit(1)).alias("n"))


def counts(spark, path):
    return {str(r["update_date"]): r["n"] for r in spark.read.parquet(path).collect()}


def test_a_second_load_of_a_day_loses_nothing(spark, tmp_path):
    landing, target, seen = str(tmp_path / "in"), str(tmp_path / "mart"), []
    build = rebuilt_days(lambda: spark.read.schema(SCHEMA).parquet(landing), "load", per_load, target)

    def run():
        refresh_on_load(spark, landing, SCHEMA, str(tmp_path / "ckpt"), lambda batch: (seen.append(batch.count()), build(batch)))

    land(spark, landing, 10, "a")
    land(spark, landing, 3, "b")
    run()
    run()  # nothing new
    land(spark, landing, 4, "a", 10)
    run()
    assert counts(spark, target) == {"a": 14, "b": 3}
    assert seen == [13, 4]


def test_truncating_mart_is_built_from_the_whole_table(spark, tmp_path):
    landing, target = str(tmp_path / "in"), str(tmp_path / "mart")
    build = rebuilt(lambda: per_load(spark.read.schema(SCHEMA).parquet(landing)), truncated(target))
    for load in ("a", "b"):
        land(spark, landing, 5, load)
        refresh_on_load(spark, landing, SCHEMA, str(tmp_path / "ckpt"), build)
    assert counts(spark, target) == {"a": 5, "b": 5}


def test_a_folder_and_a_file_land_the_same_rows(spark, tmp_path):
    land(spark, str(tmp_path / "events.parquet"), 7, "a")
    part = next((tmp_path / "events.parquet").glob("part-*.parquet"))
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "events.parquet").write_bytes(part.read_bytes())
    for k, path in enumerate((tmp_path / "events.parquet", tmp_path / "one" / "events.parquet")):
        folder, glob = landing_of(spark, str(path))
        got = []
        refresh_on_load(spark, folder, SCHEMA, str(tmp_path / f"ckpt{k}"), lambda batch: got.append(batch.count()), glob)
        assert sum(got) in (7, spark.read.parquet(str(path)).count())


def test_published_table_and_extracts(spark, tmp_path):
    name = "published_" + uuid.uuid4().hex
    df = spark.range(5).toDF("x")
    writers.publish(df, name)
    assert readers.scan_table(spark, name).count() == 5
    with pytest.raises(AnalysisException):
        writers.publish(df, name)
    writers.publish(df.limit(2), name, overwrite=True)
    assert readers.scan_table(spark, name).count() == 2
    spark.sql(f"DROP TABLE {name}")
    assert readers.stack_extracts([df, df.select((F.col("x") + 9).alias("x"))]).count() == 10


def test_loads_are_merged_without_reading_earlier_ones(spark, tmp_path):
    landing, state, mart = (str(tmp_path / n) for n in ("in", "state", "mart"))
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    day = lambda n: None if n is None else dt.datetime(2024, 1, 1 + n, 12)
    loads = [
        [(day(0), "a", 1), (day(1), "a", 2), (None, "b", 9)],
        [(day(1), "a", 5), (day(2), "b", 7), (day(0), None, 3)],  # late rows of days that are there
        [(None, "b", 1), (day(2), "b", 7)],
    ]
    refresh = merged_by_load(F.col("ts"), {"k": F.col("k")}, {"n": counted(), "total": summed("v"), "most": largest("v")}, state, mart)
    seen = []

    def watched(batch, batch_id):
        seen.append((batch_id, batch.count()))
        refresh(batch, batch_id)
        refresh(batch, batch_id)  # a batch that is run again changes nothing

    for rows in loads:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)
        refresh_on_load(spark, landing, schema, str(tmp_path / "ckpt"), watched)
    everything = spark.read.schema(schema).parquet(landing)
    whole = everything.groupBy(F.col("ts").cast("date").alias("update_date"), "k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.max("v").alias("most"))
    order = ["update_date", "k", "n", "total", "most"]
    got = spark.read.parquet(mart).select(order)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.select(order).collect()), key=repr)
    assert [n for _, n in seen] == [len(rows) for rows in loads]  # each load is read alone


@pytest.mark.parametrize("buckets", [1, 8])
def test_history_by_loads_equals_a_rebuild(spark, tmp_path, buckets):
    schema = "k long, d date, r long, x string"
    day = lambda n: None if n is None else dt.date(2024, 1, n)
    loads = [
        [(1, day(3), 1, "a"), (1, day(9), 2, "b"), (2, day(5), 3, "a")],
        [(1, day(5), 4, "late"), (1, day(9), 5, "tie"), (None, day(1), 6, "no key")],
        [(1, day(9), 2, "b"), (2, None, 7, "no date"), (3, day(1), 8, "new")],  # the first is there already
    ]
    path = str(tmp_path / "history")
    for load in loads:
        versioning.merge_history(spark.createDataFrame(load, schema), path, ["k"], "d", ["r"], buckets)
    versioning.merge_history(spark.createDataFrame([], schema), path, ["k"], "d", ["r"], buckets)
    rows = spark.createDataFrame(sum(loads, []), schema).distinct()
    want = versioning.with_history(rows, ["k"], "d", ["r"])
    got = spark.read.parquet(path).drop("key_bucket").select(want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "history").rglob("*.parquet")}
    versioning.merge_history(spark.createDataFrame([(3, day(2), 9, "next")], schema), path, ["k"], "d", ["r"], buckets)
    if buckets > 1:
        left = {f for f, t in before.items() if f.exists() and f.stat().st_mtime_ns == t}
        assert 0 < len(left) < len(before)  # only the key's bucket was written


def test_pages_equal_offset_paging(spark, tmp_path):
    rows = [(None if k % 11 == 0 else k * 37 % 50, k) for k in range(400)]
    df = spark.createDataFrame(rows, "a int, id long").repartition(5)
    for down in (True, False):
        order, path = (("a", down), ("id", not down)), str(tmp_path / f"pages{down}")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        paging.write_pages(df, order, path, 9)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        whole = [tuple(r) for r in df.orderBy(*paging._sorts(order)).collect()]
        assert spark.read.parquet(f"{path}/index").count() > 5
        for offset in (0, 1, 37, 200, 395, 400, 900):
            assert [tuple(r) for r in paging.page(spark, path, order, 20, offset).collect()] == whole[offset : offset + 20]
        for place in (0, 30, 36, 37, 199, 380, 399):
            last = dict(zip(("a", "id"), whole[place]))
            assert [tuple(r) for r in paging.page_after(spark, path, order, 20, last).collect()] == whole[place + 1 : place + 21]
    plan = paging.page(spark, path, order, 20, 200)
    scan = re.search(r"PartitionFilters: \[[^]]*page_range", plan._jdf.queryExecution().toString())
    assert scan  # other ranges are not read
