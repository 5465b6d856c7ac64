"""Sources and sinks: tables are written in each form, read back whole and compared."""

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stages_folder
from ..sources import readers, writers
from ..sources.schemas import SCHEMAS
from .base import ORACLE, QUERIES, query


def _folder(src) -> str:
    return f"{stages_folder(src.spark)}/sources-{uuid.uuid4().hex}"


@query("a1_raw_shards", "SELECT field_name, field_code, field_description FROM dictionary", "dictionary")
def a1(src):
    """A raw table in several loads, read by its prefix."""
    folder, rows = _folder(src), src["dictionary"]
    full = rows.select(*(F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS["dictionary"]))
    shard = F.pmod(F.xxhash64("field_code"), F.lit(3))
    for k in range(3):
        full.where(shard == k).write.parquet(f"{folder}/dic_{k}")
    return readers.scan_raw(src.spark, folder, "dic").select("field_name", "field_code", "field_description")


@query("a3_snapshot", "SELECT account_id, capital_balance, balance_date FROM account_balance WHERE balance_date = DATE '2024-01-10'", "account_balance")
def a3(src):
    """One day of a table kept by days."""
    path = _folder(src)
    writers.append_snapshot(src["account_balance"].select("account_id", "capital_balance", "balance_date"), path, "balance_date")
    return readers.scan_snapshot(src.spark, path, "2024-01-10", "balance_date")


_ORDERS = "SELECT o_orderkey, o_orderstatus, CAST(o_orderdate AS DATE) AS o_orderdate, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders"
_ORDER_SCHEMA = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_orderdate", T.DateType()), T.StructField("o_orderpriority", T.StringType())])


def _orders(src):
    priority = F.when(F.col("o_custkey") % 7 == 0, None).otherwise(F.col("o_orderpriority"))
    return src.table("orders").select("o_orderkey", "o_orderstatus", F.col("o_orderdate").cast("date").alias("o_orderdate"), priority.alias("o_orderpriority"))


def _delimited(sep):
    def run(src):
        path = _folder(src)
        writers.write_csv(_orders(src), path, sep)
        return readers.read_delimited(src.spark, path, _ORDER_SCHEMA, sep)

    return run


for _name, _sep in (("a4_semicolon_text", ";"), ("a5_caret_text", "^"), ("a6_comma_text", ",")):
    query(_name, _ORDERS)(_delimited(_sep))


def _notes_sql(sep: str, empty: str) -> str:
    return f"""SELECT o_orderkey, CASE o_custkey % 6 WHEN 0 THEN concat(o_orderpriority, '{sep}', o_clerk_code) WHEN 1 THEN concat('say "', o_clerk_code, '" {sep} or not')
       WHEN 2 THEN {empty} WHEN 3 THEN '"' WHEN 4 THEN concat(' ', o_orderpriority, ' ') END AS note FROM (SELECT *, CAST(o_custkey AS VARCHAR) AS o_clerk_code FROM orders)"""


_NOTES = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("note", T.StringType())])


def _noted(sep):
    def run(src):
        """Values with separators, quotes, blanks at their ends and empty texts; empty becomes NULL."""
        path, k, clerk = _folder(src), F.col("o_custkey") % 6, F.col("o_custkey").cast("string")
        note = (
            F.when(k == 0, F.concat("o_orderpriority", F.lit(sep), clerk)).when(k == 1, F.concat(F.lit('say "'), clerk, F.lit(f'" {sep} or not')))
            .when(k == 2, "").when(k == 3, '"').when(k == 4, F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
        )
        writers.write_csv(src.table("orders").select("o_orderkey", note.alias("note")), path, sep)
        return readers.read_delimited(src.spark, path, _NOTES, sep)

    return run


for _name, _sep in (("a4_quoted_semicolon", ";"), ("a5_quoted_caret", "^"), ("a6_quoted_comma", ",")):
    query(_name, _notes_sql(_sep, "NULL"))(_noted(_sep))


@query("a8_split_extracts", _ORDERS)
def a8(src):
    """Extracts by date ranges, each written on its own, under each other."""
    folder, day = _folder(src), F.col("o_orderdate")
    bounds = (day < "1994-01-01", (day >= "1994-01-01") & (day < "1997-01-01"), (day >= "1997-01-01") | day.isNull())
    frames = []
    for k, inside in enumerate(bounds):
        writers.write_table(_orders(src).where(inside), f"{folder}/{k}")
        frames.append(src.spark.read.parquet(f"{folder}/{k}"))
    return readers.stack_extracts(frames)


@query("a12_truncated_table", _ORDERS)
def a12(src):
    """A table written twice holds the second content alone."""
    path = _folder(src)
    for rows in (_orders(src).withColumn("o_orderkey", -F.col("o_orderkey")), _orders(src)):
        writers.truncate_table(rows, path)
    return src.spark.read.parquet(path)


@query("a14_published_table", _ORDERS)
def a14(src):
    """A table created, then replaced, under a catalog name."""
    name = "published_" + uuid.uuid4().hex
    writers.publish(_orders(src).withColumn("o_orderkey", -F.col("o_orderkey")), name)
    writers.publish(_orders(src), name, overwrite=True)
    return readers.scan_table(src.spark, name)


@query("a10_bucketed_scoring_mart")
def a10_mart(src):
    """The loan scoring mart in unit buckets of its department."""
    path = _folder(src)
    writers.write_range_bucketed(QUERIES["j20_loan_scoring"](src.spark, src.sf_dir), path, "department_id_scoring")
    return src.spark.read.parquet(path)


ORACLE["a10_bucketed_scoring_mart"] = f"""SELECT *, CASE WHEN department_id_scoring >= 0 AND department_id_scoring < 200 THEN CAST(department_id_scoring AS INT) END AS bucket
  FROM ({ORACLE['j20_loan_scoring']})"""


@query(
    "j3_usd_rates_from_currency",
    """SELECT user_id, d, amount, amount * coalesce(rate, 1) AS amount_usd FROM
         (SELECT user_id, CAST(ts AS DATE) AS d, CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount,
                 CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END AS currency FROM events) e
       LEFT JOIN (SELECT base, rate_date, max(rate) AS rate FROM (
           SELECT *, count(*) OVER (PARTITION BY base, quote, rate_date ORDER BY update_time DESC) AS n FROM (
             SELECT currency AS base, CASE WHEN requested_amount % 2 = 0 THEN 'USD' ELSE 'EUR' END AS quote,
                    CAST(update_time AS DATE) AS rate_date, update_time, requested_amount AS rate FROM loan_application)) WHERE n = 1 AND quote = 'USD'
         GROUP BY 1, 2) r ON e.currency = r.base AND e.d = r.rate_date""",
    "loan_application",
)
def j3_rates(src):
    """From raw currency loads to converted amounts: newest versions, those to USD, one per day."""
    from ..operators import fx
    from ..plans.warehouse import build_currency

    raw = src["loan_application"].select(
        F.col("currency").alias("base"),
        F.when(F.col("requested_amount") % 2 == 0, "USD").otherwise("EUR").alias("quote"),
        F.col("update_time").cast("date").alias("rate_date"), "update_time", F.col("requested_amount").alias("rate"),
    )
    currency = F.expr("CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END").alias("currency")
    amount = F.floor(F.col("value") * 100 + 0.5).cast("long").alias("amount")
    rows = src.table("events").select("user_id", F.col("ts").cast("date").alias("d"), amount, currency)
    return fx.to_usd(rows, fx.usd_rates(build_currency(raw)), ["amount"], date="d").drop("currency")
