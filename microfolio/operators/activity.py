"""Customer activity and completeness of instalment calendars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import month_of, months_before


def changed(balances: DataFrame, key: str, date: str, amount, keep: list[str]) -> DataFrame:
    """Balances that differ from the one before them, over the whole history.

    One row per key and day is expected, so a key has at most one row per calendar day.
    """
    w = Window.partitionBy(key).orderBy(F.col(date).desc())
    value = F.col(amount) if isinstance(amount, str) else amount
    rows = balances.select(*keep, key, date, value.alias("__v")).withColumn("__before", F.lead("__v").over(w))
    return rows.where(F.col("__v") != F.col("__before")).drop("__v", "__before")


def active_customers(
    loan_balances: DataFrame, transactions: DataFrame, account_balances: DataFrame, as_of, months: int = 6
) -> DataFrame:
    """Customers with a changed loan or account balance or a transaction in the months up to a date.

    Each source is reduced to distinct customers before they are put together.
    """
    day = F.lit(as_of).cast("date")

    def recent(df: DataFrame, date: str) -> DataFrame:
        when = F.col(date).cast("date")
        return df.where((when > months_before(day, months)) & (when <= day)).select("customer_id").distinct()

    loans = changed(
        loan_balances, "loan_id", "balance_date", F.col("principal_outstanding") + F.col("interest_outstanding"), ["customer_id"]
    )
    accounts = changed(account_balances, "account_id", "balance_date", "capital_balance", ["customer_id"])
    people = recent(loans, "balance_date").union(recent(transactions, "event_date")).union(recent(accounts, "balance_date"))
    return people.agg(F.countDistinct("customer_id").alias("customers")).select(day.alias("date"), "customers")


def missing_months(schedule: DataFrame, start, end) -> DataFrame:
    """Months without instalment between a contract's first and last one in a period.

    Gaps between neighbouring months are exploded directly; no spine is joined.
    """
    inside = schedule.where(F.col("due_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    months = inside.select("contract_id", month_of("due_date").alias("m")).distinct()
    every = Window.partitionBy("contract_id")
    gaps = months.select(
        "contract_id",
        F.min("m").over(every).alias("first_month"),
        F.max("m").over(every).alias("last_month"),
        F.add_months(F.lag("m").over(every.orderBy("m")), 1).alias("lo"),
        F.add_months("m", -1).alias("hi"),
    ).where(F.col("lo") <= F.col("hi"))
    return gaps.select(
        "contract_id", "first_month", "last_month", F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month")
    )


def calendar(df: DataFrame, key: str, start, end) -> DataFrame:
    """Every distinct key with every day of a range, by exploding the range per key."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return df.select(key).distinct().withColumn("date", F.explode(days))
