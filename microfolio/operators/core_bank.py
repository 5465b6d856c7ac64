"""Core-banking extracts: text dates, text amounts, loan ids inside account numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import core_date, to_number

# Fixed codes of loan movements in the core-banking extract.
PAYMENT_CODES = ("423", "420", "434", "750", "751", "752")
AMOUNT_CODES = ("420", "408", "423", "434", "750", "751", "402", "752")


def parse_dates(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: core_date(c) for c in cols})


def loan_movements(raw: DataFrame) -> DataFrame:
    """Rows that concern loans: disbursements, movements with a loan amount, one bulk code."""
    amounts = (to_number("priamt") > 0) | (to_number("intamt") > 0) | (to_number("penamt") > 0)
    code = F.col("trncode")
    return raw.where(
        ((code == "402") & (F.substring("acc", 1, 2) == "LD"))
        | (code.isin(*AMOUNT_CODES) & amounts)
        | ((code == "430") & (F.substring("trnid", 1, 1) == "1"))
    )


def loan_payments(raw: DataFrame) -> DataFrame:
    """Daily paid totals per loan from the core-banking movements.

    A past-due account carries the loan id after its two-letter prefix.
    """
    rows = parse_dates(loan_movements(raw), ["trndate", "valuedate"]).where(F.col("trncode").isin(*PAYMENT_CODES))
    loan = F.when(F.substring("acc", 1, 2) == "PD", F.substring("acc", 3, 12)).otherwise(F.substring("acc", 1, 12))
    return rows.groupBy(loan.alias("contract_id"), F.col("trndate").cast("date").alias("event_date")).agg(
        F.sum(to_number("trnamt")).alias("total_paid"),
        F.sum(to_number("priamt")).alias("capital_paid"),
        F.sum(to_number("intamt")).alias("interest_paid"),
        F.sum(to_number("penamt")).alias("penalty_paid"),
    )


def split_components(schedule: DataFrame) -> DataFrame:
    """Capital and interest of each instalment as typed rows with a positive amount."""
    keys = [c for c in schedule.columns if c not in ("capital_due", "interest_due", "total_due")]
    long = schedule.select(
        *keys, F.col("capital_due").alias("Capital"), F.col("interest_due").alias("Interest")
    ).unpivot(keys, ["Capital", "Interest"], "type", "due_amount")
    return long.where(F.col("due_amount") > 0)
