"""Warehouse tables from raw, versioned extracts.

Each builder adds the version number, the validity end where the table has one, decoded names
and amounts in USD. Versions are computed before the decode and rate joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.decode import decode
from ..operators.fx import to_usd
from ..operators.versioning import first_version, latest_snapshot, version_counter, with_history


def build_dictionary(raw: DataFrame, date: str = "update_date") -> DataFrame:
    """Rows of the newest dictionary load only."""
    return latest_snapshot(raw, date)


def build_currency(raw: DataFrame, keys=("base", "quote", "rate_date"), date: str = "update_time") -> DataFrame:
    """Newest version of each rate; rates whose newest load is duplicated drop out."""
    keys = list(keys)
    rest = [c for c in raw.columns if c not in (*keys, date)]
    return first_version(raw, keys, date, rest)


def build_transaction(raw: DataFrame, dictionary: DataFrame, rates: DataFrame) -> DataFrame:
    out = version_counter(raw, ["transaction_id"], "transaction_time")
    out = decode(
        out,
        dictionary,
        {"department_id": ("DEPARTMENT_ID", "department_name"), "code": ("TRANSACTION_TYPE_CODE", "transaction_type_name")},
    )
    return to_usd(out, rates, [c for c in ("amount", "fee_amount", "commission_amount") if c in raw.columns], date="transaction_time")


def build_portfolio_manager(raw: DataFrame, dictionary: DataFrame, tiebreak: list[str]) -> DataFrame:
    levels = [
        "department_id",
        *(f"company_sublevel{i}_id" for i in (1, 2, 3)),
        *(f"department_sublevel{i}_id" for i in (1, 2, 3)),
    ]
    out = with_history(raw, ["portfolio_manager_id"], "update_date", tiebreak)
    fields = {c: (c.upper(), c.replace("_id", "_name")) for c in levels if c in raw.columns}
    return decode(out, dictionary, fields)


def build_customer(raw: DataFrame, dictionary: DataFrame, tiebreak: list[str], exact_case: bool = False) -> DataFrame:
    """Customer with four decoded names; ``exact_case`` is the older form of the same table."""
    out = with_history(raw, ["customer_id"], "update_date", tiebreak)
    fields = {
        "area_code": ("CUSTOMER_AREA_CODE", "area_name"),
        "sector_code": ("SECTOR_CODE", "sector_name"),
        "subsector_code": ("SUBSECTOR_CODE", "subsector_name"),
        "department_id": ("DEPARTMENT_ID", "department_name"),
    }
    return decode(out, dictionary, fields, exact_case)


BALANCE_AMOUNTS = ["capital_balance", "interest_balance", "unpaid_fee_balance", "available_balance"]


def build_account_balance(raw: DataFrame, dictionary: DataFrame, rates: DataFrame) -> DataFrame:
    out = version_counter(raw, ["account_id"], "balance_date")
    out = decode(out, dictionary, {"account_code": ("ACCOUNT_CODE", "account_product_name")})
    return to_usd(out, rates, [c for c in BALANCE_AMOUNTS if c in raw.columns], date="balance_date")


def build_account(raw: DataFrame, dictionary: DataFrame, rates: DataFrame, tiebreak: list[str]) -> DataFrame:
    out = with_history(raw, ["account_id"], "update_date", tiebreak)
    fields = {
        "department_id": ("DEPARTMENT_ID", "department_name"),
        "account_code": ("ACCOUNT_CODE", "account_product_name"),
    }
    return to_usd(decode(out, dictionary, fields), rates, ["overdraft_amount"])


def build_loan(raw: DataFrame, dictionary: DataFrame, rates: DataFrame, tiebreak: list[str]) -> DataFrame:
    out = with_history(raw, ["loan_id"], "update_date", tiebreak)
    fields = {
        "department_id": ("DEPARTMENT_ID", "department_name"),
        "product_code": ("LOAN_PRODUCT_CODE", "product_name"),
    }
    return to_usd(decode(out, dictionary, fields), rates, ["net_disbursed_amount", "capital_disbursed_amount"])


def build_loan_application(raw: DataFrame, dictionary: DataFrame, rates: DataFrame) -> DataFrame:
    out = version_counter(raw, ["application_id"], "update_time")
    fields = {
        "stage_code": ("LOANAPPLICATION_STAGE_CODE", "stage_name"),
        "department_id": ("DEPARTMENT_ID", "department_name"),
        "purpose_code": ("LOAN_PURPOSE_CODE", "purpose_name"),
        "product_code": ("LOAN_PRODUCT_CODE", "product_name"),
        "end_code": ("LOANAPPLICATION_END_CODE", "end_name"),
    }
    fields = {c: f for c, f in fields.items() if c in raw.columns}
    amounts = ["requested_amount", "reviewed_amount", "approved_amount"]
    return to_usd(decode(out, dictionary, fields), rates, amounts, date="update_time")


def build_schedule(raw: DataFrame, current_loans: DataFrame, rates: DataFrame) -> DataFrame:
    """Instalment versions of current loans. ``current_loans`` has one row per loan id."""
    out = version_counter(raw, ["contract_id", "instalment"], "update_date")
    loans = current_loans.select(F.col("loan_id").alias("__loan"))
    out = out.join(loans, F.col("contract_id") == F.col("__loan"), "left_semi")
    return to_usd(out, rates, ["total_due", "capital_due", "interest_due"])


LOAN_BALANCE_AMOUNTS = [
    "principal_outstanding",
    "principal_overdue",
    "interest_outstanding",
    "interest_overdue",
    "penalty_overdue",
]


def build_loan_balance(raw: DataFrame, current_loans: DataFrame, dictionary: DataFrame, rates: DataFrame) -> DataFrame:
    """Balances with the attributes of the current loan; all amounts at the balance day's rate."""
    out = version_counter(raw, ["loan_id"], "balance_date")
    extra = [c for c in current_loans.columns if c not in raw.columns]
    loans = current_loans.select(F.col("loan_id").alias("__loan"), *extra)
    out = out.join(loans, F.col("loan_id") == F.col("__loan"), "left").drop("__loan")
    out = decode(
        out,
        dictionary,
        {"product_code": ("LOAN_PRODUCT_CODE", "product_name"), "department_id": ("DEPARTMENT_ID", "department_name")},
    )
    loan_amounts = [c for c in ("net_disbursed_amount", "capital_disbursed_amount") if c in extra]
    return to_usd(out, rates, LOAN_BALANCE_AMOUNTS + loan_amounts, date="balance_date")


EVENT_AMOUNTS = [
    "total_paid",
    "capital_paid",
    "interest_paid",
    "penalty_paid",
    "capital_remaining",
    "interest_remaining",
]


def build_event(raw: DataFrame, rates: DataFrame) -> DataFrame:
    """Payment events; USD at the due day's rate, to compare with the schedule."""
    out = version_counter(raw, ["contract_id", "instalment", "transaction_id"], "event_time")
    return to_usd(out, rates, EVENT_AMOUNTS, date="due_date")
