"""Scoring marts: loans, instalments, payments and savings with a scoring department.

``departments`` maps department_id to department_id_scoring. Amount columns in several currencies
are named ``<amount>_khr``, ``<amount>_usd`` and ``<amount>_thb``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import STAFF_PRODUCTS, STAFF_PRODUCTS_FIRST, to_long, zero_if_null
from ..operators.allocation import shift_capital_decrease
from ..operators.fx import to_three, to_usd
from ..operators.versioning import latest_snapshot, primary_department, version_counter
from ..session import dealt, parts_for


def _with_department(
    df: DataFrame, loans: DataFrame, departments: DataFrame, amount: str, parts: int | None = None
) -> DataFrame:
    best = primary_department(loans, departments, amount).select(
        F.col("customer_id").alias("__c"), "department_id_scoring"
    )
    return dealt(df, parts, "customer_id").join(best, F.col("customer_id") == F.col("__c"), "left").drop("__c")


def _last_payment(events: DataFrame, when: str) -> DataFrame:
    return events.groupBy(F.col("contract_id").alias("__p")).agg(F.max(when).cast("date").alias("last_payment_date"))


def loan_scoring(
    loans: DataFrame, balances: DataFrame, events: DataFrame, departments: DataFrame
) -> DataFrame:
    """Current loans with the status of the last balance snapshot.

    ``loans``: current rows with capital_disbursed_amount_usd. A loan missing from the last
    snapshot is CLOSE and ends at its last payment, or at the given end date without one.
    """
    last = latest_snapshot(balances, "balance_date").select(
        F.col("loan_id").alias("__b"),
        F.col("status").alias("__status"),
        "principal_outstanding",
        *[c for c in ("principal_outstanding_usd",) if c in balances.columns],
    )
    out = loans.join(last, F.col("loan_id") == F.col("__b"), "left").join(
        _last_payment(events, "event_time"), F.col("loan_id") == F.col("__p"), "left"
    )
    status = F.when(F.col("principal_outstanding").isNull(), F.lit("CLOSE")).otherwise(F.col("__status"))
    out = out.withColumn("status", status)
    out = out.withColumns(
        {
            "end_date": F.when(F.col("status") == "CLOSE", F.coalesce("last_payment_date", "end_date")),
            "optout_flag": F.lit(False),
            "variable_schedule_flag": F.coalesce(F.col("payment_type") == "FLEXIBLE", F.lit(False)),
            "loan_staff_flag": F.coalesce(F.col("product_code").isin(*STAFF_PRODUCTS), F.lit(False)),
        }
    ).drop("__b", "__status", "__p", "last_payment_date")
    return _with_department(out, loans, departments, "capital_disbursed_amount_usd")


def schedule_scoring(
    schedule: DataFrame, loans: DataFrame, balances: DataFrame, departments: DataFrame, rates: DataFrame
) -> DataFrame:
    """Current instalments that are not skipped, with loan status, department and USD amounts.

    ``schedule``: newest instalment versions (contract_id, instalment, due_date, update_date,
    currency, status, total_due, capital_due).
    """
    kept = schedule.where(F.col("status").isNull() | (F.upper("status") != "SKIPPED")).drop("status")
    loan = loans.select(
        F.col("loan_id").alias("__l"), "customer_id", "product_code", F.col("status").alias("loan_status")
    )
    last = latest_snapshot(balances, "balance_date").select(F.col("loan_id").alias("__b"), F.col("status").alias("__s"))
    out = (
        kept.join(loan, F.col("contract_id") == F.col("__l"), "left")
        .join(last, F.col("__l") == F.col("__b"), "left")
        .withColumn("loan_status", F.coalesce("__s", "loan_status"))
        .drop("__l", "__b", "__s")
    )
    out = _with_department(out, loans, departments, "capital_disbursed_amount")
    return to_usd(out, rates, ["total_due", "capital_due"])


def saving_scoring(
    balances: DataFrame, accounts: DataFrame, loans: DataFrame, departments: DataFrame, rates: DataFrame
) -> DataFrame:
    """Account balances with account type, department and three currencies at the balance day."""
    kinds = accounts.select(F.col("account_id").alias("__a"), "account_type")
    out = balances.join(kinds, F.col("account_id") == F.col("__a"), "left").drop("__a")
    out = _with_department(out, loans, departments, "capital_disbursed_amount")
    return to_three(out, rates, ["available_balance"], date="balance_date")


def schedule_scoring_fixed(
    schedule: DataFrame, loans: DataFrame, departments: DataFrame, rates: DataFrame, rate_date
) -> DataFrame:
    """First form: running instalment number, missing amounts as 0, currencies at one fixed day.

    ``schedule``: reconciled instalments. An instalment's number counts the contract's rows up to its due
    date, so rows of one due date share the number of the last one.
    """
    rows = schedule.select("contract_id", "due_date", "currency", "capital_due", "interest_due")
    numbered = version_counter(rows, ["contract_id"], "due_date", "instalment_number", oldest_first=True)
    amounts = numbered.withColumns(
        {
            "instalment_number": F.col("instalment_number").cast("int"),
            "capital_due": zero_if_null("capital_due"),
            "interest_due": zero_if_null("interest_due"),
        }
    )
    amounts = amounts.withColumn("total_due", F.col("capital_due") + F.col("interest_due")).drop("interest_due")
    loan = loans.select(F.col("loan_id").alias("__l"), "customer_id", "product_code", "status")
    out = amounts.join(loan, F.col("contract_id") == F.col("__l"), "left").drop("__l")
    out = _with_department(out, loans, departments, "capital_disbursed_amount")
    return to_three(out, rates, ["total_due", "capital_due"], fixed_date=rate_date)


def event_scoring(
    calculated: DataFrame,
    loans: DataFrame,
    balances: DataFrame,
    departments: DataFrame,
    rates: DataFrame,
    rate_date,
    final: bool = True,
    published_names: bool = False,
) -> DataFrame:
    """Allocated payments with early-termination flag, department and three currencies at one day.

    ``balances`` is the closing snapshot (loan_id, status). ``final=False`` is the earlier form:
    the flag ignores the due date and rows without any amount stay. ``published_names`` adds two
    amounts under the misleading names they were once published with.
    """
    # the last payment is taken along from the allocation, which is then computed only once
    latest = F.max("event_date").over(Window.partitionBy("contract_id"))
    paid = shift_capital_decrease(
        calculated.withColumn("last_payment_date", latest), not final, ("last_payment_date",)
    )
    closing = balances.select(F.col("loan_id").alias("__b"), F.col("status").alias("__status"))
    # the department belongs to the loan's customer, so it joins the loans, not their payments
    loan = loans.select(F.col("loan_id").alias("__l"), "maturity_date", "currency", "customer_id")
    loan = _with_department(loan, loans, departments, "capital_disbursed_amount", parts_for(loans))
    out = (
        paid.join(closing, F.col("contract_id") == F.col("__b"), "left")
        .join(loan, F.col("contract_id") == F.col("__l"), "left")
    )
    early = (F.col("__status").isNull() | (F.col("__status") == "CLOSED")) & (
        F.col("last_payment_date") < F.col("maturity_date")
    )
    if final:
        early = early & (F.col("due_date") > F.col("last_payment_date"))
    out = out.withColumn("early_termination_flag", F.coalesce(early, F.lit(False))).drop(
        "__b", "__l", "__status", "last_payment_date", "maturity_date"
    )
    out = out.select(*[c for c in out.columns if c != "department_id_scoring"], "department_id_scoring")
    out = to_three(out, rates, ["total_paid", "capital_paid"], fixed_date=rate_date)
    if published_names:
        out = out.withColumns(
            {"total_due_amount_usd": F.col("total_paid_usd"), "total_paid_amount_khr_thb": F.col("total_paid_thb")}
        )
    return out


def loan_scoring_first(
    loans: DataFrame, calculated: DataFrame, departments: DataFrame, rates: DataFrame
) -> DataFrame:
    """First form: whole amounts, end date = last payment of closed loans, rates of the update day."""
    out = loans.withColumn("capital_disbursed_amount", to_long("capital_disbursed_amount")).join(
        _last_payment(calculated, "event_date"), F.col("loan_id") == F.col("__p"), "left"
    )
    out = out.withColumns(
        {
            "end_date": F.when(F.col("status") == "CLOSED", F.col("last_payment_date")),
            "recommendation_id": F.lit(None).cast("string"),
            "optout_flag": F.lit(False),
            "variable_schedule_flag": F.lit(0),
            "loan_staff_flag": F.coalesce(F.col("product_code").isin(*STAFF_PRODUCTS_FIRST), F.lit(False)),
        }
    ).drop("__p", "last_payment_date")
    out = _with_department(out, loans, departments, "capital_disbursed_amount", parts_for(loans))
    return to_three(out, rates, ["capital_disbursed_amount"], date="update_date", round_khr=True)
