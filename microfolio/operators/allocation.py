"""Spreading payments over instalments.

Both sides of a contract are sequences of intervals on one money axis: instalment i covers
(cumulative due before i, cumulative due with i], payment j covers the same for cumulative
paid. A payment settles the part of an instalment where the two intervals overlap.

Both sides are summed first: payments per contract and day, dues per contract, day and instalment, however
many raw rows there are. The sums lie by contract and day, so a contract with many raw rows is spread over its days.
Then both sides are laid out by contract once, and running totals, the overlap join, the rests left by earlier payments and
whatever else works on a contract need no further exchange. On large tables the layout has as many parts as their rows need,
so that what one task holds does not grow with the input. Only contracts of more than ``LARGE`` rows, if there are any, are cut into
blocks of neighbouring days: their running totals are prefix sums in two levels, inside a block and over the totals of the
blocks before it. Amounts that are not negative give at most instalments + payments pairs; reversals (negative day
totals) only widen intervals, so one plan serves all contracts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import (
    CAPITAL_CODES,
    CAPITAL_DECREASE_CODE,
    INTEREST_CODES,
    PAYMENT_CODES,
    count_if,
    sum_if,
    whole_days,
)
from ..session import dealt, parts_for, staged
from .joins import null_safe_join

COMPONENTS = ("total", "capital", "interest")


def daily_payments(
    txn: DataFrame,
    contract: str = "contract_id",
    when: str = "event_date",
    amount: str = "amount",
    code: str = "code",
    codes=PAYMENT_CODES,
    parts: int | None = None,
) -> DataFrame:
    """Paid totals per contract and day, split by payment code, with the number of capital decreases."""
    rows = txn.where(F.col(code).isin(*codes)).select(
        F.col(contract).alias("contract_id"),
        F.col(when).cast("date").alias("event_date"),
        F.col(amount).alias("amount"),
        F.col(code).alias("code"),
    )
    c = F.col("code")
    return (
        dealt(rows, parts, "contract_id", "event_date")
        .groupBy("contract_id", "event_date")
        .agg(
            F.sum("amount").alias("total_paid"),
            sum_if(c.isin(*CAPITAL_CODES), "amount").alias("capital_paid"),
            sum_if(c.isin(*INTEREST_CODES), "amount").alias("interest_paid"),
            count_if(c == CAPITAL_DECREASE_CODE).alias("capital_decreases"),
        )
    )


def daily_dues(schedule: DataFrame, opening: DataFrame | None = None, parts: int | None = None) -> DataFrame:
    """Due amounts per contract, due date and instalment; opening arrears are instalment 0 at their snapshot date.

    ``schedule``: contract_id, instalment, due_date, capital_due, interest_due.
    ``opening``: contract_id, balance_date, principal_overdue, interest_overdue.
    """
    rows = schedule.select("contract_id", "instalment", "due_date", "capital_due", "interest_due")
    if opening is not None:
        arrears = opening.where((F.col("principal_overdue") > 0) | (F.col("interest_overdue") > 0)).select(
            "contract_id",
            F.lit(0).alias("instalment"),
            F.col("balance_date").alias("due_date"),
            "principal_overdue",
            "interest_overdue",
        )
        rows = rows.union(arrears)
    return dealt(rows, parts, "contract_id", "due_date").groupBy("contract_id", "due_date", "instalment").agg(
        F.sum("capital_due").alias("capital_due"),
        F.sum("interest_due").alias("interest_due"),
        F.sum(F.col("capital_due") + F.col("interest_due")).alias("total_due"),
    )


DUE_ORDER = ("due_date", "instalment")


#: Days of one large contract that share a block, and the block of all others and of rows without a date.
BLOCK, ONE_BLOCK = "QUARTER", "0001-01-01"

#: Rows of a contract from which on it is cut into blocks.
LARGE = 1000


def large_contracts(*tables: DataFrame) -> DataFrame:
    """Contracts with more than ``LARGE`` rows in all tables together, as a stage table."""
    ids = reduce(DataFrame.union, [t.select("contract_id") for t in tables])
    counted = ids.groupBy("contract_id").agg(F.count(F.lit(1)).alias("rows"))
    return staged(counted.where(F.col("rows") > LARGE).select("contract_id", F.lit(True).alias("is_large")), "large-contracts")


def _plus(inside, before):
    """Sum of two running totals, NULL where both are."""
    return F.coalesce(inside + before, inside, before)


def cumulate(
    rows: DataFrame,
    order: str | tuple[str, ...],
    kind: str,
    components=COMPONENTS,
    parts: int | None = None,
    large: DataFrame | None = None,
    laid: bool = False,
) -> DataFrame:
    """Running totals with and without the row's own amount, per contract along ``order``, and the row's ``{kind}_block``.

    ``rows`` has one row per contract and order value, whose first column is a date. NULL amounts leave
    the running total unchanged; rows without a date come first. ``large``: see :func:`large_contracts`, counted from the rows
    if not given. ``laid`` tells that the rows lie by contract already; the result does, too.
    """
    order = (order,) if isinstance(order, str) else tuple(order)
    large = large_contracts(rows) if large is None else large
    block, one = f"{kind}_block", F.lit(ONE_BLOCK).cast("date")
    keys = ["contract_id", block]
    cut = not large.isEmpty()
    if cut:
        rows = null_safe_join(rows, large, ["contract_id"])
        days = F.coalesce(F.trunc(order[0], BLOCK), one)
        rows = rows.withColumn(block, F.when(F.col("is_large"), days).otherwise(one))
        rows = dealt(rows, parts, *keys)
    elif not laid:
        rows = rows.repartition(parts, "contract_id") if parts else rows.repartition("contract_id")
    if not cut:
        rows = rows.withColumn(block, one)
    along = Window.partitionBy(*keys).orderBy(*order)
    with_own = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    run = rows.withColumns(
        {f"{c}_{kind}_cum": F.sum(f"{c}_{kind}").over(with_own) for c in components}
        | {f"prev_{c}_{kind}_cum": F.sum(f"{c}_{kind}").over(before) for c in components}
    )
    if cut:
        earlier = Window.partitionBy("contract_id").orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
        totals = rows.where("is_large").groupBy(*keys).agg(*[F.sum(f"{c}_{kind}").alias(f"{c}_total") for c in components])
        carried = totals.select(*keys, *[F.sum(f"{c}_total").over(earlier).alias(f"{c}_before") for c in components])
        run = null_safe_join(run.drop("is_large"), staged(carried, "carried"), keys)
        run = run.withColumns(
            {n: _plus(F.col(n), F.col(f"{c}_before")) for c in components for n in (f"{c}_{kind}_cum", f"prev_{c}_{kind}_cum")}
        )
        run = dealt(run.drop(*[f"{c}_before" for c in components]), parts, "contract_id")
    return run.withColumns({n: F.coalesce(n, F.lit(0)) for n in (f"prev_{c}_{kind}_cum" for c in components)})


def due_side(schedule: DataFrame, opening: DataFrame | None = None, parts: int | None = None, large: DataFrame | None = None) -> DataFrame:
    large = large_contracts(schedule) if large is None else large
    return cumulate(daily_dues(schedule, opening, parts), DUE_ORDER, "due", parts=parts, large=large)


def paid_side(payments: DataFrame, parts: int | None = None, large: DataFrame | None = None) -> DataFrame:
    """``payments``: one row per contract and day, as from :func:`daily_payments`."""
    return cumulate(payments, "event_date", "paid", parts=parts, large=large)


def _pairs(due: DataFrame, paid: DataFrame) -> DataFrame:
    """All (instalment, payment) pairs of a contract whose cumulative intervals overlap."""
    overlap = (F.col("total_paid_cum") > F.col("prev_total_due_cum")) & (F.col("prev_total_paid_cum") < F.col("total_due_cum"))
    payer = paid.withColumnRenamed("contract_id", "payer").drop("paid_block")
    return due.drop("due_block").join(payer, (F.col("contract_id") == F.col("payer")) & overlap).drop("payer")


def _settled(c: str):
    """What a payment settles of an instalment's component, in four cases."""
    before = F.col(f"prev_{c}_left")
    paid, paid_cum, paid_before = F.col(f"{c}_paid"), F.col(f"{c}_paid_cum"), F.col(f"prev_{c}_paid_cum")
    due, due_cum, due_before = F.col(f"{c}_due"), F.col(f"{c}_due_cum"), F.col(f"prev_{c}_due_cum")
    return (
        F.when((before > 0) & (paid > before), before)  # the rest of a part-paid instalment
        .when((before == 0) & (paid_cum > due_cum), due)  # the instalment at once
        .when(paid_before < due_before, paid_cum - due_before)  # what earlier instalments left over
        .otherwise(paid)  # the whole payment
    )


def allocate(due: DataFrame, paid: DataFrame, residue: float = 0.00001, components=COMPONENTS) -> DataFrame:
    """Payments spread over instalments, one row per settling (instalment, payment) pair.

    Pairs come from the total amounts. Capital and interest follow the same four cases on
    their own running totals, so single components may be negative or exceed the instalment.
    Pairs settling no more than ``residue`` in total are dropped.
    """
    pairs = _pairs(due, paid)
    w = Window.partitionBy("contract_id", *(c for c in DUE_ORDER if c in pairs.columns)).orderBy("event_date")
    left = pairs.withColumns(
        {f"{c}_left": F.greatest(F.col(f"{c}_due_cum") - F.col(f"{c}_paid_cum"), F.lit(0)) for c in components}
    )
    left = left.withColumns({f"prev_{c}_left": F.coalesce(F.lag(f"{c}_left").over(w), F.lit(0)) for c in components})
    out = left.withColumns({f"{c}_settled": _settled(c) for c in components})
    return out.where(F.col("total_settled") > residue)


def event_calculated(
    schedule: DataFrame, txn: DataFrame, opening: DataFrame | None = None, flag: bool = True
) -> DataFrame:
    """The allocation table: contract, instalment, due date, event date, three paid amounts, decrease flag."""
    parts, large = parts_for(schedule, txn), large_contracts(schedule, txn)
    out = allocate(due_side(schedule, opening, parts, large), paid_side(daily_payments(txn, parts=parts), parts, large))
    cols = [
        "contract_id",
        "instalment",
        "due_date",
        "event_date",
        F.col("total_settled").alias("total_paid"),
        F.col("capital_settled").alias("capital_paid"),
        F.col("interest_settled").alias("interest_paid"),
    ]
    if flag:
        cols.append((F.col("capital_decreases") > 0).cast("int").alias("capital_decrease_flag"))
    return out.select(*cols)


def shift_capital_decrease(events: DataFrame, keep_zero: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Move the capital part of capital decreases to the due date; interest keeps its event date.

    Both parts of a row are emitted from one scan and summed again per (contract, instalment,
    due date, event date). Groups with no capital and no interest go unless ``keep_zero``.
    ``keep`` names further columns that depend on the contract only.
    """
    zero = F.lit(0)
    parts = F.array(
        F.struct(
            F.when(F.col("capital_decrease_flag") == 1, F.col("due_date")).otherwise(F.col("event_date")).alias("d"),
            F.col("capital_paid").alias("c"),
            (F.col("capital_paid") * 0).alias("i"),
        ),
        F.struct(
            F.col("event_date").alias("d"),
            (F.col("capital_paid") * 0).alias("c"),
            (F.col("total_paid") - F.col("capital_paid")).alias("i"),
        ),
    )
    out = (
        events.select("contract_id", "instalment", "due_date", *keep, F.explode(parts).alias("p"))
        .groupBy("contract_id", "instalment", "due_date", F.col("p.d").alias("event_date"), *keep)
        .agg(
            F.sum(F.col("p.c") + F.col("p.i")).alias("total_paid"),
            F.sum("p.c").alias("capital_paid"),
            F.sum("p.i").alias("interest_paid"),
        )
    )
    if not keep_zero:
        out = out.where(~((F.col("capital_paid") == zero) & (F.col("interest_paid") == zero)))
    return out.drop("interest_paid")


def schedule_instalments(schedule: DataFrame, loans: DataFrame, txn: DataFrame, since, excluded_product: str) -> DataFrame:
    """First-generation allocation: totals only, for loans since a date and outside one product.

    Instalments on or before the disbursement date are left out. Adds the principal-decrease flag.
    """
    target = loans.where(
        (F.col("disbursement_date") >= F.lit(since)) & (F.col("product_code") != excluded_product)
    ).select("loan_id", "customer_id", "currency", "disbursement_date", "capital_disbursed_amount")
    parts, large = parts_for(schedule, txn), large_contracts(schedule, txn)
    target = dealt(target, parts, "loan_id")
    amounts = schedule.select("contract_id", "due_date", (F.col("capital_due") + F.col("interest_due")).alias("total_due"))
    daily = dealt(amounts, parts, "contract_id", "due_date").groupBy("contract_id", "due_date").agg(F.sum("total_due").alias("total_due"))
    own = (F.col("contract_id") == F.col("loan_id")) & (F.col("due_date") > F.col("disbursement_date"))
    days = (
        dealt(daily, parts, "contract_id")
        .join(target.select("loan_id", "disbursement_date"), own)
        .groupBy("contract_id", "due_date")  # a loan may be listed more than once
        .agg(F.sum("total_due").alias("total_due"))
    )
    paid = (
        dealt(txn.select("contract_id", "event_date", "amount", "code"), parts, "contract_id", "event_date")
        .groupBy("contract_id", "event_date")
        .agg(F.sum("amount").alias("total_paid"), count_if(F.col("code") == CAPITAL_DECREASE_CODE).alias("decreases"))
    )
    paid = dealt(paid, parts, "contract_id").join(target.select("loan_id"), F.col("contract_id") == F.col("loan_id"), "left_semi")
    only = ("total",)
    due = cumulate(days, "due_date", "due", only, parts, large, laid=True)
    paid = cumulate(paid, "event_date", "paid", only, parts, large, laid=True)
    out = allocate(due, paid, float("-inf"), only)
    return out.join(target, F.col("contract_id") == F.col("loan_id"), "left").select(
        "customer_id",
        "contract_id",
        "disbursement_date",
        "currency",
        "capital_disbursed_amount",
        "due_date",
        F.col("total_due").alias("amount_due"),
        F.col("total_due_cum").alias("amount_due_cum"),
        "event_date",
        F.col("total_paid").alias("amount_paid"),
        F.col("total_paid_cum").alias("amount_paid_cum"),
        F.col("total_settled").alias("instalment_paid"),
        F.when(F.col("decreases") > 0, 1).otherwise(0).alias("principal_decrease_flag"),
    )


def delay_histogram(instalments: DataFrame) -> DataFrame:
    """Whole-day delay of principal decreases and how often it occurs (allocations above 1 only)."""
    return (
        instalments.where((F.col("principal_decrease_flag") == 1) & (F.col("instalment_paid") > 1))
        .groupBy(whole_days("due_date", "event_date").alias("delay"))
        .agg(F.count(F.lit(1)).alias("obs"))
    )


def instalment_numbers(instalments: DataFrame) -> DataFrame:
    """Running instalment number per contract by due date, on every row; equal due dates share it.

    For frames bounded by the calendar per contract (allocated payments, accepted instalments).
    """
    w = Window.partitionBy("contract_id").orderBy("due_date")
    return instalments.withColumn("instalment_number", F.dense_rank().over(w))


def advance_classes(instalments: DataFrame) -> DataFrame:
    """Payments counted by three marks: before the due date, below one unit, early termination.

    A payment belongs to an early termination when neither it nor any later one of the
    contract was made on or after its due date.
    """
    days = whole_days("due_date", "event_date")
    late = Window.partitionBy("contract_id").orderBy(F.col("event_date").desc(), F.col("due_date").desc())
    marked = instalments.withColumn("days", days).withColumn(
        "not_before_cum", F.sum(F.when(F.col("days") >= 0, 1).otherwise(0)).over(late)
    )
    return marked.groupBy(
        F.when(F.col("days") < 0, 1).otherwise(0).alias("negative_days"),
        F.when(F.col("instalment_paid") < 1, 1).otherwise(0).alias("rounding_issues"),
        F.when(F.col("not_before_cum") == 0, 1).otherwise(0).alias("early_terminations"),
    ).agg(F.count(F.lit(1)).alias("payments"))
