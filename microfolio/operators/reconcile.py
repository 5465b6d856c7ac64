"""Paid against due against overdue: which loans and accounts agree, and by which correction.

Amounts may be in any unit; ``scale`` converts the tolerances (100 for cents).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import (
    CAPITAL_CODES,
    INTEREST_CODES,
    PAYMENT_AND_PENALTY_CODES,
    PENALTY_CODES,
    SAVINGS_CREDIT_CODE,
    classify,
    count_if,
    month_of,
    ratio,
    sum_if,
    tolerance_of,
    zero_if_null,
)
from ..session import dealt, staged
from .joins import null_safe_join
from .versioning import first_version, latest_rows, numbered_versions

R_CODES = (0, 1, 2)  # paid < due, agreed, paid > due


# ---- shared parts -----------------------------------------------------------------------


def paid_by_contract(txn: DataFrame) -> DataFrame:
    """Capital, interest and penalty paid per contract over all days."""
    c = F.col("code")
    return (
        txn.where(c.isin(*PAYMENT_AND_PENALTY_CODES))
        .groupBy("contract_id")
        .agg(
            sum_if(c.isin(*CAPITAL_CODES), "amount").alias("capital_paid"),
            sum_if(c.isin(*INTEREST_CODES), "amount").alias("interest_paid"),
            sum_if(c.isin(*PENALTY_CODES), "amount").alias("penalty_paid"),
        )
    )


def due_by(as_of, closed_until: str | None = "maturity_date") -> Column:
    """Whether an instalment counts: closed loans up to one of their dates, others up to ``as_of`` or maturity.

    With ``closed_until=None`` the status is not looked at.
    """
    day = F.lit(as_of).cast("date")
    running = ((F.col("maturity_date") > day) & (F.col("due_date") <= day)) | (
        (F.col("maturity_date") <= day) & (F.col("due_date") <= F.col("maturity_date"))
    )
    if closed_until is None:
        return running
    closed = F.col("status") == "CLOSED"
    return (closed & (F.col("due_date") <= F.col(closed_until))) | ((F.col("status") != "CLOSED") & running)


def _since(schedule: DataFrame, since) -> DataFrame:
    rows = schedule.where(F.col("due_date") >= F.lit(since).cast("date"))
    return rows.withColumn("due_month", month_of("due_date"))


def due_in_force(
    schedule: DataFrame, loans: DataFrame, as_of, since, closed_until: str | None = "maturity_date"
) -> DataFrame:
    """Due totals per contract from the newest update of each month, after disbursement, up to the cut."""
    newest = latest_rows(_since(schedule, since), ["contract_id", "due_month"], "update_date")
    terms = loans.where(F.col("disbursement_date") >= F.lit(since).cast("date")).select(
        F.col("loan_id").alias("__l"), "disbursement_date", "maturity_date", "end_date", "status"
    )
    return (
        newest.join(terms, F.col("contract_id") == F.col("__l"))
        .where((F.col("due_date") > F.col("disbursement_date")) & due_by(as_of, closed_until))
        .groupBy("contract_id")
        .agg(F.sum("capital_due").alias("capital_due"), F.sum("interest_due").alias("interest_due"))
    )


def _loan_totals(loans, schedule, txn, closing, as_of, since, closed_until) -> DataFrame:
    """Loans disbursed since a date with paid, due and closing amounts, missing ones as 0."""
    money = ["capital_paid", "interest_paid", "capital_due", "interest_due"]
    money += ["principal_overdue", "principal_outstanding", "interest_overdue", "interest_outstanding"]
    target = loans.where(F.col("disbursement_date") >= F.lit(since).cast("date"))
    paid = paid_by_contract(txn).drop("penalty_paid").withColumnRenamed("contract_id", "loan_id")
    due = due_in_force(schedule, loans, as_of, since, closed_until).withColumnRenamed("contract_id", "loan_id")
    close = closing.select("loan_id", *money[4:])
    out = target.join(paid, "loan_id", "left").join(due, "loan_id", "left").join(close, "loan_id", "left")
    return out.withColumns({m: zero_if_null(m) for m in money})


_OVERDUE = {"capital": "principal_overdue", "interest": "interest_overdue"}


# ---- three SQL steps --------------------------------------------------------------------


def first_step(loans, schedule, txn, closing, component, as_of, since, closed_until="maturity_date", scale=1) -> DataFrame:
    """All loans with ``ok``: -1 paid < due, 0 agreed, 1 paid > due (paid + overdue - due against the tolerance)."""
    out = _loan_totals(loans, schedule, txn, closing, as_of, since, closed_until)
    diff = F.col(f"{component}_paid") + F.col(_OVERDUE[component]) - F.col(f"{component}_due")
    return out.withColumn("ok", classify(diff, "currency", scale=scale))


def _traceable() -> Column:
    """Paid capital explains the outstanding amount exactly."""
    return F.col("capital_disbursed_amount") - F.col("capital_paid") == F.col("principal_outstanding")


def second_step(kos: DataFrame, schedule: DataFrame, component: str, since, traceable_only: bool) -> DataFrame:
    """Add ``ok2`` = 0 where instalments of the previous update explain what was paid too much.

    For loans with paid > due: the newest instalments plus those of the previous update in the
    month that equal the difference must add up to exactly the paid amount.
    """
    paid, due = f"{component}_paid", f"{component}_due"
    target = kos.where(F.col("ok") == 1)
    if traceable_only:
        target = target.where(_traceable())
    target = target.select(
        F.col("loan_id").alias("__l"), "maturity_date", F.col(paid).alias("__paid"), (F.col(paid) - F.col(due)).alias("__gap")
    )
    rows = _since(schedule, since)
    versions = numbered_versions(rows, ["contract_id", "due_month"], "update_date").where(F.col("version") <= 2)
    settled = (
        rows.join(versions, ["contract_id", "due_month", "update_date"])
        .join(target, F.col("contract_id") == F.col("__l"))
        .where(F.col("due_date") <= F.col("maturity_date"))
        .where((F.col("version") == 1) | (F.col("__gap") == F.col(due)))
        .groupBy("__l", "__paid")
        .agg(F.sum(due).alias("__sum"))
        .where(F.col("__paid") == F.col("__sum"))
        .select("__l", F.lit(0).alias("ok2"))
    )
    return kos.join(settled, F.col("loan_id") == F.col("__l"), "left").drop("__l")


def third_step(kos2: DataFrame, loans: DataFrame, schedule: DataFrame, as_of, since) -> DataFrame:
    """Restructured loans with paid < due that agree once instalments replaced by the restructuring go.

    Kept are instalments of schedules older than the loan's update that were due before it, and
    instalments of younger schedules.
    """
    target = kos2.where((F.col("ok") == -1) & F.col("ok2").isNull() & _traceable() & F.col("restructured")).select(
        "loan_id", "capital_paid"
    )
    target = target.join(loans.select("loan_id", F.col("update_date").alias("__changed")), "loan_id", "left")
    older = (F.col("update_date") < F.col("__changed")) & (F.col("due_date") < F.col("__changed"))
    return (
        _since(schedule, since)
        .where((F.col("capital_due") > 0) & (F.col("due_date") <= F.lit(as_of).cast("date")))
        .join(target, F.col("contract_id") == F.col("loan_id"))
        .where(older | (F.col("update_date") > F.col("__changed")))
        .groupBy("loan_id", "capital_paid")
        .agg(F.sum("capital_due").alias("capital_due"))
        .where(F.col("capital_paid") == F.col("capital_due"))
        .withColumn("ok3", F.lit(0))
    )


def outcome_matrix(kos: DataFrame, kos2: DataFrame) -> DataFrame:
    """Loans by first and second outcome."""
    joined = kos.select("loan_id", "ok").join(kos2.select("loan_id", "ok2"), "loan_id", "left")
    return joined.groupBy("ok", "ok2").agg(F.count(F.lit(1)).alias("obs"))


def outside_tolerance(loans, schedule, txn, closing, as_of, since, scale=1) -> DataFrame:
    """Loans that neither agree, nor are fully repaid within tolerance, nor are restructured."""
    out = _loan_totals(loans, schedule, txn, closing, as_of, since, None)
    limit = tolerance_of("currency", scale=scale)
    agreed = F.abs(F.col("capital_paid") + F.col("principal_overdue") - F.col("capital_due")) <= limit
    repaid = F.abs(F.col("capital_disbursed_amount") - F.col("capital_paid")) <= limit
    fine = F.coalesce(agreed, F.lit(False)) | F.coalesce(repaid, F.lit(False)) | F.col("restructured")
    return out.where(~fine)


# ---- the pipeline with net overdue amounts ----------------------------------------------


@dataclass(frozen=True)
class Rules:
    """Parameters of :func:`pipeline`.

    The defaults are the later form: all loans with instalments in the period, opening and
    closing snapshots, consistent loans only, previous instalments matched within tolerance.
    """

    as_of: str
    since: str
    component: str = "capital"
    closed_until: str = "maturity_date"
    scale: int = 1
    use_opening: bool = True
    match_exactly: bool = False
    traceable_only: bool = False
    disbursed_since: bool = False
    after_disbursement: bool = True
    principal_in_last_step: bool = False  # a slip of the earlier form, kept for comparison


EARLIER = dict(
    use_opening=False, match_exactly=True, disbursed_since=True, after_disbursement=False
)


@dataclass(frozen=True)
class Reconciliation:
    """``loans``: one row per loan with its outcomes. ``rows``: instalments with the steps that use them."""

    loans: DataFrame
    rows: DataFrame
    rules: Rules


def pipeline(
    loans: DataFrame,
    schedule: DataFrame,
    txn: DataFrame,
    closing: DataFrame,
    opening: DataFrame | None,
    rules: Rules,
) -> Reconciliation:
    """Three attempts to make paid + change of overdue equal due, per loan.

    1. newest instalments of each month; 2. for paid > due, plus instalments of the previous
    update equal to the difference; 3. for restructured loans with paid < due, without
    instalments replaced by the restructuring. Outcomes are 0 paid < due, 1 agreed, 2 paid > due;
    a step not tried counts 0; ``ok`` is 1 if any step agrees, else the first outcome.
    """
    return pipelines(loans, schedule, txn, closing, opening, [rules])[0]


_SHARED = ("as_of", "since", "scale", "use_opening", "disbursed_since", "after_disbursement")


def pipelines(
    loans: DataFrame,
    schedule: DataFrame,
    txn: DataFrame,
    closing: DataFrame,
    opening: DataFrame | None,
    rules: list[Rules],
) -> list[Reconciliation]:
    """:func:`pipeline` for several components at once, from one state per contract.

    The schedule is read twice: for the two newest updates of each month, and for its rows, which are kept as
    a stage table with a flag per component and step. All sums of steps 1 and 3 come from one
    aggregation of that table and those of step 2 from one over the rows of previous updates; the outcomes are
    the second stage table. The rules may differ by component, cut, matching and last step only.
    """
    r = rules[0]
    if any(getattr(o, k) != getattr(r, k) for o in rules for k in _SHARED) or len({o.component for o in rules}) < len(rules):
        raise ValueError("rules of one run differ by component only in what concerns the component")
    state = staged(_contract_state(loans, schedule, txn, closing, opening, r), "reconcile-state")
    rows = staged(_instalments_in_force(schedule, state, rules), "reconcile-instalments")
    outcomes = staged(_outcomes(state, rows, rules), "reconcile-outcomes")
    return [Reconciliation(_component_loans(outcomes, o), _step_rows(rows, outcomes, o), o) for o in rules]


def _contract_state(loans, schedule, txn, closing, opening, r: Rules) -> DataFrame:
    """One row per loan: its terms, paid totals, both snapshots, and the two newest updates of each month."""
    months = (
        _since(schedule, r.since).groupBy("contract_id", "due_month")
        .agg(F.sort_array(F.collect_set("update_date"), asc=False).alias("dates"), F.min("due_date").alias("first_due"))
    )  # as many dates as there are updates of one month
    newest = F.struct(F.get("dates", F.lit(0)).alias("newest"), F.get("dates", F.lit(1)).alias("previous"))
    updates = months.groupBy(F.col("contract_id").alias("loan_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("due_month", newest.alias("dates")))).alias("updates"),
        F.min("first_due").alias("first_due"),
    )
    if r.disbursed_since:
        terms = loans.where(F.col("disbursement_date") >= F.lit(r.since).cast("date"))
        state = terms.join(updates, "loan_id", "left")
    else:
        inside = updates.where(F.col("first_due") <= F.lit(r.as_of).cast("date"))
        state = inside.join(loans, "loan_id", "left")
    close = closing.select(
        "loan_id",
        F.col("principal_outstanding").alias("outstanding_close"),
        *[F.col(over).alias(f"{c}_overdue_close") for c, over in _OVERDUE.items()],
    )
    state = state.join(paid_by_contract(txn).withColumnRenamed("contract_id", "loan_id"), "loan_id", "left")
    state = state.join(close, "loan_id", "left")
    opened = [f"{c}_overdue_open" for c in _OVERDUE]
    if r.use_opening:
        start = opening.select(
            "loan_id",
            F.col("principal_outstanding").alias("outstanding_open"),
            *[F.col(over).alias(f"{c}_overdue_open") for c, over in _OVERDUE.items()],
        )
        state = state.join(start, "loan_id", "left")
    else:
        state = state.withColumns({c: F.lit(0) for c in ("outstanding_open", *opened)})
    paid = ["capital_paid", "interest_paid", "penalty_paid"]
    closed = ["outstanding_close", *[f"{c}_overdue_close" for c in _OVERDUE]]
    state = state.withColumns({c: zero_if_null(c) for c in (*paid, *closed, "outstanding_open", *opened)})
    start_amount = F.when(F.col("outstanding_open") > 0, F.col("outstanding_open")).otherwise(
        F.col("capital_disbursed_amount")
    )
    state = state.withColumn("start_amount", start_amount)
    if not r.use_opening:
        return state.withColumn("consistent", F.lit(1)).drop("first_due")
    rest = F.col("start_amount") - F.col("outstanding_close") - F.col("capital_paid")
    consistent = F.when(F.abs(rest) > tolerance_of("currency", scale=r.scale), 0).otherwise(1)
    return state.withColumn("consistent", consistent).drop("first_due")


def _instalments_in_force(schedule: DataFrame, state: DataFrame, rules: list[Rules]) -> DataFrame:
    """Instalments of the two newest updates of their month, with what each component's cut and the third step say of them."""
    terms = state.select(
        F.col("loan_id").alias("contract_id"), "disbursement_date", "maturity_date", "end_date", "status", "currency",
        F.col("update_date").alias("changed"), "updates",
    )
    rows = _since(schedule, rules[0].since).join(terms, "contract_id")
    rows = rows.withColumn("dates", F.element_at("updates", F.col("due_month")))
    rows = rows.withColumn("newest", F.col("update_date") == F.col("dates.newest"))
    rows = rows.where(F.col("newest") | (F.col("update_date") == F.col("dates.previous")))
    if rules[0].after_disbursement:
        rows = rows.where(F.col("due_date") > F.col("disbursement_date"))
    counts = {f"{r.component}_counts": F.coalesce(due_by(r.as_of, r.closed_until), F.lit(False)) for r in rules}
    rows = rows.withColumns(counts).where(reduce(lambda a, b: a | b, [F.col(c) for c in counts]))
    unchanged = ((F.col("update_date") < F.col("changed")) & (F.col("due_date") < F.col("changed"))) | (
        F.col("update_date") >= F.col("changed")
    )
    return rows.select(
        "contract_id", "due_date", F.col("update_date").alias("schedule_date"), "currency", "newest", *counts,
        (F.col("newest") & F.coalesce(unchanged, F.lit(False))).alias("unchanged"),
        *[f"{r.component}_due" for r in rules],
    )


def _closes_gap(r: Rules) -> Column:
    """Whether an instalment equals what was paid beyond the first step's sum."""
    gap = F.col(f"{r.component}_paid") - zero_if_null(f"{r.component}_due1")
    due = F.col(f"{r.component}_due")
    same = due == gap if r.match_exactly else (F.abs(due - gap) < tolerance_of("currency", scale=r.scale))
    return F.coalesce(same, F.lit(False))


def _outcomes(state: DataFrame, rows: DataFrame, rules: list[Rules]) -> DataFrame:
    """The state with sums, outcomes of the three steps and the verdict, per component."""
    named = F.col("contract_id").alias("loan_id")
    plain, later = [], []
    for r in rules:
        c, counts = r.component, F.col(f"{r.component}_counts")
        due = F.col(f"{c}_due")
        plain += [
            F.sum(F.when(counts & F.col("newest"), due)).alias(f"{c}_due1"),
            F.sum(F.when(counts & F.col("unchanged"), due)).alias(f"{c}_due3"),
        ]
        later.append(F.sum(F.when(counts & _closes_gap(r), due)).alias(f"{c}_more"))
    out = state.drop("updates").join(rows.groupBy(named).agg(*plain), "loan_id", "left")
    over = [F.col("loan_id").alias("contract_id")] + [f"{r.component}_{k}" for r in rules for k in ("paid", "due1")]
    before = rows.where(~F.col("newest")).join(out.select(*over), "contract_id")
    out = out.join(before.groupBy(named).agg(*later), "loan_id", "left")
    for r in rules:
        c = r.component
        paid, close, open_ = (F.col(f"{c}_{k}") for k in ("paid", "overdue_close", "overdue_open"))
        base = paid + close - open_
        last = paid + F.col("capital_overdue_close") if r.principal_in_last_step else base
        both = F.when(
            F.col(f"{c}_due1").isNotNull() | F.col(f"{c}_more").isNotNull(),
            F.coalesce(f"{c}_due1", F.col(f"{c}_due1") * 0, F.col(f"{c}_more") * 0) + F.coalesce(f"{c}_more", F.col(f"{c}_due1") * 0),
        )
        out = out.withColumn(f"{c}_due2", both)
        out = out.withColumn(f"{c}_due", zero_if_null(f"{c}_due1"))
        out = out.withColumn(f"{c}_ok1", classify(base - F.col(f"{c}_due"), "currency", scale=r.scale, codes=R_CODES))
        first, fine = F.col(f"{c}_ok1"), F.col("consistent") == 1
        try2 = (first == 2) & fine & F.col(f"{c}_due2").isNotNull()
        if r.traceable_only:
            try2 = try2 & (F.col("capital_disbursed_amount") - F.col("outstanding_close") - F.col("capital_paid") == 0)
        try3 = (first == 0) & fine & F.col("restructured") & F.col(f"{c}_due3").isNotNull()

        def verdict(tried: Column, difference: Column, scale=r.scale) -> Column:
            return F.when(tried, classify(difference, "currency", scale=scale, codes=R_CODES)).otherwise(0)

        out = out.withColumns({
            f"{c}_ok2": verdict(try2, base - F.col(f"{c}_due2")),
            f"{c}_ok3": verdict(try3, last - F.col(f"{c}_due3")),
        })
        agreed = (first == 1) | (F.col(f"{c}_ok2") == 1) | (F.col(f"{c}_ok3") == 1)
        out = out.withColumn(f"{c}_ok", F.when(agreed, 1).otherwise(first))
    return out


_VERDICTS = ("ok1", "ok2", "ok3", "ok")


def _component_loans(outcomes: DataFrame, r: Rules) -> DataFrame:
    """The outcomes of one component under plain names."""
    own = [F.col(f"{r.component}_{k}").alias(k) for k in (*_VERDICTS, "due1", "due2", "due3", "overdue_close", "overdue_open")]
    hidden = {f"{c}_{k}" for c in _OVERDUE for k in (*_VERDICTS, "due1", "due2", "due3", "more", "overdue_close", "overdue_open")}
    hidden |= {f"{c}_due" for c in _OVERDUE if c != r.component}
    return outcomes.select(*[c for c in outcomes.columns if c not in hidden], *own)


def _step_rows(rows: DataFrame, outcomes: DataFrame, r: Rules) -> DataFrame:
    """Instalments that count for a component, with the steps that use them."""
    c = r.component
    terms = outcomes.select(F.col("loan_id").alias("contract_id"), f"{c}_paid", f"{c}_due1", *[f"{c}_{k}" for k in _VERDICTS], "consistent")
    used = rows.where(F.col(f"{c}_counts")).join(terms, "contract_id")
    return used.select(
        "contract_id", "due_date", "schedule_date", "currency", f"{c}_due", "consistent", *[F.col(f"{c}_{k}").alias(k) for k in _VERDICTS],
        F.col("newest").alias("step1"), (F.col("newest") | _closes_gap(r)).alias("step2"), F.col("unchanged").alias("step3"),
    )


def accepted_rows(rec: Reconciliation, keep_rest: bool = False) -> DataFrame:
    """Instalments of consistent loans as accepted by the step that agreed, zero amounts left out.

    ``keep_rest`` adds the newest instalments of consistent loans that never agreed.
    """
    due = f"{rec.rules.component}_due"
    used = (
        ((F.col("ok1") == 1) & F.col("step1"))
        | ((F.col("ok2") == 1) & F.col("step2"))
        | ((F.col("ok3") == 1) & F.col("step3"))
    )
    if keep_rest:
        used = used | ((F.col("ok") != 1) & F.col("step1"))
    return rec.rows.where((F.col("consistent") == 1) & used & (F.col(due) != 0)).select("contract_id", "due_date", "currency", due)


def final_schedule(capital: Reconciliation, interest: Reconciliation) -> DataFrame:
    """Accepted capital instalments merged with interest instalments of the same contracts."""
    cap = accepted_rows(capital)
    known = cap.select("contract_id").distinct()
    rest = accepted_rows(interest, keep_rest=True).join(known, "contract_id", "left_semi")
    return cap.join(rest, ["contract_id", "due_date", "currency"], "full")


def exceptions(rec: Reconciliation) -> tuple[DataFrame, DataFrame]:
    """Inconsistent loans, and consistent loans that never agreed."""
    inconsistent = rec.loans.where(F.col("consistent") == 0).select(
        "loan_id", "capital_disbursed_amount", "currency", "outstanding_open", "outstanding_close", "capital_paid"
    )
    c = rec.rules.component
    mismatched = rec.loans.where((F.col("consistent") == 1) & (F.col("ok") != 1)).select(
        "loan_id", f"{c}_due", f"{c}_paid"
    )
    return inconsistent, mismatched


# ---- events from transactions -----------------------------------------------------------


def events_from_transactions(
    schedule: DataFrame, loans: DataFrame, payments: DataFrame, disbursed_since, start, end, parts: int | None = None
) -> DataFrame:
    """Due and paid amounts of recent loans on one time line, with running totals.

    Schedules with a single instalment are early terminations and always kept; of the others the
    newest update of each month counts. ``payments``: one row per contract and day. One row
    per loan and day results; its ``due_date`` or ``event_date`` is NULL where the day has none.

    Instalments are summed per contract, update and due date, however many there are. Both sides are laid out by contract
    once, in ``parts`` parts if given; all that follows works inside contracts.
    """
    recent = loans.where(F.col("disbursement_date") >= F.lit(disbursed_since).cast("date")).select(
        F.col("loan_id").alias("contract_id")
    )
    dues, paids = ["capital_due", "interest_due", "total_due"], ["total_paid", "capital_paid", "interest_paid"]
    amounts = schedule.select(
        "contract_id", "update_date", "due_date", "capital_due", "interest_due", (F.col("capital_due") + F.col("interest_due")).alias("total_due")
    )
    due = (
        dealt(amounts, parts, "contract_id", "due_date")
        .groupBy("contract_id", "update_date", "due_date")
        .agg(F.count(F.lit(1)).alias("__rows"), *[F.sum(m).alias(m) for m in dues])
        .withColumn("date", F.col("due_date"))
    )
    paid = payments.select("contract_id", F.col("event_date").alias("date"), "event_date", *paids)
    rows = dealt(due.unionByName(paid, allowMissingColumns=True), parts, "contract_id")
    rows = rows.join(dealt(recent, parts, "contract_id"), "contract_id", "left_semi")
    instalments = F.sum("__rows").over(Window.partitionBy("contract_id", "update_date"))
    rows = rows.withColumn("__n", instalments)
    several = F.max(F.when(F.col("__n") > 1, F.col("update_date"))).over(Window.partitionBy("contract_id", "__month"))
    rows = rows.withColumn("__month", month_of("due_date")).withColumn("__newest", several)
    kept = F.col("__rows").isNull() | (F.col("__n") == 1) | (F.col("update_date") == F.col("__newest"))
    line = (
        rows.where(kept & F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
        .groupBy("contract_id", "date")
        .agg(
            F.max("due_date").alias("due_date"), *[F.sum(m).alias(m) for m in dues],
            F.max("event_date").alias("event_date"), *[F.sum(m).alias(m) for m in paids],
        )
    )
    money = ["total_due", "capital_due", "interest_due", *paids]
    w = Window.partitionBy("contract_id").orderBy("date")
    line = line.withColumns({m: zero_if_null(m) for m in money})
    return line.withColumns({f"{m}_cum": F.sum(m).over(w) for m in money})


def assign_due_date(line: DataFrame) -> DataFrame:
    """Due date each row belongs to: the previous one, or the next one when more was paid than due.

    Adds the due amounts of the chosen date and the component arrears. ``line`` has one row per contract and day.
    """
    so_far = Window.partitionBy("contract_id").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("contract_id").orderBy(F.col("date").desc()).rowsBetween(Window.unboundedPreceding, 0)
    overdue = F.col("total_due_cum") - F.col("capital_paid_cum") - F.col("interest_paid_cum")
    dues = ["total_due", "capital_due", "interest_due"]
    due = F.when(F.col("due_date").isNotNull(), F.struct("due_date", *dues))
    out = line.withColumns(
        {
            "__prev": F.last(due, ignorenulls=True).over(so_far),
            "__next": F.last(due, ignorenulls=True).over(ahead),
            "capital_overdue": F.col("capital_due_cum") - F.col("capital_paid_cum"),
            "interest_overdue": F.col("interest_due_cum") - F.col("interest_paid_cum"),
        }
    )
    out = out.withColumn("__due", F.when(overdue < 0, F.col("__next")).otherwise(F.col("__prev")))
    rest = [c for c in out.columns if c not in ("contract_id", "due_date", "__prev", "__next", "__due", *dues)]
    return out.select("contract_id", "__due.due_date", *rest, *[f"__due.{d}" for d in dues])


def overdue_mismatch(line: DataFrame, closing: DataFrame, limit: float = 0.001) -> DataFrame:
    """Loans whose computed arrears differ from the balance snapshot, as counts and millionths of all loans.

    A loan's arrears are its totals over the whole line, so they are plain sums.
    """
    last = line.groupBy(F.col("contract_id").alias("loan_id")).agg(
        (F.sum("capital_due") - F.sum("capital_paid")).alias("__c"),
        (F.sum("interest_due") - F.sum("interest_paid")).alias("__i"),
    )
    joined = last.join(closing.select("loan_id", "principal_overdue", "interest_overdue"), "loan_id", "left")
    wrong_c = F.abs(F.col("__c") - F.col("principal_overdue")) > limit
    wrong_i = F.abs(F.col("__i") - F.col("interest_overdue")) > limit
    counts = joined.agg(
        F.count(F.lit(1)).alias("loans"),
        count_if(wrong_c).alias("capital_mismatches"),
        count_if(wrong_i).alias("interest_mismatches"),
        count_if(wrong_c | wrong_i).alias("any_mismatch"),
    )
    return counts.withColumns(
        {f"{c}_share": ratio(c, "loans") for c in ("capital_mismatches", "interest_mismatches", "any_mismatch")}
    )


# ---- contract classes -------------------------------------------------------------------


def mismatch_class(
    events: DataFrame,
    loans: DataFrame,
    schedule: DataFrame,
    balances: DataFrame,
    since,
    limit=0.1,
    strict: bool = True,
    excluded_product: str = "21050",
) -> DataFrame:
    """Contracts with paid, due and past-due amounts and a class.

    0 agreed, 1 nothing due, 2 more paid than due, 3 less. ``strict`` leaves out early
    terminations and one product, and counts instalments after the disbursement only.
    """
    kind = F.col("payment_type")
    paid = events.groupBy("contract_id", "currency").agg(
        sum_if(kind == "Principal", "amount").alias("principal_paid"),
        sum_if(kind == "Interest", "amount").alias("interest_paid"),
        F.sum("amount").alias("total_paid"),
        F.max("early_termination").alias("__early"),
    )
    if strict:
        per_contract = events.groupBy(F.col("contract_id").alias("__c")).agg(F.max("early_termination").alias("__e"))
        paid = paid.join(per_contract.where(F.col("__e") == "N"), F.col("contract_id") == F.col("__c"), "left_semi")
    target = loans.where(F.col("disbursement_date") >= F.lit(since).cast("date"))
    if strict:
        target = target.where(F.col("product_code") != excluded_product)
    target = target.select(F.col("loan_id").alias("__l"), "disbursement_date", "product_code")
    due = schedule
    if strict:
        start = loans.select(F.col("loan_id").alias("__s"), F.col("disbursement_date").alias("__d"))
        due = schedule.join(start, F.col("contract_id") == F.col("__s")).where(F.col("due_date") > F.col("__d"))
    due = due.groupBy(F.col("contract_id").alias("__k")).agg(F.sum("amount_due").alias("amount_due"))
    last = first_version(balances, ["loan_id"], "balance_date", ["principal_overdue", "interest_overdue"])
    last = last.select(
        F.col("loan_id").alias("__b"),
        (zero_if_null("principal_overdue") + zero_if_null("interest_overdue")).alias("past_due"),
    )
    out = (
        paid.drop("__early")
        .join(target, F.col("contract_id") == F.col("__l"))
        .join(due, F.col("contract_id") == F.col("__k"), "left")
        .join(last, F.col("contract_id") == F.col("__b"), "left")
        .drop("__l", "__k", "__b")
    )
    out = out.withColumns({"amount_due": zero_if_null("amount_due"), "past_due": zero_if_null("past_due")})
    gap = F.col("amount_due") - F.col("total_paid") - F.col("past_due")
    due_any = F.col("amount_due") > 0
    return out.withColumn(
        "mismatch",
        F.when(F.abs(gap) < limit, 0)
        .when(F.col("amount_due") == 0, 1)
        .when(due_any & (gap < 0), 2)
        .when(due_any & (gap > 0), 3),
    )


def delay_with_class(delays: DataFrame, classes: DataFrame, events: DataFrame) -> DataFrame:
    """Instalment delays with the contract's mismatch class (4 = none) and a late-payment flag."""
    late = events.where(F.col("event") == "LP").select(F.col("contract_id")).distinct().withColumn("__late", F.lit(1))
    known = classes.groupBy("contract_id").agg(F.max("mismatch").alias("mismatch"))
    out = delays.join(known, "contract_id", "left").join(late, "contract_id", "left")
    return out.withColumns(
        {"mismatch": F.coalesce("mismatch", F.lit(4)), "late_flag": F.coalesce("__late", F.lit(0))}
    ).drop("__late")


# ---- accounts ---------------------------------------------------------------------------


def signed_movement(amount: str = "amount", credit_code: str | None = SAVINGS_CREDIT_CODE) -> Column:
    """Credits and one exceptional code add to an account, everything else subtracts."""
    plus = F.col("dbcr") == "Cr"
    if credit_code is not None:
        plus = (F.col("code") == credit_code) | plus
    return F.when(plus, F.col(amount)).otherwise(-F.col(amount))


def account_totals(
    opening: DataFrame, movements: DataFrame, closing: DataFrame, credit_code: str | None = SAVINGS_CREDIT_CODE
) -> DataFrame:
    """Opening balance, signed movements and closing balance per account, 0 where there is none.

    The three sources are stacked and summed once instead of full-joined twice. NULL accounts
    of different sources stay apart, as they would in a join.
    """
    zero = F.lit(0)
    parts = [
        opening.select("account_id", F.col("capital_balance").alias("o"), zero.alias("m"), zero.alias("c"), F.lit(1).alias("s")),
        movements.select("account_id", zero.alias("o"), signed_movement(credit_code=credit_code).alias("m"), zero.alias("c"), F.lit(2).alias("s")),
        closing.select("account_id", zero.alias("o"), zero.alias("m"), F.col("capital_balance").alias("c"), F.lit(3).alias("s")),
    ]
    stacked = parts[0].union(parts[1]).union(parts[2])
    apart = F.when(F.col("account_id").isNull(), F.col("s"))
    sides = {f"in_{n}": F.max(F.when(F.col("s") == i, True)) for i, n in ((1, "opening"), (2, "movements"), (3, "closing"))}
    return (
        stacked.groupBy("account_id", apart.alias("__apart"))
        .agg(
            F.sum("o").alias("opening"),
            F.sum("m").alias("movement"),
            F.sum("c").alias("closing"),
            *[F.coalesce(e, F.lit(False)).alias(n) for n, e in sides.items()],
        )
        .drop("__apart")
    )


def account_conservation(opening: DataFrame, movements: DataFrame, closing: DataFrame, limit=0.1) -> DataFrame:
    """Accounts where opening + movements = closing within the limit (1) and where not (0)."""
    t = account_totals(opening, movements, closing)
    off = F.abs(F.col("opening") + F.col("movement") - F.col("closing")) > limit
    return t.groupBy(F.when(off, 0).otherwise(1).alias("ok")).agg(F.count(F.lit(1)).alias("obs"))


def account_rollforward(
    opening: DataFrame, movements: DataFrame, closing: DataFrame, start, end, limits: tuple, only_opened: bool = False
) -> DataFrame:
    """Accounts off by more than each limit over a period, with their share in percent.

    Successful movements from ``start`` up to before ``end`` count. Accounts without a closing
    balance are counted but never off. ``only_opened`` looks at accounts of the opening only.
    """
    inside = (F.col("event_date") >= F.lit(start).cast("date")) & (F.col("event_date") < F.lit(end).cast("date"))
    t = account_totals(opening, movements.where(inside & (F.col("success") == "C")), closing, credit_code=None)
    if only_opened:
        t = t.where(F.col("in_opening"))
    gap = F.abs(F.col("opening") + F.col("movement") - F.col("closing"))
    counts = t.agg(
        F.count(F.lit(1)).alias("accounts"),
        *[count_if(F.col("in_closing") & (gap > limit)).alias(f"off_{i}") for i, limit in enumerate(limits)],
    )
    return counts.withColumns({f"off_{i}_percent": ratio(F.col(f"off_{i}") * 100, "accounts") for i in range(len(limits))})


def activity_by_account(summary: DataFrame, movements: DataFrame, start, end, limit=0.1) -> DataFrame:
    """Accounts whose number or volume of transactions differs between an activity summary and the movements.

    ``summary``: account_id, code, dbcr, tt_number, tt_volume.
    """
    inside = (F.col("event_date") >= F.lit(start).cast("date")) & (F.col("event_date") < F.lit(end).cast("date"))
    signed = F.when(F.col("dbcr") == "Cr", F.col("tt_volume")).otherwise(-F.col("tt_volume"))
    stated = summary.groupBy("account_id").agg(
        F.sum("tt_number").alias("txns_stated"), F.sum(signed).alias("movement_stated")
    )
    found = (
        movements.where(inside & (F.col("success") == "C"))
        .groupBy("account_id")
        .agg(
            F.count(F.lit(1)).alias("txns_found"),
            F.sum(F.when(F.col("dbcr") == "Db", -F.col("amount")).otherwise(F.col("amount"))).alias("movement_found"),
        )
    )
    off = (F.abs(F.col("txns_stated") - F.col("txns_found")) > limit) | (
        F.abs(F.col("movement_stated") - F.col("movement_found")) > limit
    )
    return stated.join(found, "account_id", "left").where(off)


def activity_by_code(summary: DataFrame, movements: DataFrame, start, end) -> DataFrame:
    """The same per transaction code, for unreversed movements of accounts in the summary; codes that differ."""
    inside = (F.col("event_date") >= F.lit(start).cast("date")) & (F.col("event_date") < F.lit(end).cast("date"))
    stated = summary.groupBy("code").agg(
        F.sum("tt_number").alias("txns_stated"), F.sum("tt_volume").alias("volume_stated")
    )
    accounts = summary.select("account_id").distinct()
    found = (
        movements.where(inside & (F.col("success") == "C"))
        .join(accounts, "account_id", "left_semi")
        .groupBy("code")
        .agg(F.count(F.lit(1)).alias("txns_found"), F.sum("amount").alias("volume_found"))
    )
    return stated.join(found, "code", "full").where(
        (F.col("txns_stated") != F.col("txns_found")) | (F.col("volume_stated") != F.col("volume_found"))
    )


# ---- instalments against payments -------------------------------------------------------


def instalment_payments(
    schedule: DataFrame, events: DataFrame, balances: DataFrame, start, end, limit=0.1
) -> DataFrame:
    """Each instalment of a period with what was paid on it and whether that settles it.

    ``paid_ok``: paid in full. ``contract_ok``: the contract's unpaid instalments differ from its
    payments by its past-due amount only. ``pay_ok``: either. Interest paid early on a closed
    loan counts as the interest due.
    """
    span = [F.lit(start).cast("date"), F.lit(end).cast("date")]
    sch = schedule.where(F.col("due_date").between(*span))
    kind = F.col("payment_type")
    eve = (
        events.where(F.col("event_date").between(*span))
        .groupBy("contract_id", "instalment", "event_date")
        .agg(
            sum_if(kind == "Principal", "amount").alias("capital_paid"),
            sum_if(kind == "Interest", "amount").alias("interest_paid"),
        )
    )
    past = balances.select(
        F.col("loan_id").alias("contract_id"),
        (zero_if_null("principal_overdue") + zero_if_null("interest_overdue")).alias("past_due"),
        "status",
    )
    joined = sch.join(eve, ["contract_id", "instalment"], "left").join(past, "contract_id", "left")
    early = (
        (F.col("event_date") < F.col("due_date"))
        & (F.col("interest_paid") < F.col("interest_due"))
        & (F.col("status") == "CLOSED")
    )
    interest = F.when(early, F.col("interest_due")).otherwise(F.col("interest_paid"))
    amount = zero_if_null("capital_paid") + zero_if_null(interest)
    keys = ["contract_id", "instalment", "due_date", "amount_due", "past_due", "status"]
    paid = (
        joined.withColumn("past_due", zero_if_null("past_due"))
        .groupBy(*keys)
        .agg(F.sum(amount).alias("amount_paid"))
        .withColumn("paid_ok", F.when(F.abs(F.col("amount_due") - F.col("amount_paid")) > limit, 0).otherwise(1))
    )
    open_ = (
        paid.where(F.col("paid_ok") == 0)
        .groupBy("contract_id", "status", "past_due")
        .agg(F.sum("amount_due").alias("d"), F.sum("amount_paid").alias("p"))
        .select(
            "contract_id",
            F.when(F.abs(F.col("d") - F.col("p") - F.col("past_due")) > limit, 0).otherwise(1).alias("contract_ok"),
        )
    )
    out = paid.join(open_, "contract_id", "left")
    return out.withColumn(
        "pay_ok", F.when((F.col("paid_ok") == 1) | (F.col("contract_ok") == 1), 1).otherwise(0)
    )


def payments_without_schedule(events: DataFrame, schedule: DataFrame) -> DataFrame:
    """Payments on instalments that no schedule has, counted by type and early termination."""
    known = schedule.select("contract_id", "instalment").distinct()
    missing = events.join(known, ["contract_id", "instalment"], "left_anti")
    return missing.groupBy("payment_type", "early_termination").agg(F.count(F.lit(1)).alias("obs"))


def outstanding_rollforward(
    before: DataFrame, after: DataFrame, events: DataFrame, loans: DataFrame, start, end, limit=0.1
) -> DataFrame:
    """Loans disbursed before a month whose opening outstanding - payments - closing outstanding is off."""
    total = zero_if_null("principal_outstanding") + zero_if_null("interest_outstanding")
    a = before.select("loan_id", total.alias("outstanding_start"))
    b = after.select("loan_id", total.alias("outstanding_end"))
    kinds = F.col("payment_type").isin("Principal", "Interest")
    paid = (
        events.where(F.col("event_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & kinds)
        .groupBy(F.col("contract_id").alias("loan_id"))
        .agg(F.sum("amount").alias("amount_paid"))
    )
    out = a.join(b, "loan_id", "full").join(paid, "loan_id", "full")
    out = out.withColumns({c: zero_if_null(c) for c in ("outstanding_start", "outstanding_end", "amount_paid")})
    out = out.join(loans.select("loan_id", "disbursement_date"), "loan_id", "left")
    out = out.withColumn("difference", F.col("outstanding_start") - F.col("amount_paid") - F.col("outstanding_end"))
    return out.where((F.abs("difference") > limit) & (F.col("disbursement_date") < F.lit(start).cast("date")))
