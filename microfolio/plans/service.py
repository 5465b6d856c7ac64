"""Service marts for portfolio managers.

Inputs are the service-generation tables: ``hierarchy`` (portfolio_manager_id, version, update_date and
descriptive columns), ``loans`` (versioned), ``balances`` (daily), ``applications``, ``scoring``,
``eligible``, ``objective``, ``customers``, ``accounts``. The run date is an argument. Facts are
aggregated before they meet the hierarchy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import PAR_DAYS, count_if, midnights, ratio, sum_if, zero_if_null
from ..operators.versioning import first_version

OPEN_STAGES_EXCLUDED = ("Disbursed", "Closed")
SCORE_CLASSES = ("A", "B", "C", "D")


def _managers(hierarchy: DataFrame) -> DataFrame:
    """Current hierarchy rows without their version columns."""
    return hierarchy.where(F.col("version") == 1).drop("version", "update_date", "manager_status")


def _at(df: DataFrame, run_date) -> DataFrame:
    return df.withColumn("update_date", F.lit(run_date).cast("date"))


def _join_pm(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, "portfolio_manager_id", "left")


def _active(balances: DataFrame) -> DataFrame:
    return balances.where(F.col("status") == "Active")


def _first_known(loans: DataFrame, cols: list[str]) -> DataFrame:
    """The first row known of each loan: the loan may have moved to another manager later."""
    return first_version(loans, ["loan_id"], "update_date", cols, oldest=True)


def _this_month(loans: DataFrame, run_date) -> DataFrame:
    return loans.where(F.col("disbursement_date") >= F.trunc(F.lit(run_date).cast("date"), "MM"))


def _open_applications(applications: DataFrame) -> DataFrame:
    """Newest application rows still open (``version`` = 1)."""
    return applications.where((F.col("version") == 1) & ~F.col("stage").isin(*OPEN_STAGES_EXCLUDED))


def history_box(hierarchy: DataFrame, loans: DataFrame, balances: DataFrame, run_date) -> DataFrame:
    """Per manager: first date, disbursed loans, mean of the daily shares at risk above 0 and 30 days."""
    start = hierarchy.groupBy("portfolio_manager_id").agg(F.min("update_date").alias("start_date"))
    disbursed = (
        _first_known(loans, ["portfolio_manager_id", "disbursement_amount"])
        .groupBy("portfolio_manager_id")
        .agg(F.count(F.lit(1)).alias("disbursed_loans"), F.sum("disbursement_amount").alias("disbursed_amount"))
    )
    days = (
        _active(balances)
        .groupBy("portfolio_manager_id", "balance_date")
        .agg(
            *[sum_if(F.col("days_overdue") > d, "principal_outstanding").alias(f"par{d}") for d in (0, 30)],
            F.sum("principal_outstanding").alias("outstanding"),
        )
        .where(F.col("outstanding") > 0)
    )
    shares = days.groupBy("portfolio_manager_id").agg(
        *[F.avg(ratio(f"par{d}", "outstanding")).alias(f"average_par{d}_percentage") for d in (0, 30)]
    )
    return _join_pm(_join_pm(_join_pm(_at(_managers(hierarchy), run_date), start), disbursed), shares)


def summary_stats(
    hierarchy: DataFrame, loans: DataFrame, applications: DataFrame, balances: DataFrame, scoring: DataFrame, run_date
) -> DataFrame:
    """Per manager on the run date: month's disbursements, open applications, portfolio at risk and by score class."""
    day = F.lit(run_date).cast("date")
    disbursed = (
        _first_known(_this_month(loans, run_date), ["portfolio_manager_id", "disbursement_amount"])
        .groupBy("portfolio_manager_id")
        .agg(F.count(F.lit(1)).alias("disbursed_loans"), F.sum("disbursement_amount").alias("disbursed_amount"))
    )
    apps = (
        _open_applications(applications)
        .groupBy("portfolio_manager_id")
        .agg(F.count(F.lit(1)).alias("loan_applications"), F.sum("reviewed_amount").alias("amount_reviewed"))
    )
    classes = (
        scoring.where(F.col("scoring_date") == day)
        .groupBy(F.col("customer_id").alias("__c"))
        .agg(F.max("class").alias("scoring_class"))
    )
    other = F.coalesce(~F.col("scoring_class").isin(*SCORE_CLASSES), F.lit(True))
    # one row per manager and customer first: customers are counted once, loans stay summed
    per_customer = (
        _active(balances)
        .where(F.col("r_time").cast("date") == day)
        .groupBy("portfolio_manager_id", "customer_id")
        .agg(
            F.count(F.lit(1)).alias("loans"),
            F.sum("principal_outstanding").alias("outstanding"),
            *[sum_if(F.col("days_overdue") > d, "principal_outstanding").alias(f"par{d}") for d in (0, 30)],
        )
        .join(classes, F.col("customer_id") == F.col("__c"), "left")
    )
    marks = [(c, F.col("scoring_class") == c) for c in SCORE_CLASSES] + [("other", other)]
    portfolio = per_customer.groupBy("portfolio_manager_id").agg(
        F.sum("loans").alias("outstanding_loans"),
        F.sum("outstanding").alias("principal_outstanding"),
        *[F.sum(f"par{d}").alias(f"par{d}_outstanding") for d in (0, 30)],
        *[sum_if(m, "outstanding").alias(f"{c.lower()}_outstanding") for c, m in marks],
        *[count_if(m).alias(f"{c.lower()}_customers") for c, m in marks],
    )
    return _join_pm(_join_pm(_join_pm(_at(_managers(hierarchy), run_date), disbursed), apps), portfolio)


def disbursements_summary(
    hierarchy: DataFrame, loans: DataFrame, applications: DataFrame, objective: DataFrame, run_date
) -> DataFrame:
    """Realised, potential and objective disbursements of the month; objectives are last year's."""
    realised = (
        _first_known(_this_month(loans, run_date), ["portfolio_manager_id", "disbursement_amount", "cycle"])
        .groupBy("portfolio_manager_id")
        .agg(
            F.count(F.lit(1)).alias("rzd_disbursed_loans"),
            F.sum("disbursement_amount").alias("rzd_disbursed_amount"),
            count_if(F.col("cycle") == 1).alias("rzd_cycle1_loans"),
        )
    )
    apps = (
        _open_applications(applications)
        .groupBy("portfolio_manager_id")
        .agg(F.count(F.lit(1)).alias("loan_applications"), F.sum("reviewed_amount").alias("amount_reviewed"))
    )
    month = F.trunc(F.lit(run_date).cast("date"), "MM")
    goals = objective.where(F.trunc(F.add_months("month_last_date", 12), "MM") == month).select(
        "portfolio_manager_id",
        F.col("new_disbursements").alias("obj_disbursed_loans"),
        F.col("total_disbursement").alias("obj_disbursed_amount"),
        F.col("new_borrowers").alias("obj_cycle1_disbursed_loans"),
    )
    out = _join_pm(_join_pm(_join_pm(_at(_managers(hierarchy), run_date), realised), apps), goals)
    out = out.withColumn("cycle1_loan_applications", F.lit(None).cast("long"))

    def share(done, goal):
        return F.when(F.col(goal) > 0, F.col(done) / F.col(goal))

    return out.withColumns(
        {
            "pot_disbursed_loans": zero_if_null("rzd_disbursed_loans") + zero_if_null("loan_applications"),
            "pot_disbursed_amount": zero_if_null("rzd_disbursed_amount") + zero_if_null("amount_reviewed"),
            "pot_cycle1_loans": zero_if_null("rzd_cycle1_loans") + zero_if_null("cycle1_loan_applications"),
            "rzd_disbursed_loans_perc": share("rzd_disbursed_loans", "obj_disbursed_loans"),
            "rzd_disbursed_amount_perc": share("rzd_disbursed_amount", "obj_disbursed_amount"),
            "rzd_cycle1_loans_perc": share("rzd_cycle1_loans", "obj_cycle1_disbursed_loans"),
        }
    )


def disbursements_details(hierarchy: DataFrame, loans: DataFrame, run_date) -> DataFrame:
    """Current rows of the loans disbursed this month."""
    rows = _this_month(loans, run_date).where(F.col("version") == 1)
    rows = rows.select(
        "portfolio_manager_id", "customer_id", "disbursement_date", "loan_id", "cycle", "maturity_date",
        F.col("disbursement_amount").alias("total_amount"), "currency",
    )
    return _join_pm(_at(rows, run_date), _managers(hierarchy))


def pipeline_details(hierarchy: DataFrame, applications: DataFrame, run_date) -> DataFrame:
    """Open applications."""
    rows = _open_applications(applications).select(
        "portfolio_manager_id", "customer_id", "application_id", "stage", "update_time", "requested_amount",
        "reviewed_amount", "approved_amount", "currency", F.lit(run_date).cast("date").alias("date"),
    )
    return _join_pm(rows, _managers(hierarchy))


def arrears_summary(hierarchy: DataFrame, balances: DataFrame, run_date) -> DataFrame:
    """Per manager and day: loans, amounts and shares at risk above each overdue threshold."""
    over = {d: F.col("days_overdue") > d for d in PAR_DAYS}
    days = (
        _active(balances)
        .groupBy("portfolio_manager_id", F.col("balance_date").alias("date"))
        .agg(
            count_if(over[0]).alias("arrear_loans"),
            sum_if(over[0], "principal_outstanding").alias("arrear_amount"),
            *[count_if(m).alias(f"par{d}_number") for d, m in over.items()],
            *[sum_if(m, "principal_outstanding").alias(f"par{d}_amount") for d, m in over.items()],
            F.sum("principal_outstanding").alias("principal_outstanding"),
        )
    )
    total = F.col("principal_outstanding")
    days = days.withColumns({f"par{d}_perc": F.when(total > 0, F.col(f"par{d}_amount") / total) for d in PAR_DAYS})
    return _join_pm(_at(_managers(hierarchy), run_date), days)


def arrears_details(hierarchy: DataFrame, balances: DataFrame) -> DataFrame:
    """Active loans in arrears."""
    rows = _active(balances).where(F.col("days_overdue") > 0)
    rows = rows.select(
        "portfolio_manager_id", F.col("balance_date").alias("date"), "loan_id", "days_overdue", "principal_due",
        "penalty_due", "principal_outstanding",
    )
    return _join_pm(rows, _managers(hierarchy))


def outstanding_details(hierarchy: DataFrame, balances: DataFrame) -> DataFrame:
    """Active loans with their outstanding principal."""
    rows = _active(balances).select(
        "portfolio_manager_id", F.col("balance_date").alias("date"), "loan_id", "loan_name", "principal_outstanding"
    )
    return _join_pm(rows, _managers(hierarchy))


def outstanding_summary(hierarchy: DataFrame, balances: DataFrame) -> DataFrame:
    """Loans and amount by manager, day and product.

    Aggregated by manager before the hierarchy is joined, and once more afterwards, so repeated
    hierarchy rows count as they would in a join of the details.
    """
    small = (
        _active(balances)
        .groupBy("portfolio_manager_id", F.col("balance_date").alias("date"), "loan_name")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("principal_outstanding").alias("amount"))
    )
    joined = _join_pm(small, _managers(hierarchy))
    keys = [c for c in joined.columns if c not in ("n", "amount")]
    return joined.groupBy(*keys).agg(F.sum("n").alias("outstanding_loans"), F.sum("amount").alias("amount"))


def _maturing(balances: DataFrame, loans: DataFrame, eligible: DataFrame, mark) -> DataFrame:
    rows = _active(balances).where(F.col("maturity_date") > F.col("balance_date"))
    rows = rows.withColumn("update_date", F.col("r_time").cast("date")).drop("maturity_date", "customer_id")
    current = loans.where(F.col("version") == 1).select(F.col("loan_id").alias("__l"), "maturity_date", "customer_id")
    offers = eligible.select(
        F.col("current_loan_id").alias("__o"), "scoring_date", mark.alias("ra_eligible"), "new_loan_amount"
    )
    out = rows.join(current, F.col("loan_id") == F.col("__l"), "left").join(
        offers, (F.col("loan_id") == F.col("__o")) & (F.col("update_date") == F.col("scoring_date")), "left"
    )
    return out.withColumn("days_to_maturity", midnights("update_date", "maturity_date")).drop("__l", "__o")


def maturing_summary(hierarchy: DataFrame, balances: DataFrame, loans: DataFrame, eligible: DataFrame) -> DataFrame:
    """Maturing loans and amounts by days to maturity, with the part eligible for a renewal."""
    rows = _maturing(balances, loans, eligible, F.lit(1))
    sums = rows.groupBy("portfolio_manager_id", "update_date", "days_to_maturity").agg(
        F.count(F.lit(1)).alias("maturing_loans"),
        F.sum("principal_outstanding").alias("maturing_amount"),
        F.sum("ra_eligible").alias("ra_loans"),
        sum_if(F.col("ra_eligible") == 1, "principal_outstanding").alias("ra_amount"),
    )
    return _join_pm(sums, _managers(hierarchy))


def maturing_details(hierarchy: DataFrame, balances: DataFrame, loans: DataFrame, eligible: DataFrame) -> DataFrame:
    """The maturing loans one by one."""
    rows = _maturing(balances, loans, eligible, F.lit("Y")).select(
        "portfolio_manager_id", "loan_id", "principal_outstanding", F.col("balance_date").alias("date"), "update_date",
        "maturity_date", "customer_id", "scoring_date", "ra_eligible", "new_loan_amount", "days_to_maturity",
    )
    return _join_pm(rows, _managers(hierarchy))


def disbursements_daily(hierarchy: DataFrame, loans: DataFrame) -> DataFrame:
    """Loans and amounts disbursed per day by the first known manager."""
    sums = (
        _first_known(loans, ["portfolio_manager_id", "disbursement_date", "disbursement_amount"])
        .groupBy("portfolio_manager_id", F.col("disbursement_date").cast("date").alias("disbursement_date"))
        .agg(F.count(F.lit(1)).alias("disbursed_loans"), F.sum("disbursement_amount").alias("disbursed_amount"))
    )
    return _join_pm(sums, _managers(hierarchy))


def customer_card(hierarchy: DataFrame, customers: DataFrame, accounts: DataFrame, balances: DataFrame) -> DataFrame:
    """Current customers with their latest account totals, latest active-loan totals and tags.

    The latest loan day counts loans of any status; a customer without an active loan on it gets
    no loan totals. A customer is 'Late' when principal due plus outstanding interest is positive.
    """
    current = customers.where(F.col("version") == 1)
    money = (
        accounts.groupBy("customer_id", "balance_date")
        .agg(F.sum("capital_balance").alias("capital_balance"), F.sum("available_balance").alias("available_balance"))
        .groupBy(F.col("customer_id").alias("__a"))
        .agg(F.max_by(F.struct("balance_date", "capital_balance", "available_balance"), "balance_date").alias("m"))
        .select(
            "__a", F.col("m.balance_date").alias("account_update_date"), "m.capital_balance", "m.available_balance"
        )
    )
    active = F.col("status") == "Active"
    sums = {
        "principal_outstanding_amount": "principal_outstanding",
        "principal_due_amount": "principal_due",
        "interests_outstanding_amount": "interest_outstanding",
        "interests_due_amount": "interest_due",
        "penalty_due_amount": "penalty_due",
    }
    debt = (
        balances.groupBy("customer_id", "balance_date")
        .agg(
            count_if(active).alias("loans_outstanding_number"),
            *[F.sum(F.when(active, F.col(s))).alias(o) for o, s in sums.items()],
        )
        .groupBy(F.col("customer_id").alias("__b"))
        .agg(F.max_by(F.struct("balance_date", "loans_outstanding_number", *sums), "balance_date").alias("d"))
        .where(F.col("d.loans_outstanding_number") > 0)
        .select(
            "__b", F.col("d.balance_date").alias("loan_update_date"), "d.loans_outstanding_number", *[f"d.{o}" for o in sums]
        )
    )
    late = F.col("principal_due_amount") + F.col("interests_outstanding_amount") > 0
    tags = F.array(
        F.when(F.col("loans_outstanding_number") > 0, F.lit("Borrower")),
        F.when(late, F.lit("Late")).otherwise(F.lit("On Time")),
    )
    debt = debt.withColumn("tag", tags)
    out = _join_pm(current, _managers(hierarchy))
    out = out.join(money, F.col("customer_id") == F.col("__a"), "left").join(
        debt, F.col("customer_id") == F.col("__b"), "left"
    )
    total = F.col("principal_outstanding_amount") + F.col("interests_outstanding_amount")
    return out.withColumn("total_outstanding_amount", total).drop("__a", "__b")
