"""Serving reads over the marts."""

import uuid

from pyspark.sql import functions as F

from ..plans import paging
from ..plans import serving as R
from ..session import stages_folder
from . import service as P
from .base import query

MANAGER, START, END = "7", "2024-01-05", "2024-01-20"
_WHERE = f"lower(portfolio_manager_id) = lower('{MANAGER}') AND {{d}} BETWEEN DATE '{START}' AND DATE '{END}'"
_ALLOWED = "department_id IS NULL OR department_id <> '3'"


def allowed():
    """Stands for the caller's row permission: everything outside one department."""
    return F.col("department_id").isNull() | (F.col("department_id") != "3")


def _read(name, ctes, table, views, build, date="date"):
    sql = f"WITH {ctes} SELECT * FROM {table} WHERE ({_ALLOWED}) AND {_WHERE.format(d=date)}"

    @query(name, sql, views)
    def run(src):
        return R.by_manager_between(build(src), MANAGER, START, END, date, allowed())

    return run


_read("q1_arrears_details", P.P7, "p7", P.P6_VIEWS, P.arrears_details)
_read("q2_arrears_summary", P.P6, "p6", P.P6_VIEWS, P.arrears_summary)
_read("q3_disbursements_details", P.P4, "p4", P.P4_VIEWS, P.disbursements_details, "update_date")
_read("q4_disbursements_summary", P.P3, "p3", P.P3_VIEWS, P.disbursements_summary, "update_date")
_read("q5_maturity_details", P.P10, "p10", P.P9_VIEWS, P.maturing_details)
_read("q6_maturity_summary", P.P9, "p9", P.P9_VIEWS, P.maturing_summary, "update_date")
_read("q7_outstanding_details", P.OUTSTANDING, "od", P.P6_VIEWS, P.outstanding_details)
_read("q8_outstanding_summary", P.P8, "p8", P.P6_VIEWS, P.outstanding_summary)


@query(
    "q9_customers",
    """SELECT customer_id FROM s_customer WHERE status = 'Active' AND version = 1
       AND lower(CAST(customer_id AS VARCHAR)) LIKE lower('%12%')""",
    "s_customer",
)
def q9(src):
    return R.customers(src["s_customer"], "12")


@query(
    "q9_customers_all",
    "SELECT customer_id FROM s_customer WHERE status = 'Active' AND version = 1",
    "s_customer",
)
def q9_all(src):
    return R.customers(src["s_customer"])


@query(
    "q10_events_feed",
    f"""SELECT loan_id, portfolio_manager_id, r_time, status, principal_outstanding FROM s_balance
       WHERE lower(portfolio_manager_id) = lower('{MANAGER}') ORDER BY r_time DESC, loan_id DESC LIMIT 100 OFFSET 1""",
    "s_balance",
)
def q10(src):
    feed = src["s_balance"].select("loan_id", "portfolio_manager_id", "r_time", "status", "principal_outstanding")
    return R.events_feed(feed, MANAGER, when="r_time", tiebreak=("loan_id",))


_BY_AMOUNT = (("capital_disbursed_amount", True), ("loan_id", False))
_LATEST_FIRST = (("r_time", True), ("loan_id", True))


def _paged(src, df, order):
    path = f"{stages_folder(src.spark)}/pages-{uuid.uuid4().hex}"
    paging.write_pages(df, order, path, 16)
    return path


@query(
    "f4_deep_page",
    "SELECT loan_id, capital_disbursed_amount FROM loan ORDER BY capital_disbursed_amount DESC, loan_id LIMIT 120 OFFSET 700",
    "loan",
)
def f4_deep(src):
    """A page far down: only the ranges of the index that hold it are read and sorted."""
    path = _paged(src, src["loan"].select("loan_id", "capital_disbursed_amount"), _BY_AMOUNT)
    return paging.page(src.spark, path, _BY_AMOUNT, 120, 700)


@query(
    "q10_events_after",
    """SELECT loan_id, portfolio_manager_id, r_time, status, principal_outstanding FROM s_balance
       ORDER BY r_time DESC, loan_id DESC LIMIT 100 OFFSET 100""",
    "s_balance",
)
def q10_after(src):
    """The feed of all managers by keys: its second page is what follows the last row of the first."""
    feed = src["s_balance"].select("loan_id", "portfolio_manager_id", "r_time", "status", "principal_outstanding")
    path = _paged(src, feed, _LATEST_FIRST)
    last = paging.page(src.spark, path, _LATEST_FIRST, 1, 99).first()
    return paging.page_after(src.spark, path, _LATEST_FIRST, 100, last.asDict())


_H = ["portfolio_manager_id", "portfolio_manager_name", "department_id", "department_name", "company_name"]


@query(
    "q11_hierarchy",
    f"SELECT {', '.join(_H)} FROM hierarchy WHERE version = 1 AND manager_status = 'Active'",
    "hierarchy",
)
def q11(src):
    return R.hierarchy(src["hierarchy"], _H)


_ON = f"WHERE ({_ALLOWED}) AND lower(portfolio_manager_id) = lower('{MANAGER}') AND update_date = DATE '{P.RUN}'"


@query("q12_portfolio_manager_info", f"WITH {P.P1} SELECT * FROM p1 {_ON}", P.P1_VIEWS)
def q12(src):
    return R.by_manager_on(P.history_box(src), MANAGER, P.RUN, permission=allowed())


@query("q13_performance_summary", f"WITH {P.P2} SELECT * FROM p2 {_ON}", P.P2_VIEWS)
def q13(src):
    return R.by_manager_on(P.summary_stats(src), MANAGER, P.RUN, permission=allowed())


@query(
    "q14_repayment_schedule",
    """SELECT s.contract_id, l.customer_id, s.due_date, s.capital_due, s.interest_due FROM schedule s JOIN loan l ON s.contract_id = l.loan_id
       WHERE l.customer_id = 77""",
    "schedule loan",
)
def q14(src):
    loans = src["loan"].select(F.col("loan_id").alias("contract_id"), "customer_id")
    rows = src["schedule"].join(loans, "contract_id").select(
        "contract_id", "customer_id", "due_date", "capital_due", "interest_due"
    )
    return R.repayment_schedule(rows, 77)
