"""Scoring marts."""

from pyspark.sql import functions as F

from ..functions.scalars import to_long
from ..operators import allocation as A
from ..operators import fx as X
from ..operators import versioning as V
from ..plans import scoring as S
from . import reconciliation
from .allocation import ALLOCATION_VIEWS, CALCULATED_SQL, SHIFTED_SQL
from .base import ORACLE, query

_DEP = """dep AS (SELECT t.customer_id, t.department_id, s.department_id_scoring FROM
  (SELECT *, count(*) OVER (PARTITION BY customer_id ORDER BY capital_disbursed_amount DESC, loan_id) AS n FROM loan) t
  LEFT JOIN department_scoring s ON t.department_id = s.department_id WHERE n = 1)"""

RATE_DATE = "1998-03-02"


def _three(amounts, ccy="b.currency", round_khr=False):
    out = []
    for a in amounts:
        khr = f"(CAST(b.{a} AS DOUBLE) / own.rate)"
        if round_khr:
            khr = f"round{khr}"
        out.append(f"CAST(round({khr}) AS BIGINT) AS {a}_khr")
        for code in ("USD", "THB"):
            out.append(
                f"CAST(round(CASE WHEN {ccy} = '{code}' THEN CAST(b.{a} AS DOUBLE) ELSE {khr} * {code.lower()}.rate END) AS BIGINT)"
                f" AS {a}_{code.lower()}"
            )
    return ", ".join(out)


def _rates(table, day):
    return f"""LEFT JOIN {table} own ON own.currency = b.currency AND own.rate_date = {day}
       LEFT JOIN {table} usd ON usd.currency = 'USD' AND usd.rate_date = {day}
       LEFT JOIN {table} thb ON thb.currency = 'THB' AND thb.rate_date = {day}"""


def whole(df, amounts):
    """Converted amounts as whole numbers, so that two engines can be compared exactly."""
    return df.withColumns({f"{a}{t}": to_long(f"{a}{t}") for a in amounts for t in ("_khr", "_usd", "_thb")})


@query(
    "j28_primary_department",
    f"WITH {_DEP} SELECT * FROM dep",
    "loan department_scoring",
)
def j28(src):
    return V.primary_department(src["loan"], src["department_scoring"])


@query(
    "j27_three_currencies",
    f"""SELECT b.loan_id, b.currency, b.disbursement_date, b.capital_disbursed_amount, {_three(['capital_disbursed_amount'])}
       FROM loan b {_rates('fx', 'b.disbursement_date')}""",
    "loan fx",
)
def j27(src):
    df = src["loan"].select("loan_id", "currency", "disbursement_date", "capital_disbursed_amount")
    amounts = ["capital_disbursed_amount"]
    return whole(X.to_three(df, src["fx"], amounts, date="disbursement_date"), amounts)


_LOAN_COLS = "loan_id customer_id product_code cycle capital_disbursed_amount disbursement_date maturity_date payment_type restructured currency portfolio_manager_id update_date".split()


@query(
    "j20_loan_scoring",
    f"""WITH usd_loan AS (SELECT b.*, b.capital_disbursed_amount * coalesce(r.rate, 1) AS capital_disbursed_amount_usd
         FROM loan b LEFT JOIN fx r ON b.currency = r.currency AND b.update_date = r.rate_date),
       {_DEP.replace('ORDER BY capital_disbursed_amount DESC', 'ORDER BY capital_disbursed_amount_usd DESC').replace('FROM loan)', 'FROM usd_loan)')},
       lb AS (SELECT * FROM year_snapshot WHERE balance_date = (SELECT max(balance_date) FROM year_snapshot)),
       ev AS (SELECT contract_id, CAST(max(event_time) AS DATE) AS last_payment_date FROM payment_event GROUP BY 1),
       s AS (SELECT b.*, CASE WHEN lb.principal_outstanding IS NULL THEN 'CLOSE' ELSE lb.status END AS st,
                    lb.principal_outstanding, ev.last_payment_date
             FROM usd_loan b LEFT JOIN lb ON b.loan_id = lb.loan_id LEFT JOIN ev ON b.loan_id = ev.contract_id)
       SELECT {', '.join('s.' + c for c in _LOAN_COLS)}, s.capital_disbursed_amount_usd, s.st AS status,
              CASE WHEN s.st = 'CLOSE' THEN coalesce(s.last_payment_date, s.end_date) END AS end_date,
              dep.department_id_scoring, FALSE AS optout_flag, s.payment_type = 'FLEXIBLE' AS variable_schedule_flag,
              s.product_code IN ('21056', '3900') AS loan_staff_flag, s.principal_outstanding
       FROM s LEFT JOIN dep ON s.customer_id = dep.customer_id""",
    "loan fx department_scoring year_snapshot payment_event",
)
def j20(src):
    loans = X.to_usd(src["loan"], src["fx"], ["capital_disbursed_amount"])
    out = S.loan_scoring(loans, src["year_snapshot"], src["payment_event"], src["department_scoring"])
    return out.select(
        *_LOAN_COLS,
        "capital_disbursed_amount_usd",
        "status",
        "end_date",
        "department_id_scoring",
        "optout_flag",
        "variable_schedule_flag",
        "loan_staff_flag",
        "principal_outstanding",
    )


SCHEDULE_SCORING_SQL = f"""{_DEP},
       cur AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY contract_id, instalment ORDER BY update_date DESC) AS n FROM instalment_history)
               WHERE n = 1 AND (status IS NULL OR upper(status) <> 'SKIPPED')),
       lb AS (SELECT * FROM year_snapshot WHERE balance_date = (SELECT max(balance_date) FROM year_snapshot)),
       schedule_scoring AS (
       SELECT b.contract_id, b.instalment, b.due_date, b.update_date, b.currency, b.total_due, b.capital_due,
              l.customer_id, l.product_code, coalesce(lb.status, l.status) AS loan_status, dep.department_id_scoring,
              b.total_due * coalesce(r.rate, 1) AS total_due_usd, b.capital_due * coalesce(r.rate, 1) AS capital_due_usd
       FROM cur b LEFT JOIN loan l ON b.contract_id = l.loan_id LEFT JOIN dep ON l.customer_id = dep.customer_id
       LEFT JOIN lb ON l.loan_id = lb.loan_id LEFT JOIN fx r ON b.currency = r.currency AND b.update_date = r.rate_date)"""
SCHEDULE_SCORING_VIEWS = "loan department_scoring instalment_history year_snapshot fx"


def schedule_scoring(src):
    cols = ["due_date", "currency", "status", "total_due", "capital_due"]
    current = V.first_version(src["instalment_history"], ["contract_id", "instalment"], "update_date", cols)
    return S.schedule_scoring(current, src["loan"], src["year_snapshot"], src["department_scoring"], src["fx"])


@query("j21_schedule_scoring", f"WITH {SCHEDULE_SCORING_SQL} SELECT * FROM schedule_scoring", SCHEDULE_SCORING_VIEWS)
def j21(src):
    return schedule_scoring(src)


@query(
    "j22_saving_scoring",
    f"""WITH {_DEP}
       SELECT b.account_id, b.customer_id, b.balance_date, b.account_code, b.currency, b.available_balance, a.account_type,
              dep.department_id_scoring, {_three(['available_balance'])}
       FROM account_balance b LEFT JOIN account a ON b.account_id = a.account_id LEFT JOIN dep ON b.customer_id = dep.customer_id
       {_rates('fx_events', 'b.balance_date')}""",
    "account_balance account loan department_scoring fx_events",
)
def j22(src):
    out = S.saving_scoring(
        src["account_balance"].drop("capital_balance"), src["account"], src["loan"], src["department_scoring"], src["fx_events"]
    )
    return whole(out, ["available_balance"])


_DUE = """due AS (SELECT contract_id, due_date, CASE contract_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END AS currency,
         capital_due, CASE WHEN instalment <> 7 THEN interest_due END AS interest_due FROM schedule)"""


@query(
    "j23_schedule_scoring_fixed",
    f"""WITH {_DEP}, {_DUE}, b AS (SELECT due.contract_id, due.due_date, due.currency, l.customer_id, l.product_code, l.status,
             CAST(count(*) OVER (PARTITION BY contract_id ORDER BY due_date) AS INT) AS instalment_number,
             capital_due, capital_due + coalesce(interest_due, 0) AS total_due
             FROM due LEFT JOIN loan l ON due.contract_id = l.loan_id)
       SELECT b.*, dep.department_id_scoring, {_three(['total_due', 'capital_due'])}
       FROM b LEFT JOIN dep ON b.customer_id = dep.customer_id {_rates('fx', f"DATE '{RATE_DATE}'")}""",
    "schedule loan department_scoring fx",
)
def j23(src):
    ccy = F.expr("CASE contract_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END")
    interest = F.when(F.col("instalment") != 7, F.col("interest_due"))
    due = src["schedule"].select("contract_id", "due_date", ccy.alias("currency"), "capital_due", interest.alias("interest_due"))
    out = S.schedule_scoring_fixed(due, src["loan"], src["department_scoring"], src["fx"], RATE_DATE)
    return whole(out, ["total_due", "capital_due"])


_SCORED_LOANS = """rl AS (SELECT loan_id, customer_id, CAST(loan_id % 7 AS VARCHAR) AS product_code, status, CAST(customer_id % 25 AS VARCHAR) AS department_id,
  capital_disbursed_amount + loan_id % 11 AS capital_disbursed_amount FROM r_loan)"""


@query(
    "j23_scoring_of_reconciled",
    f"""WITH {_SCORED_LOANS}, {_DEP.replace('FROM loan)', 'FROM rl)')}, due AS ({ORACLE['l11_final_schedule']}),
       b AS (SELECT due.contract_id, due.due_date, due.currency, l.customer_id, l.product_code, l.status,
             CAST(count(*) OVER (PARTITION BY contract_id ORDER BY due_date) AS INT) AS instalment_number,
             coalesce(capital_due, 0) AS capital_due, coalesce(capital_due, 0) + coalesce(interest_due, 0) AS total_due
             FROM due LEFT JOIN rl l ON due.contract_id = l.loan_id)
       SELECT b.*, dep.department_id_scoring, {_three(['total_due', 'capital_due'])}
       FROM b LEFT JOIN dep ON b.customer_id = dep.customer_id {_rates('fx', f"DATE '{RATE_DATE}'")}""",
    "r_loan department_scoring fx",
)
def j23_reconciled(src):
    """The scoring mart of the reconciled schedule, which keeps the instalments that a step of the reconciliation accepted."""
    text = lambda c, n: (F.col(c) % n).cast("string")
    loans = src["r_loan"].withColumns({
        "product_code": text("loan_id", 7), "department_id": text("customer_id", 25),
        "capital_disbursed_amount": F.col("capital_disbursed_amount") + F.col("loan_id") % 11,
    })
    out = S.schedule_scoring_fixed(reconciliation.l11(src), loans, src["department_scoring"], src["fx"], RATE_DATE)
    return whole(out, ["total_due", "capital_due"])


def _event_sql(final: bool) -> str:
    shifted = SHIFTED_SQL if final else SHIFTED_SQL.replace("WHERE NOT (capital_paid = 0 AND interest_paid = 0)", "")
    late = "AND b.due_date > lp.last_payment_date" if final else ""
    return f"""WITH {CALCULATED_SQL}, {shifted}, {_DEP},
       lb AS (SELECT * FROM year_snapshot WHERE balance_date = DATE '2001-01-01'),
       lp AS (SELECT contract_id, max(event_date) AS last_payment_date FROM calculated GROUP BY 1),
       b AS (SELECT shifted.*, l.currency, l.customer_id, l.maturity_date FROM shifted LEFT JOIN loan l ON shifted.contract_id = l.loan_id)
       SELECT b.contract_id, b.instalment, b.due_date, b.event_date, b.total_paid, b.capital_paid, b.currency, b.customer_id,
              coalesce((lb.status IS NULL OR lb.status = 'CLOSED') AND lp.last_payment_date < b.maturity_date {late}, FALSE) AS early_termination_flag,
              dep.department_id_scoring, {_three(['total_paid', 'capital_paid'])}
       FROM b LEFT JOIN lp ON b.contract_id = lp.contract_id LEFT JOIN lb ON b.contract_id = lb.loan_id
       LEFT JOIN dep ON b.customer_id = dep.customer_id {_rates('fx', f"DATE '{RATE_DATE}'")}"""


_EVENT_VIEWS = ALLOCATION_VIEWS + " loan department_scoring year_snapshot fx"


def _event_scoring(src, final):
    calculated = A.event_calculated(src["schedule"], src["payment"], src["opening_arrears"])
    closing = src["year_snapshot"].where(F.col("balance_date") == "2001-01-01")
    out = S.event_scoring(calculated, src["loan"], closing, src["department_scoring"], src["fx"], RATE_DATE, final)
    return whole(out, ["total_paid", "capital_paid"])


@query("j24_event_scoring", _event_sql(True), _EVENT_VIEWS)
def j24(src):
    return _event_scoring(src, True)


@query("j25_event_scoring_earlier", _event_sql(False), _EVENT_VIEWS)
def j25(src):
    return _event_scoring(src, False)


_FIRST = _LOAN_COLS + ["status"]


@query(
    "j26_loan_scoring_first",
    f"""WITH {CALCULATED_SQL}, {_DEP}, lp AS (SELECT contract_id, max(event_date) AS last_payment_date FROM calculated GROUP BY 1)
       SELECT {', '.join('b.' + c for c in _FIRST)}, CASE WHEN b.status = 'CLOSED' THEN lp.last_payment_date END AS end_date,
              CAST(NULL AS VARCHAR) AS recommendation_id, FALSE AS optout_flag, 0 AS variable_schedule_flag,
              b.product_code = '21056' AS loan_staff_flag, dep.department_id_scoring,
              {_three(['capital_disbursed_amount'], round_khr=True)}
       FROM loan b LEFT JOIN lp ON b.loan_id = lp.contract_id LEFT JOIN dep ON b.customer_id = dep.customer_id
       {_rates('fx', 'b.update_date')}""",
    ALLOCATION_VIEWS + " loan department_scoring fx",
)
def j26(src):
    calculated = A.event_calculated(src["schedule"], src["payment"], src["opening_arrears"])
    out = S.loan_scoring_first(src["loan"], calculated, src["department_scoring"], src["fx"])
    amounts = ["capital_disbursed_amount"]
    return whole(out, amounts).select(
        *_FIRST, "end_date", "recommendation_id", "optout_flag", "variable_schedule_flag", "loan_staff_flag",
        "department_id_scoring", *[f"{a}{t}" for a in amounts for t in ("_khr", "_usd", "_thb")],
    )
