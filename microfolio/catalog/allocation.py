"""Payment allocation queries."""

from pyspark.sql import functions as F

from ..operators import allocation as A
from ..session import parts_for
from .base import query

_DAILY = """
daily AS (
  SELECT contract_id, event_date, CAST(sum(amount) AS BIGINT) AS total_paid,
         CAST(sum(CASE WHEN code IN ('420','423','750') THEN amount ELSE 0 END) AS BIGINT) AS capital_paid,
         CAST(sum(CASE WHEN code IN ('434','751') THEN amount ELSE 0 END) AS BIGINT) AS interest_paid,
         CAST(sum(CASE WHEN code = '423' THEN 1 ELSE 0 END) AS BIGINT) AS capital_decreases
  FROM payment WHERE code IN ('420','423','434','750','751') GROUP BY 1, 2)"""

_DUES = """
dues AS (
  SELECT contract_id, due_date, instalment, CAST(sum(capital_due) AS BIGINT) AS capital_due,
         CAST(sum(interest_due) AS BIGINT) AS interest_due, CAST(sum(capital_due + interest_due) AS BIGINT) AS total_due
  FROM (SELECT contract_id, instalment, due_date, capital_due, interest_due FROM schedule
        UNION ALL
        SELECT contract_id, 0, balance_date, principal_overdue, interest_overdue FROM opening_arrears
        WHERE principal_overdue > 0 OR interest_overdue > 0) GROUP BY 1, 2, 3)"""

_COMPONENTS = ("total", "capital", "interest")


def _cumulative(name: str, source: str, order: str, kind: str) -> str:
    sums = ", ".join(
        f"CAST(sum({c}_{kind}) OVER (PARTITION BY contract_id ORDER BY {order}) AS BIGINT) AS {c}_{kind}_cum"
        for c in _COMPONENTS
    )
    lags = ", ".join(
        f"coalesce(lag({c}_{kind}_cum) OVER (PARTITION BY contract_id ORDER BY {order}), 0) AS prev_{c}_{kind}_cum"
        for c in _COMPONENTS
    )
    return f"{name} AS (SELECT *, {lags} FROM (SELECT *, {sums} FROM {source}))"


_PAIRED = f"""
{_cumulative('due_cum', 'dues', 'due_date, instalment', 'due')},
{_cumulative('paid_cum', 'daily', 'event_date', 'paid')},
paired AS (
  SELECT d.*, p.* EXCLUDE (contract_id),
         {', '.join(f'greatest({c}_due_cum - {c}_paid_cum, 0) AS {c}_left' for c in _COMPONENTS)}
  FROM due_cum d JOIN paid_cum p ON d.contract_id = p.contract_id
   AND total_paid_cum > prev_total_due_cum AND prev_total_paid_cum < total_due_cum),
lagged AS (
  SELECT *, {', '.join(f'coalesce(lag({c}_left) OVER (PARTITION BY contract_id, due_date, instalment ORDER BY event_date), 0) AS prev_{c}_left' for c in _COMPONENTS)}
  FROM paired),
settled AS (
  SELECT *, {', '.join(f'''CASE WHEN prev_{c}_left > 0 AND {c}_paid > prev_{c}_left THEN prev_{c}_left
         WHEN prev_{c}_left = 0 AND {c}_paid_cum > {c}_due_cum THEN {c}_due
         WHEN prev_{c}_paid_cum < prev_{c}_due_cum THEN {c}_paid_cum - prev_{c}_due_cum
         ELSE {c}_paid END AS {c}_settled''' for c in _COMPONENTS)}
  FROM lagged),
calculated AS (
  SELECT contract_id, instalment, due_date, event_date, total_settled AS total_paid, capital_settled AS capital_paid,
         interest_settled AS interest_paid, CAST(CASE WHEN capital_decreases > 0 THEN 1 ELSE 0 END AS INT) AS capital_decrease_flag
  FROM settled WHERE total_settled > 0.00001)"""

CALCULATED_SQL = _DAILY.strip() + ", " + _DUES.strip() + ", " + _PAIRED.strip()
ALLOCATION_VIEWS = "schedule payment opening_arrears"


@query("k1_daily_payments", f"WITH {_DAILY} SELECT * FROM daily", "payment")
def k1(src):
    return A.daily_payments(src["payment"])


@query(
    "k2_due_side",
    f"WITH {_DUES}, {_cumulative('due_cum', 'dues', 'due_date, instalment', 'due')} SELECT * FROM due_cum",
    "schedule opening_arrears",
)
def k2(src):
    return A.due_side(src["schedule"], src["opening_arrears"]).drop("due_block")


@query(
    "k3_paid_side",
    f"WITH {_DAILY}, {_cumulative('paid_cum', 'daily', 'event_date', 'paid')} SELECT * FROM paid_cum",
    "payment",
)
def k3(src):
    return A.paid_side(A.daily_payments(src["payment"]), large=A.large_contracts(src["payment"])).drop("paid_block")


@query(
    "k4_waterfall_total",
    f"WITH {CALCULATED_SQL} SELECT contract_id, due_date, event_date, total_paid FROM calculated",
    ALLOCATION_VIEWS,
)
def k4_total(src):
    only = ("total",)
    schedule, payment = src["schedule"], src["payment"]
    parts, large = parts_for(schedule, payment), A.large_contracts(schedule, payment)
    due = A.cumulate(A.daily_dues(schedule, src["opening_arrears"], parts), A.DUE_ORDER, "due", only, parts, large)
    paid = A.cumulate(A.daily_payments(payment, parts=parts), "event_date", "paid", only, parts, large)
    out = A.allocate(due, paid, components=only)
    return out.select("contract_id", "due_date", "event_date", F.col("total_settled").alias("total_paid"))


@query("k4_waterfall", f"WITH {CALCULATED_SQL} SELECT * FROM calculated", ALLOCATION_VIEWS)
def k4(src):
    return A.event_calculated(src["schedule"], src["payment"], src["opening_arrears"])


_SIGNED = """signed_payment AS (
  SELECT contract_id, event_date, CASE WHEN amount % 7 = 0 THEN -amount ELSE amount END AS amount, code FROM payment)"""


@query(
    "k4_waterfall_reversals",
    f"WITH {_SIGNED}, {CALCULATED_SQL.replace('FROM payment WHERE', 'FROM signed_payment WHERE')} SELECT * FROM calculated",
    ALLOCATION_VIEWS,
)
def k4_reversals(src):
    amount = F.when(F.col("amount") % 7 == 0, -F.col("amount")).otherwise(F.col("amount"))
    return A.event_calculated(src["schedule"], src["payment"].withColumn("amount", amount), src["opening_arrears"])


SHIFTED_SQL = """
parts AS (
  SELECT contract_id, instalment, due_date, CASE WHEN capital_decrease_flag = 1 THEN due_date ELSE event_date END AS event_date,
         sum(capital_paid) AS capital_paid, 0 AS interest_paid FROM calculated GROUP BY 1, 2, 3, 4
  UNION ALL
  SELECT contract_id, instalment, due_date, event_date, 0, sum(total_paid - capital_paid) FROM calculated GROUP BY 1, 2, 3, 4),
shifted AS (
  SELECT contract_id, instalment, due_date, event_date, CAST(sum(capital_paid + interest_paid) AS BIGINT) AS total_paid,
         CAST(sum(capital_paid) AS BIGINT) AS capital_paid
  FROM parts WHERE NOT (capital_paid = 0 AND interest_paid = 0) GROUP BY 1, 2, 3, 4)"""


@query("k5_capital_decrease", f"WITH {CALCULATED_SQL}, {SHIFTED_SQL} SELECT * FROM shifted", ALLOCATION_VIEWS)
def k5(src):
    return A.shift_capital_decrease(A.event_calculated(src["schedule"], src["payment"], src["opening_arrears"]))


@query(
    "k5_capital_decrease_keep_zero",
    f"WITH {CALCULATED_SQL}, {SHIFTED_SQL.replace('WHERE NOT (capital_paid = 0 AND interest_paid = 0)', '')} SELECT * FROM shifted",
    ALLOCATION_VIEWS,
)
def k5_zero(src):
    events = A.event_calculated(src["schedule"], src["payment"], src["opening_arrears"])
    return A.shift_capital_decrease(events, keep_zero=True)


_INSTALMENTS = """
target AS (SELECT loan_id, customer_id, currency, disbursement_date, capital_disbursed_amount FROM loan
           WHERE disbursement_date >= DATE '1995-06-01' AND product_code <> '21050'),
d0 AS (SELECT contract_id, due_date, CAST(sum(capital_due + interest_due) AS BIGINT) AS amount_due
       FROM schedule JOIN target ON contract_id = loan_id AND due_date > disbursement_date GROUP BY 1, 2),
d1 AS (SELECT *, CAST(sum(amount_due) OVER (PARTITION BY contract_id ORDER BY due_date) AS BIGINT) AS amount_due_cum FROM d0),
d2 AS (SELECT *, coalesce(lag(amount_due_cum) OVER (PARTITION BY contract_id ORDER BY due_date), 0) AS prev_due_cum FROM d1),
p0 AS (SELECT contract_id, event_date, CAST(sum(amount) AS BIGINT) AS amount_paid,
              sum(CASE WHEN code = '423' THEN 1 ELSE 0 END) AS decreases
       FROM payment WHERE contract_id IN (SELECT loan_id FROM target) GROUP BY 1, 2),
p1 AS (SELECT *, CAST(sum(amount_paid) OVER (PARTITION BY contract_id ORDER BY event_date) AS BIGINT) AS amount_paid_cum FROM p0),
p2 AS (SELECT *, coalesce(lag(amount_paid_cum) OVER (PARTITION BY contract_id ORDER BY event_date), 0) AS prev_paid_cum FROM p1),
x1 AS (SELECT d2.*, p2.* EXCLUDE (contract_id), greatest(amount_due_cum - amount_paid_cum, 0) AS remaining
       FROM d2 JOIN p2 ON d2.contract_id = p2.contract_id AND amount_paid_cum > prev_due_cum AND prev_paid_cum < amount_due_cum),
x2 AS (SELECT *, coalesce(lag(remaining) OVER (PARTITION BY contract_id, due_date ORDER BY event_date), 0) AS prev_remaining FROM x1),
instalments AS (
  SELECT customer_id, x2.contract_id, disbursement_date, currency, capital_disbursed_amount, due_date, amount_due, amount_due_cum,
         event_date, amount_paid, amount_paid_cum,
         CASE WHEN prev_remaining > 0 AND amount_paid > prev_remaining THEN prev_remaining
              WHEN prev_remaining = 0 AND amount_paid_cum > amount_due_cum THEN amount_due
              WHEN prev_paid_cum < prev_due_cum THEN amount_paid_cum - prev_due_cum ELSE amount_paid END AS instalment_paid,
         CAST(CASE WHEN decreases > 0 THEN 1 ELSE 0 END AS INT) AS principal_decrease_flag
  FROM x2 JOIN target ON contract_id = loan_id)"""


def instalments(src):
    return A.schedule_instalments(src["schedule"], src["loan"], src["payment"], "1995-06-01", "21050")


INSTALMENTS_SQL, INSTALMENT_VIEWS = _INSTALMENTS.strip(), "schedule payment loan"


@query("k6_schedule_instalments", f"WITH {INSTALMENTS_SQL} SELECT * FROM instalments", INSTALMENT_VIEWS)
def k6(src):
    return instalments(src)


@query(
    "k7_delay_histogram",
    f"""WITH {INSTALMENTS_SQL} SELECT CAST(event_date - due_date AS BIGINT) AS delay, count(*) AS obs FROM instalments
    WHERE principal_decrease_flag = 1 AND instalment_paid > 1 GROUP BY 1""",
    INSTALMENT_VIEWS,
)
def k7(src):
    return A.delay_histogram(instalments(src))


@query(
    "k8_advance_classes",
    f"""WITH {INSTALMENTS_SQL},
    m AS (SELECT *, event_date - due_date AS days FROM instalments),
    r AS (SELECT *, sum(CASE WHEN days >= 0 THEN 1 ELSE 0 END)
                 OVER (PARTITION BY contract_id ORDER BY event_date DESC, due_date DESC) AS cum FROM m)
    SELECT CAST(CASE WHEN days < 0 THEN 1 ELSE 0 END AS INT) AS negative_days,
           CAST(CASE WHEN instalment_paid < 1 THEN 1 ELSE 0 END AS INT) AS rounding_issues,
           CAST(CASE WHEN cum = 0 THEN 1 ELSE 0 END AS INT) AS early_terminations, count(*) AS payments
    FROM r GROUP BY 1, 2, 3""",
    INSTALMENT_VIEWS,
)
def k8(src):
    return A.advance_classes(instalments(src))


@query(
    "e3_instalment_numbers",
    f"""WITH {INSTALMENTS_SQL},
    n AS (SELECT contract_id, due_date, count(*) OVER (PARTITION BY contract_id ORDER BY due_date) AS instalment_number
          FROM (SELECT DISTINCT contract_id, due_date FROM instalments))
    SELECT contract_id, due_date, event_date, CAST(instalment_number AS INT) AS instalment_number
    FROM instalments JOIN n USING (contract_id, due_date)""",
    INSTALMENT_VIEWS,
)
def e3(src):
    return A.instalment_numbers(instalments(src)).select("contract_id", "due_date", "event_date", "instalment_number")
