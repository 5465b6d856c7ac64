"""Delay scores, savings cover, activity."""

from pyspark.sql import functions as F

from ..operators import activity as T
from ..operators import allocation as A
from ..operators import delay as D
from .allocation import INSTALMENT_VIEWS, INSTALMENTS_SQL, instalments
from .base import query

RUN_DATE = "2001-06-30"


def thousandths(c):
    """Whole thousandths; the bound lies a little off the half, where sums in another order agree."""
    return F.floor(F.col(c) * 1000 + 0.5001).cast("long")


_NUMBERED = f"""{INSTALMENTS_SQL},
  num AS (SELECT contract_id, due_date, count(*) OVER (PARTITION BY contract_id ORDER BY due_date) AS instalment_number
          FROM (SELECT DISTINCT contract_id, due_date FROM instalments)),
  se AS (SELECT i.*, CAST(instalment_number AS INT) AS instalment_number FROM instalments i JOIN num USING (contract_id, due_date))"""
_DELAY = f"""{_NUMBERED},
  w0 AS (SELECT *, (event_date - due_date) * instalment_paid AS w,
     amount_due - sum(instalment_paid) OVER (PARTITION BY contract_id, instalment_number ORDER BY event_date ROWS UNBOUNDED PRECEDING) AS rest,
     row_number() OVER (PARTITION BY contract_id, instalment_number ORDER BY event_date DESC) AS back FROM se),
  w1 AS (SELECT *, CASE WHEN back = 1 AND rest > 0 THEN w + (DATE '{RUN_DATE}' - due_date) * rest ELSE w END AS wd FROM w0),
  delays AS (SELECT customer_id, contract_id, currency, instalment_number, due_date, amount_due,
     round(CAST(sum(greatest(wd, 0)) AS DOUBLE) / CAST(amount_due AS DOUBLE), 4) AS delay FROM w1 GROUP BY 1, 2, 3, 4, 5, 6)"""


def delays(src):
    numbered = A.instalment_numbers(instalments(src)).withColumnRenamed("instalment_paid", "paid_amount")
    return D.weighted_delay(numbered, RUN_DATE)


@query(
    "m1_weighted_delay",
    f"""WITH {_DELAY} SELECT customer_id, contract_id, currency, instalment_number, due_date, amount_due,
       CAST(floor(delay * 1000 + 0.5001) AS BIGINT) AS delay_thousandths FROM delays""",
    INSTALMENT_VIEWS,
)
def m1(src):
    return delays(src).withColumn("delay_thousandths", thousandths("delay")).drop("delay")


BAL_START, BAL_END = "2023-12-20", "2024-02-10"
_BALANCES = f"""o AS (SELECT *, lead(balance_date) OVER (PARTITION BY account_id ORDER BY balance_date) AS nxt FROM account_balance
     WHERE balance_date BETWEEN DATE '{BAL_START}' AND DATE '{BAL_END}'),
  dayrow AS (SELECT c.d AS date, o.* FROM (SELECT CAST(unnest(generate_series(DATE '{BAL_START}', DATE '{BAL_END}', INTERVAL 1 DAY)) AS DATE) AS d) c
     JOIN o ON c.d >= o.balance_date AND (o.nxt IS NULL OR c.d < o.nxt)),
  kh AS (SELECT x.customer_id, x.date, CASE WHEN x.currency = 'KHR' THEN CAST(x.capital_balance AS DOUBLE) ELSE CAST(x.capital_balance AS DOUBLE) / r.rate END AS k
     FROM dayrow x LEFT JOIN month_rate r ON x.currency = r.currency AND year(x.date) = year(r.rate_date) AND month(x.date) = month(r.rate_date)),
  bal AS (SELECT customer_id, date, CASE WHEN count(*) FILTER (k IS NULL) > 0 THEN 0.0 ELSE sum(k) END AS balance_khr FROM kh GROUP BY 1, 2)"""


def balances(src):
    return D.daily_balances(src["account_balance"], src["month_rate"], BAL_START, BAL_END)


@query(
    "m2_daily_balances",
    f"WITH {_BALANCES} SELECT customer_id, date, CAST(round(balance_khr * 60) AS BIGINT) AS balance_sixtieths FROM bal",
    "account_balance month_rate",
)
def m2(src):
    sixtieths = F.round(F.col("balance_khr") * 60).cast("long")
    return balances(src).select("customer_id", "date", sixtieths.alias("balance_sixtieths"))


_COVER = f"""{_BALANCES},
  ok AS (SELECT * FROM advance_instalment WHERE delay = 0),
  dd AS (SELECT CAST(due_date - off AS DATE) AS date, ok.* FROM ok CROSS JOIN (SELECT CAST(unnest(range(0, 21)) AS INT) AS off)),
  kd AS (SELECT dd.*, CASE WHEN dd.currency = 'KHR' THEN CAST(amount_due AS DOUBLE) ELSE CAST(amount_due AS DOUBLE) / r.rate END AS khr
     FROM dd LEFT JOIN month_rate r ON dd.currency = r.currency AND year(dd.date) = year(r.rate_date) AND month(dd.date) = month(r.rate_date)),
  pr AS (SELECT *, coalesce(sum(khr) OVER (PARTITION BY customer_id, date ORDER BY due_date, khr DESC, contract_id
     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken FROM kd),
  cv AS (SELECT pr.*, CASE WHEN khr > 0 THEN least(greatest(greatest(coalesce(balance_khr, 0) - taken, 0) / khr, 0), 1) END AS cover
     FROM pr LEFT JOIN bal ON pr.customer_id = bal.customer_id AND pr.date = bal.date),
  adv AS (SELECT customer_id, CAST(due_date - 20 AS DATE) AS window_start, CASE WHEN count(*) = count(khr) THEN least(sum(cover), 20.0) END AS advance FROM cv GROUP BY 1, 2)"""
_COVER_VIEWS = "account_balance month_rate advance_instalment"


def cover(src):
    on_time = src["advance_instalment"].where(F.col("delay") == 0)
    return D.advance_cover(on_time, balances(src), src["month_rate"])


@query(
    "m3_advance_cover",
    f"WITH {_COVER} SELECT customer_id, window_start, CAST(floor(advance * 1000 + 0.5001) AS BIGINT) AS advance_thousandths FROM adv",
    _COVER_VIEWS,
)
def m3(src):
    return cover(src).select(
        "customer_id", "window_start", thousandths("advance").alias("advance_thousandths")
    )


@query(
    "m4_payment_score",
    f"""WITH {_COVER}, s AS (SELECT a.contract_id, a.customer_id, a.due_date,
       CASE WHEN advance IS NOT NULL AND delay = 0 THEN -advance ELSE delay END AS raw
       FROM advance_instalment a LEFT JOIN adv ON a.customer_id = adv.customer_id AND CAST(a.due_date - 20 AS DATE) = adv.window_start)
     SELECT contract_id, customer_id, due_date, CAST(floor(least(greatest(raw, -20), 30) * 1000 + 0.5001) AS BIGINT) AS score_thousandths,
       CAST(floor(greatest(least(greatest(raw, -20), 30), 0) * 1000 + 0.5001) AS BIGINT) AS truncated_thousandths FROM s""",
    _COVER_VIEWS,
)
def m4(src):
    out = D.payment_score(src["advance_instalment"], cover(src))
    return out.select(
        "contract_id",
        "customer_id",
        "due_date",
        thousandths("score").alias("score_thousandths"),
        thousandths("truncated_score").alias("truncated_thousandths"),
    )


_DAY = "2024-01-20"


@query(
    "m5_active_customers",
    f"""WITH lb AS (SELECT loan_id, balance_date, max(customer_id) AS customer_id, sum(principal_outstanding) AS v FROM
          (SELECT customer_id % 700 AS loan_id, balance_date, customer_id, principal_outstanding + interest_outstanding AS principal_outstanding FROM s_balance) GROUP BY 1, 2),
       a AS (SELECT *, lead(v) OVER (PARTITION BY loan_id ORDER BY balance_date DESC) AS p FROM lb),
       b AS (SELECT *, lead(capital_balance) OVER (PARTITION BY account_id ORDER BY balance_date DESC) AS p FROM account_balance),
       u AS (SELECT customer_id FROM a WHERE v <> p AND balance_date > DATE '{_DAY}' - INTERVAL 6 MONTH AND balance_date <= DATE '{_DAY}'
         UNION ALL SELECT customer_id FROM account_movement WHERE event_date > DATE '{_DAY}' - INTERVAL 6 MONTH AND event_date <= DATE '{_DAY}'
         UNION ALL SELECT customer_id FROM b WHERE capital_balance <> p AND balance_date > DATE '{_DAY}' - INTERVAL 6 MONTH AND balance_date <= DATE '{_DAY}')
       SELECT DATE '{_DAY}' AS date, count(DISTINCT customer_id) AS customers FROM u""",
    "s_balance account_balance account_movement",
)
def m5(src):
    loans = (
        src["s_balance"]
        .groupBy((F.col("customer_id") % 700).alias("loan_id"), "balance_date")
        .agg(
            F.max("customer_id").alias("customer_id"),
            F.sum("principal_outstanding").alias("principal_outstanding"),
            F.sum("interest_outstanding").alias("interest_outstanding"),
        )
    )
    return T.active_customers(loans, src["account_movement"], src["account_balance"], _DAY)


@query(
    "m6_missing_months",
    """WITH s AS (SELECT contract_id, CAST(date_trunc('month', due_date) AS DATE) AS m FROM schedule
         WHERE due_date BETWEEN DATE '1996-04-01' AND DATE '2000-09-30'),
       c AS (SELECT contract_id, min(m) AS first_month, max(m) AS last_month FROM s GROUP BY 1),
       x AS (SELECT *, CAST(unnest(generate_series(first_month, last_month, INTERVAL 1 MONTH)) AS DATE) AS month FROM c)
       SELECT x.* FROM x LEFT JOIN (SELECT DISTINCT contract_id, m FROM s) o ON x.contract_id = o.contract_id AND x.month = o.m WHERE o.m IS NULL""",
    "schedule",
)
def m6(src):
    return T.missing_months(src["schedule"], "1996-04-01", "2000-09-30")


@query(
    "c18_calendar",
    """SELECT account_id, CAST(d AS DATE) AS date FROM (SELECT DISTINCT account_id FROM account_balance)
       CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS d)""",
    "account_balance",
)
def c18(src):
    return T.calendar(src["account_balance"], "account_id", "2024-01-01", "2024-01-31")
