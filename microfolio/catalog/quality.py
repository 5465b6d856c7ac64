"""Quality checks and profiles."""

from pyspark.sql import functions as F

from ..functions.scalars import per_million
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import versioning as V
from .base import query
from .scoring import SCHEDULE_SCORING_SQL, SCHEDULE_SCORING_VIEWS, schedule_scoring

_PM = "CAST(floor({n} * 1000000 // {d}) AS BIGINT)"


@query(
    "m7_keys",
    """SELECT count(*) AS obs, count(DISTINCT concat(CAST(contract_id AS VARCHAR), CAST(due_date AS VARCHAR))) AS contract_dates,
       count(DISTINCT concat(CAST(contract_id AS VARCHAR), CAST(due_date AS VARCHAR), CAST(update_date AS VARCHAR))) AS contract_date_updates,
       count(DISTINCT contract_id) AS contracts FROM r_schedule""",
    "r_schedule",
)
def m7(src):
    return Q.key_report(
        src["r_schedule"],
        {
            "contract_dates": ["contract_id", "due_date"],
            "contract_date_updates": ["contract_id", "due_date", "update_date"],
            "contracts": ["contract_id"],
        },
    )


@query(
    "m8_period_share",
    f"""WITH x AS (SELECT CAST(sum(CASE WHEN due_date BETWEEN DATE '1997-04-01' AND DATE '1998-03-31' THEN 1 ELSE 0 END) AS BIGINT) AS inside, count(*) AS obs FROM schedule)
       SELECT *, {_PM.format(n='inside', d='obs')} AS share FROM x""",
    "schedule",
)
def m8(src):
    return Q.period_share(src["schedule"], "due_date", "1997-04-01", "1998-03-31")


@query(
    "m9_closed_without_end",
    "SELECT status, CAST(CASE WHEN end_date IS NULL THEN 0 ELSE 1 END AS INT) AS filled, count(*) AS obs FROM account GROUP BY 1, 2",
    "account",
)
def m9(src):
    return Q.status_by_presence(src["account"], "status", "end_date")


def _cov(name, a, ka, b, kb):
    return f"""SELECT '{name}' AS "check", CAST(f AS INT) AS found, count(*) AS obs FROM (SELECT DISTINCT {ka} AS k FROM {a}) x
       LEFT JOIN (SELECT DISTINCT {kb} AS k, 1 AS f FROM {b}) y ON x.k = y.k GROUP BY 2"""


_PAIRS = {
    "account customers in customer": ("account_balance", "customer_id", "s_customer", "customer_id"),
    "schedule contracts in loan": ("schedule", "contract_id", "loan", "loan_id"),
    "repayment accounts in account": ("loan", "repayment_account_id", "account_balance", "account_id"),
    "due contracts in due instalments": ("schedule", "contract_id", "due_instalment", "contract_id"),
    "loan customers in loan": ("loan", "customer_id", "loan", "customer_id"),
}


@query(
    "m10_coverage",
    " UNION ALL ".join(f"SELECT * FROM ({_cov(n, *p)})" for n, p in _PAIRS.items()),
    "account_balance s_customer schedule loan due_instalment",
)
def m10(src):
    return Q.coverage_report({n: (src[a], ka, src[b], kb) for n, (a, ka, b, kb) in _PAIRS.items()})


@query(
    "m11_department_agreement",
    f"""WITH {SCHEDULE_SCORING_SQL}, a AS (SELECT DISTINCT customer_id, department_id_scoring AS in_first FROM loan l
         JOIN department_scoring s ON CAST(l.customer_id % 24 AS VARCHAR) = s.department_id),
       b AS (SELECT DISTINCT customer_id, department_id_scoring AS in_second FROM schedule_scoring)
       SELECT a.customer_id, in_first, in_second FROM a LEFT JOIN b ON a.customer_id = b.customer_id WHERE in_first <> in_second""",
    SCHEDULE_SCORING_VIEWS,
)
def m11(src):
    loans = src["loan"].select("customer_id", (F.col("customer_id") % 24).cast("string").alias("department_id"))
    first = loans.join(src["department_scoring"], "department_id")
    return Q.differing(first, schedule_scoring(src), "customer_id", "department_id_scoring", "department_id_scoring")


@query(
    "m12_not_in",
    """WITH sc AS (SELECT DISTINCT s.contract_id, l.customer_id AS schedule_customer_id FROM schedule s JOIN loan l ON s.contract_id = l.loan_id),
       ls AS (SELECT loan_id AS contract_id, CASE WHEN product_code <> '21000' THEN customer_id ELSE -customer_id END AS loan_customer_id FROM loan)
       SELECT sc.*, ls.loan_customer_id FROM sc LEFT JOIN ls USING (contract_id)
       WHERE schedule_customer_id NOT IN (SELECT loan_customer_id FROM ls)""",
    "schedule loan",
)
def m12(src):
    loans = src["loan"]
    sched = (
        src["schedule"].select("contract_id").distinct()
        .join(loans.select(F.col("loan_id").alias("contract_id"), F.col("customer_id").alias("schedule_customer_id")), "contract_id")
    )
    known = F.when(F.col("product_code") != "21000", F.col("customer_id")).otherwise(-F.col("customer_id"))
    scored = loans.select(F.col("loan_id").alias("contract_id"), known.alias("loan_customer_id"))
    missing = J.not_in(sched, scored, "schedule_customer_id", "loan_customer_id")
    return missing.join(scored, "contract_id", "left")


_REPAY = """ev AS (SELECT DISTINCT contract_id, currency FROM typed_event),
 ln AS (SELECT loan_id, repayment_account_id FROM loan WHERE disbursement_date >= DATE '1996-01-01')"""


@query(
    "m13_repayment_accounts",
    f"""WITH {_REPAY} SELECT DISTINCT ev.contract_id, repayment_account_id AS account_id, CAST(f AS INT) AS in_balances FROM ev JOIN ln ON contract_id = loan_id
       LEFT JOIN (SELECT DISTINCT account_id, 1 AS f FROM account_balance) b ON repayment_account_id = b.account_id""",
    "typed_event loan account_balance",
)
def m13(src):
    return Q.repayment_accounts(src["typed_event"], src["loan"], src["account_balance"], "1996-01-01")


@query(
    "m13_currency_agreement",
    f"""WITH {_REPAY} SELECT ev.currency, b.currency AS account_currency, count(*) AS obs FROM ev JOIN ln ON contract_id = loan_id
       JOIN (SELECT DISTINCT account_id, currency FROM account_balance) b ON repayment_account_id = b.account_id GROUP BY 1, 2""",
    "typed_event loan account_balance",
)
def m13_currency(src):
    return Q.currency_agreement(src["typed_event"], src["loan"], src["account_balance"], "1996-01-01")


@query(
    "m14_balance_against_payment",
    """WITH ev AS (SELECT contract_id, contract_id % 1500 AS customer_id, DATE '2024-01-01' + CAST(contract_id % 30 AS INT) AS event_date, amount FROM typed_event),
       la AS (SELECT DISTINCT l.loan_id AS contract_id FROM loan l JOIN account_balance b ON l.repayment_account_id = b.account_id),
       ab AS (SELECT e.*, l.repayment_account_id FROM (SELECT contract_id, customer_id, event_date, CAST(sum(amount) AS BIGINT) AS amount_paid FROM ev GROUP BY 1, 2, 3) e
              LEFT JOIN loan l ON e.contract_id = l.loan_id)
       SELECT coalesce(ab.repayment_account_id, c.account_id) AS account_id, coalesce(ab.event_date, c.balance_date) AS date,
              coalesce(ab.customer_id, c.customer_id) AS customer_id, capital_balance, amount_paid, ab.contract_id
       FROM ab FULL JOIN account_balance c ON ab.repayment_account_id = c.account_id AND ab.event_date = c.balance_date
       JOIN la ON ab.contract_id = la.contract_id""",
    "typed_event loan account_balance",
)
def m14(src):
    events = src["typed_event"].select(
        "contract_id",
        (F.col("contract_id") % 1500).alias("customer_id"),
        F.expr("DATE '2024-01-01' + CAST(contract_id % 30 AS INT)").alias("event_date"),
        "amount",
    )
    known = src["account_balance"].select("account_id").distinct()
    contracts = src["loan"].join(known, F.col("repayment_account_id") == F.col("account_id"), "left_semi").select(
        F.col("loan_id").alias("contract_id")
    )
    return Q.balance_against_payment(events, src["loan"], src["account_balance"], contracts)


@query(
    "m15_repayment_share",
    """WITH lb AS (SELECT o.loan_id, o.customer_id FROM loan o JOIN year_snapshot y ON o.loan_id = y.loan_id WHERE y.principal_outstanding > 0 GROUP BY 1, 2),
       la AS (SELECT b.account_id, b.capital_balance FROM account_balance b JOIN (SELECT account_id, max(balance_date) AS d FROM account_balance GROUP BY 1) m
              ON b.account_id = m.account_id AND b.balance_date = m.d),
       ac AS (SELECT a.account_id, a.account_code, a.account_type, a.currency, la.capital_balance, max(CASE WHEN l.loan_id IS NOT NULL THEN 1 END) AS used
              FROM lb JOIN account a ON lb.customer_id = a.customer_id JOIN la ON a.account_id = la.account_id
              LEFT JOIN loan l ON l.loan_id = lb.loan_id AND l.repayment_account_id = a.account_id GROUP BY 1, 2, 3, 4, 5),
       r AS (SELECT currency, rate FROM month_rate WHERE rate_date = DATE '2024-01-01'),
       x AS (SELECT ac.*, capital_balance / CASE WHEN ac.currency = 'KHR' THEN 1 ELSE rate END AS khr FROM ac LEFT JOIN r ON ac.currency = r.currency)
       SELECT account_code, account_type, count(*) AS accounts, CAST(sum(used) AS BIGINT) AS repayment_accounts, CAST(round(sum(khr) * 60) AS BIGINT) AS balance_sixtieths,
         CAST(round(sum(CASE WHEN used > 0 THEN khr ELSE 0 END) * 60) AS BIGINT) AS repayment_sixtieths FROM x GROUP BY 1, 2""",
    "loan year_snapshot account_balance account month_rate",
)
def m15(src):
    held = src["loan"].select("loan_id", "customer_id").join(src["year_snapshot"], "loan_id")
    latest = V.latest_rows(src["account_balance"], ["account_id"], "balance_date")
    rates = src["month_rate"].where(F.col("rate_date") == "2024-01-01")
    accounts = src["account"].select("account_id", "customer_id", "account_code", "account_type", "currency")
    out = Q.repayment_share(held, src["loan"], accounts, latest, rates)
    return out.select(
        "account_code", "account_type", "accounts", "repayment_accounts",
        F.round(F.col("balance") * 60).cast("long").alias("balance_sixtieths"),
        F.round(F.col("repayment_balance") * 60).cast("long").alias("repayment_sixtieths"),
    )


_RULES = {
    "order digits": ("contract_text", "^LD[0-9]{10}$"),
    "customer id": ("customer_id", "^[0-9]{1,7}$"),
    "department": ("department_id", "^[A-Z]{3}$"),
    "manager id": ("portfolio_manager_id", "^[0-9]{1,4}$"),
    "product": ("product_code", "^[0-9]{5}$"),
}
_LOAN_TEXT = "t AS (SELECT *, concat('LD', CAST(loan_id + 1000000000 * (loan_id % 3) AS VARCHAR)) AS contract_text FROM loan)"


def _counted(n, cond, table="t"):
    return f"""SELECT '{n}' AS rule, CAST(coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0) AS BIGINT) AS matches, count(*) AS obs FROM {table}"""


@query(
    "m16_formats",
    f"WITH {_LOAN_TEXT}, c AS ("
    + " UNION ALL ".join(_counted(n, f"regexp_matches(CAST({c} AS VARCHAR), '{p}')") for n, (c, p) in _RULES.items())
    + f") SELECT *, {_PM.format(n='matches', d='obs')} AS share FROM c",
    "loan",
)
def m16(src):
    text = F.concat(F.lit("LD"), (F.col("loan_id") + 1000000000 * (F.col("loan_id") % 3)).cast("string"))
    return Q.format_report(src["loan"].withColumn("contract_text", text), _RULES)


_CONSISTENCY = {
    "total is the sum of its parts": "total_paid = capital_paid + interest_paid",
    "remaining interest without remaining capital": "capital_remaining = 0 AND interest_remaining > 0",
    "interest above capital": "interest_paid > capital_paid",
}


@query(
    "m17_rules",
    "WITH c AS ("
    + " UNION ALL ".join(_counted(n, c, "payment_event") for n, c in _CONSISTENCY.items())
    + f") SELECT *, {_PM.format(n='matches', d='obs')} AS share FROM c",
    "payment_event",
)
def m17(src):
    return Q.rule_report(src["payment_event"], {n: F.expr(c) for n, c in _CONSISTENCY.items()})


_PROFILED = {"date_text": "date_text", "number_text": "number_text", "l_linenumber": "CAST(l_linenumber AS VARCHAR)"}


@query(
    "m18_profile",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count(*) AS obs, count(*) FILTER ({e} IS NULL) AS missing, count(*) FILTER ({e} IN ('', '[NULL]')) AS blank,
        count(*) FILTER (TRY_CAST({e} AS DOUBLE) = 0) AS zero, count(DISTINCT {e}) AS "distinct", min({e}) AS smallest, max({e}) AS largest FROM core_text"""
        for c, e in _PROFILED.items()
    ),
    "core_text",
)
def m18(src):
    return Q.profile(src["core_text"], list(_PROFILED))


@query(
    "m19_disbursed_not_in_loans",
    """SELECT application_id, record_id, loan_id FROM loan_application WHERE stage = 'Disbursed' AND loan_id IS NOT NULL
       AND loan_id NOT IN (SELECT loan_id FROM loan)""",
    "loan_application loan",
)
def m19(src):
    return Q.disbursed_not_in_loans(src["loan_application"], src["loan"]).select("application_id", "record_id", "loan_id")


@query(
    "m19_contracts_without_application",
    """SELECT DISTINCT contract_id FROM typed_event e WHERE NOT EXISTS
       (SELECT 1 FROM loan_application a WHERE a.stage = 'Disbursed' AND a.loan_id = e.contract_id)""",
    "loan_application typed_event",
)
def m19_contracts(src):
    return Q.contracts_without_application(src["typed_event"], src["loan_application"])


@query(
    "m20_written_off_status",
    "SELECT status, count(*) AS obs FROM loan_snapshot WHERE loan_id IN (SELECT loan_id FROM written_off) GROUP BY 1",
    "loan_snapshot written_off",
)
def m20(src):
    return Q.written_off_status(src["loan_snapshot"], src["written_off"])


@query("d17_frequency", "SELECT currency, status, count(*) AS obs FROM loan GROUP BY 1, 2", "loan")
def d17(src):
    return Q.frequency(src["loan"], ["currency", "status"])


@query(
    "d17_cross_table",
    """SELECT product_code, count(*) FILTER (currency = 'USD') AS "n_USD", count(*) FILTER (currency = 'THB') AS "n_THB",
       count(*) FILTER (currency = 'KHR') AS "n_KHR" FROM loan GROUP BY 1""",
    "loan",
)
def d17_cross(src):
    return Q.cross_table(src["loan"], "product_code", "currency", ["USD", "THB", "KHR"])


@query(
    "d18_proportion",
    f"SELECT status, count(*) AS obs, {_PM.format(n='count(*)', d='(SELECT count(*) FROM instalment_history WHERE status IS NOT NULL)')} AS share "
    "FROM instalment_history WHERE status IS NOT NULL GROUP BY 1",
    "instalment_history",
)
def d18(src):
    return Q.proportion(src["instalment_history"], ["status"])


_Q = {c: f"CAST({c} AS DOUBLE)" for c in ("l_quantity", "l_extendedprice", "l_discount")}
_PROBS = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]


@query(
    "d19_quantiles",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", {', '.join(f'CAST(round(quantile_cont({e}, {p}) * 10000) AS BIGINT) AS q{round(p * 100)}' for p in _PROBS)} FROM lineitem"""
        for c, e in _Q.items()
    ),
)
def d19(src):
    out = Q.quantiles(src.table("lineitem"), list(_Q), _PROBS)
    return out.select("column", *[F.round(F.col(c) * 10000).cast("long").alias(c) for c in out.columns if c != "column"])


@query(
    "d20_summary",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", min({c}) AS minimum, CAST(quantile_cont({c}, 0.25) AS BIGINT) AS first_quartile, CAST(quantile_cont({c}, 0.5) AS BIGINT) AS median,
        CAST(floor(avg({c})) AS BIGINT) AS mean, CAST(quantile_cont({c}, 0.75) AS BIGINT) AS third_quartile, max({c}) AS maximum, count(*) FILTER ({c} IS NULL) AS missing FROM
        (SELECT l_partkey, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_suppkey END AS l_suppkey FROM lineitem)"""
        for c in ("l_partkey", "l_suppkey")
    ),
)
def d20(src):
    df = src.table("lineitem").select(
        "l_partkey", F.when(F.col("l_linenumber") != 1, F.col("l_suppkey")).alias("l_suppkey")
    )
    out = Q.summary(df, ["l_partkey", "l_suppkey"])
    whole = ["minimum", "first_quartile", "median", "third_quartile", "maximum"]
    return out.withColumns(
        {**{c: F.round(c).cast("long") for c in whole}, "mean": F.floor("mean").cast("long")}
    )


@query(
    "d22_uniqueness",
    f"""SELECT {_PM.format(n='count(DISTINCT loan_id)', d='count(*)')} AS loan, {_PM.format(n='count(DISTINCT customer_id)', d='count(*)')} AS customer,
       {_PM.format(n="count(DISTINCT concat(customer_id, '|', disbursement_date))", d='count(*)')} AS customer_day FROM loan""",
    "loan",
)
def d22(src):
    return Q.uniqueness(
        src["loan"], {"loan": ["loan_id"], "customer": ["customer_id"], "customer_day": ["customer_id", "disbursement_date"]}
    )


@query(
    "d24_duplicates",
    """SELECT customer_id, update_date, record_id, copies FROM (SELECT *, count(*) OVER (PARTITION BY customer_id, update_date) AS copies FROM customer_history)
       WHERE copies > 1""",
    "customer_history",
)
def d24(src):
    df = src["customer_history"].select("customer_id", "update_date", "record_id")
    return Q.duplicates(df, ["customer_id", "update_date"])


@query(
    "d11_ratio_of_sums",
    """SELECT portfolio_manager_id, CAST(sum(CASE WHEN days_overdue > 30 THEN principal_outstanding ELSE 0 END) * 1000000 // sum(principal_outstanding) AS BIGINT) AS par30
       FROM s_balance GROUP BY 1""",
    "s_balance",
)
def d11(src):
    late = F.sum(F.when(F.col("days_overdue") > 30, F.col("principal_outstanding")).otherwise(0))
    return src["s_balance"].groupBy("portfolio_manager_id").agg(
        per_million(late, F.sum("principal_outstanding")).alias("par30")
    )
