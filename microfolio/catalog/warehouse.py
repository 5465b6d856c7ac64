"""Warehouse builders and the versioning, decoding and conversion steps they are made of."""

import uuid

from pyspark.sql import functions as F

from ..operators import decode as D
from ..operators import fx as X
from ..operators import versioning as V
from ..operators.windows import group_max
from ..plans import warehouse as W
from ..session import stages_folder
from .base import ORACLE, query


def _names(fields: dict[str, tuple[str, str]]) -> tuple[str, str]:
    """Select list and joins that decode the given columns in the comparison SQL."""
    picks = ", ".join(f"x{i}.field_description AS {out}" for i, (_, out) in enumerate(fields.values()))
    joins = " ".join(
        f"LEFT JOIN dictionary x{i} ON upper(x{i}.field_name) = '{field}' AND b.{code} = x{i}.field_code"
        for i, (code, (field, _)) in enumerate(fields.items())
    )
    return picks, joins


def _usd(amounts, prefix="b."):
    return ", ".join(f"{prefix}{a} * coalesce(r.rate, 1) AS {a}_usd" for a in amounts)


_DEP = {"department_id": ("DEPARTMENT_ID", "department_name")}
_PROD = {"product_code": ("LOAN_PRODUCT_CODE", "product_name")}


@query(
    "e1_version_counter",
    """SELECT contract_id, instalment, update_date, line_part, line_supp,
              count(*) OVER (PARTITION BY contract_id, instalment ORDER BY update_date DESC) AS version
       FROM instalment_history""",
    "instalment_history",
)
def e1(src):
    df = src["instalment_history"].select("contract_id", "instalment", "update_date", "line_part", "line_supp")
    return V.version_counter(df, ["contract_id", "instalment"], "update_date")


@query(
    "e2_oldest_version",
    """SELECT loan_id, update_date, portfolio_manager_id, disbursement_amount FROM
       (SELECT *, count(*) OVER (PARTITION BY loan_id ORDER BY update_date NULLS FIRST) AS n FROM s_loan) WHERE n = 1""",
    "s_loan",
)
def e2(src):
    return V.first_version(
        src["s_loan"], ["loan_id"], "update_date", ["portfolio_manager_id", "disbursement_amount"], oldest=True
    )


@query(
    "e5_month_versions",
    """SELECT *, count(*) OVER (PARTITION BY contract_id, due_month ORDER BY update_date DESC) AS version FROM
       (SELECT DISTINCT contract_id, date_trunc('month', due_date)::DATE AS due_month, update_date FROM r_schedule)""",
    "r_schedule",
)
def e5(src):
    months = src["r_schedule"].withColumn("due_month", F.trunc("due_date", "MM"))
    return V.numbered_versions(months, ["contract_id", "due_month"], "update_date").withColumn(
        "version", F.col("version").cast("long")
    )


@query(
    "e8_scd2",
    """SELECT customer_id, update_date, record_id,
              lead(update_date) OVER (PARTITION BY customer_id ORDER BY update_date NULLS FIRST, record_id) AS valid_to,
              count(*) OVER (PARTITION BY customer_id ORDER BY update_date DESC) AS version
       FROM customer_history""",
    "customer_history",
)
def e8(src):
    df = src["customer_history"].select("customer_id", "update_date", "record_id")
    return V.with_history(df, ["customer_id"], "update_date", ["record_id"])


_TWO_LOADS = """two AS (SELECT field_name, field_code, field_description FROM dictionary
  UNION ALL SELECT lower(field_name), field_code, CASE WHEN field_code = '1' THEN 'OTHER' ELSE field_description END FROM dictionary WHERE length(field_code) = 1)"""


@query(
    "j14_repeated_codes",
    f"""WITH {_TWO_LOADS} SELECT upper(field_name) AS field_name, field_code, count(*) AS entries, count(DISTINCT field_description) AS descriptions
        FROM two GROUP BY 1, 2 HAVING count(*) > 1""",
    "dictionary",
)
def j14_repeated(src):
    """Two loads of the dictionary that overlap: the codes that would double rows."""
    first = src["dictionary"].select("field_name", "field_code", "field_description")
    other = F.when(F.col("field_code") == "1", "OTHER").otherwise(F.col("field_description")).alias("field_description")
    second = first.where(F.length("field_code") == 1).select(F.lower("field_name").alias("field_name"), "field_code", other)
    return D.repeated_codes(first.unionByName(second))


@query(
    "j15_repeated_rates",
    """SELECT currency, rate_date, count(*) AS rates FROM (SELECT currency, rate_date FROM fx UNION ALL
       SELECT currency, rate_date FROM fx_events UNION ALL SELECT currency, rate_date FROM fx WHERE rate % 2 = 0) GROUP BY 1, 2 HAVING count(*) > 1""",
    "fx fx_events",
)
def j15_repeated(src):
    """Rates of several loads: currencies and days that ``one_rate`` has to decide."""
    rates = [src[v].select("currency", "rate_date", "rate") for v in ("fx", "fx_events")]
    return X.repeated_rates(rates[0].unionByName(rates[1]).unionByName(rates[0].where("rate % 2 = 0")))


@query("e8_history_by_loads", ORACLE["e8_scd2"])
def e8_by_loads(src):
    """The same table kept up from three loads; each brings rows before, between and after those that are there, and the last one some again."""
    rows = src["customer_history"].select("customer_id", "update_date", "record_id")
    path = f"{stages_folder(src.spark)}/history-{uuid.uuid4().hex}"
    load = F.pmod(F.xxhash64("record_id"), F.lit(3))
    for wanted in ([0], [1], [1, 2]):
        V.merge_history(rows.where(load.isin(wanted)), path, ["customer_id"], "update_date", ["record_id"], 16)
    return src.spark.read.parquet(path).drop("key_bucket")


@query(
    "e16_newest_update_in_month",
    """SELECT contract_id, due_date, update_date, capital_due FROM
       (SELECT *, rank() OVER (PARTITION BY contract_id, date_trunc('month', due_date) ORDER BY update_date DESC) AS r FROM r_schedule)
       WHERE r = 1""",
    "r_schedule",
)
def e16(src):
    months = src["r_schedule"].withColumn("due_month", F.trunc("due_date", "MM"))
    return V.latest_rows(months, ["contract_id", "due_month"], "update_date").select(
        "contract_id", "due_date", "update_date", "capital_due"
    )


@query(
    "c14_latest_by_max",
    """SELECT b.* FROM account_balance b JOIN
       (SELECT account_id AS a, max(balance_date) AS d FROM account_balance GROUP BY 1) m
       ON b.account_id = m.a AND b.balance_date = m.d""",
    "account_balance",
)
def c14(src):
    return V.latest_rows(src["account_balance"], ["account_id"], "balance_date")


@query(
    "c13_latest_snapshot",
    "SELECT * FROM loan_snapshot WHERE balance_date = (SELECT max(balance_date) FROM loan_snapshot)",
    "loan_snapshot",
)
def c13(src):
    return V.latest_snapshot(src["loan_snapshot"], "balance_date")


@query(
    "j1_dictionary",
    """SELECT field_name, field_code, field_description, update_date FROM
       (SELECT d.*, m.update_date FROM dictionary d CROSS JOIN manager_history m
        WHERE d.field_code = m.department_id)
       WHERE update_date = (SELECT max(update_date) FROM manager_history)""",
    "dictionary manager_history",
)
def j1(src):
    loads = src["manager_history"].select(F.col("department_id").alias("field_code"), "update_date")
    raw = src["dictionary"].join(loads, "field_code").select("field_name", "field_code", "field_description", "update_date")
    return W.build_dictionary(raw)


@query(
    "j2_currency",
    """SELECT base, quote, rate_date, update_time, rate FROM (
         SELECT *, count(*) OVER (PARTITION BY base, quote, rate_date ORDER BY update_time DESC) AS n FROM (
           SELECT currency AS base, 'USD' AS quote, CAST(update_time AS DATE) AS rate_date, update_time, requested_amount AS rate
           FROM loan_application)) WHERE n = 1""",
    "loan_application",
)
def j2(src):
    raw = src["loan_application"].select(
        F.col("currency").alias("base"),
        F.lit("USD").alias("quote"),
        F.col("update_time").cast("date").alias("rate_date"),
        "update_time",
        F.col("requested_amount").alias("rate"),
    )
    return W.build_currency(raw)


_F = {**_DEP, "code": ("TRANSACTION_TYPE_CODE", "transaction_type_name")}
_P, _J = _names(_F)


@query(
    "j3_transaction",
    f"""WITH b AS (SELECT *, count(*) OVER (PARTITION BY transaction_id ORDER BY transaction_time DESC) AS version
                  FROM (SELECT transaction_id % 3000 AS transaction_id, account_id, transaction_time, amount, code, department_id, currency
                        FROM account_movement))
       SELECT b.*, {_P}, {_usd(['amount'])} FROM b {_J}
       LEFT JOIN fx_events r ON b.currency = r.currency AND CAST(b.transaction_time AS DATE) = r.rate_date""",
    "account_movement dictionary fx_events",
)
def j3(src):
    raw = src["account_movement"].select(
        (F.col("transaction_id") % 3000).alias("transaction_id"),
        "account_id",
        "transaction_time",
        "amount",
        "code",
        "department_id",
        "currency",
    )
    return W.build_transaction(raw, src["dictionary"], src["fx_events"])


_F = {
    **_DEP,
    "company_sublevel1_id": ("COMPANY_SUBLEVEL1_ID", "company_sublevel1_name"),
    "department_sublevel1_id": ("DEPARTMENT_SUBLEVEL1_ID", "department_sublevel1_name"),
}
_P, _J = _names(_F)


@query(
    "j4_portfolio_manager",
    f"""WITH b AS (SELECT *, lead(update_date) OVER (PARTITION BY portfolio_manager_id ORDER BY update_date NULLS FIRST, record_id) AS valid_to,
                  count(*) OVER (PARTITION BY portfolio_manager_id ORDER BY update_date DESC) AS version FROM manager_history)
       SELECT b.*, {_P} FROM b {_J}""",
    "manager_history dictionary",
)
def j4(src):
    return W.build_portfolio_manager(src["manager_history"], src["dictionary"], ["record_id"])


_F = {
    "area_code": ("CUSTOMER_AREA_CODE", "area_name"),
    "sector_code": ("SECTOR_CODE", "sector_name"),
    "subsector_code": ("SUBSECTOR_CODE", "subsector_name"),
    **_DEP,
}
_P, _J = _names(_F)
_CUSTOMER = f"""WITH b AS (SELECT *, lead(update_date) OVER (PARTITION BY customer_id ORDER BY update_date NULLS FIRST, record_id) AS valid_to,
                  count(*) OVER (PARTITION BY customer_id ORDER BY update_date DESC) AS version FROM customer_history)
       SELECT b.*, {_P} FROM b {_J}"""


@query("j5_customer", _CUSTOMER, "customer_history dictionary")
def j5(src):
    return W.build_customer(src["customer_history"], src["dictionary"], ["record_id"])


@query("j6_customer_exact_case", _CUSTOMER.replace("upper(x3.field_name)", "x3.field_name"), "customer_history dictionary")
def j6(src):
    return W.build_customer(src["customer_history"], src["dictionary"], ["record_id"], exact_case=True)


@query(
    "j7_account_balance",
    f"""WITH b AS (SELECT *, count(*) OVER (PARTITION BY account_id ORDER BY balance_date DESC) AS version FROM account_balance)
       SELECT b.*, x.field_description AS account_product_name, {_usd(['capital_balance', 'available_balance'])} FROM b
       LEFT JOIN dictionary x ON x.field_name = 'ACCOUNT_CODE' AND x.field_code = b.account_code
       LEFT JOIN fx_events r ON b.currency = r.currency AND b.balance_date = r.rate_date""",
    "account_balance dictionary fx_events",
)
def j7(src):
    return W.build_account_balance(src["account_balance"], src["dictionary"], src["fx_events"])


_F = {**_DEP, "account_code": ("ACCOUNT_CODE", "account_product_name")}
_P, _J = _names(_F)


@query(
    "j8_account",
    f"""WITH b AS (SELECT *, lead(update_date) OVER (PARTITION BY account_id ORDER BY update_date NULLS FIRST, record_id) AS valid_to,
                  count(*) OVER (PARTITION BY account_id ORDER BY update_date DESC) AS version FROM account_history)
       SELECT b.*, {_P}, {_usd(['overdraft_amount'])} FROM b {_J}
       LEFT JOIN fx_events r ON b.currency = r.currency AND b.update_date = r.rate_date""",
    "account_history dictionary fx_events",
)
def j8(src):
    return W.build_account(src["account_history"], src["dictionary"], src["fx_events"], ["record_id"])


_F = {**_DEP, **_PROD}
_P, _J = _names(_F)
_LOANS = ["net_disbursed_amount", "capital_disbursed_amount"]
_TIE = "line_part, line_supp, line_no, capital_disbursed_amount"


@query(
    "j9_loan",
    f"""WITH b AS (SELECT *, lead(update_date) OVER (PARTITION BY loan_id ORDER BY update_date NULLS FIRST, {_TIE}) AS valid_to,
                  count(*) OVER (PARTITION BY loan_id ORDER BY update_date DESC) AS version FROM loan_history)
       SELECT b.*, {_P}, {_usd(_LOANS)} FROM b {_J}
       LEFT JOIN fx r ON b.currency = r.currency AND b.update_date = r.rate_date""",
    "loan_history dictionary fx",
)
def j9(src):
    return W.build_loan(src["loan_history"], src["dictionary"], src["fx"], _TIE.split(", "))


_F = {
    "stage_code": ("LOANAPPLICATION_STAGE_CODE", "stage_name"),
    **_DEP,
    "purpose_code": ("LOAN_PURPOSE_CODE", "purpose_name"),
    **_PROD,
}
_P, _J = _names(_F)


@query(
    "j10_loan_application",
    f"""WITH b AS (SELECT *, count(*) OVER (PARTITION BY application_id ORDER BY update_time DESC) AS version FROM loan_application)
       SELECT b.*, {_P}, {_usd(['requested_amount', 'reviewed_amount', 'approved_amount'])} FROM b {_J}
       LEFT JOIN fx_events r ON b.currency = r.currency AND CAST(b.update_time AS DATE) = r.rate_date""",
    "loan_application dictionary fx_events",
)
def j10(src):
    return W.build_loan_application(src["loan_application"], src["dictionary"], src["fx_events"])


_CURRENT = """cur AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY loan_id ORDER BY update_date DESC) AS n FROM loan_history) WHERE n = 1)"""


def current_loans(src, cols):
    return V.first_version(src["loan_history"], ["loan_id"], "update_date", cols)


@query(
    "j11_schedule",
    f"""WITH {_CURRENT}, b AS (SELECT *, count(*) OVER (PARTITION BY contract_id, instalment ORDER BY update_date DESC) AS version FROM instalment_history)
       SELECT b.*, {_usd(['total_due', 'capital_due', 'interest_due'])} FROM b JOIN cur ON b.contract_id = cur.loan_id
       LEFT JOIN fx r ON b.currency = r.currency AND b.update_date = r.rate_date""",
    "instalment_history loan_history fx",
)
def j11(src):
    return W.build_schedule(src["instalment_history"], current_loans(src, ["department_id"]), src["fx"])


_P, _J = _names(_PROD)


@query(
    "j12_loan_balance",
    f"""WITH {_CURRENT}, b0 AS (SELECT *, count(*) OVER (PARTITION BY loan_id ORDER BY balance_date DESC) AS version FROM loan_snapshot),
       b AS (SELECT b0.*, c.department_id, c.portfolio_manager_id, c.net_disbursed_amount, c.capital_disbursed_amount
             FROM b0 LEFT JOIN cur c ON b0.loan_id = c.loan_id)
       SELECT b.*, {_P}, xd.field_description AS department_name, {_usd(W.LOAN_BALANCE_AMOUNTS + _LOANS)} FROM b {_J}
       LEFT JOIN dictionary xd ON upper(xd.field_name) = 'DEPARTMENT_ID' AND xd.field_code = b.department_id
       LEFT JOIN fx r ON b.currency = r.currency AND b.balance_date = r.rate_date""",
    "loan_snapshot loan_history dictionary fx",
)
def j12(src):
    loans = current_loans(src, ["department_id", "portfolio_manager_id", *_LOANS]).drop("update_date")
    return W.build_loan_balance(src["loan_snapshot"], loans, src["dictionary"], src["fx"])


@query(
    "j13_event",
    f"""WITH b AS (SELECT *, count(*) OVER (PARTITION BY contract_id, instalment, transaction_id ORDER BY event_time DESC) AS version FROM payment_event)
       SELECT b.*, {_usd(W.EVENT_AMOUNTS)} FROM b LEFT JOIN fx r ON b.currency = r.currency AND b.due_date = r.rate_date""",
    "payment_event fx",
)
def j13(src):
    return W.build_event(src["payment_event"], src["fx"])


_P, _J = _names({**_DEP, **_PROD})


@query(
    "j14_decode",
    f"SELECT b.loan_id, b.department_id, b.product_code, {_P} FROM loan_history b {_J}",
    "loan_history dictionary",
)
def j14(src):
    df = src["loan_history"].select("loan_id", "department_id", "product_code")
    return D.decode(df, src["dictionary"], {**_DEP, **_PROD})


@query(
    "j15_to_usd",
    f"""SELECT b.loan_id, b.currency, b.disbursement_date, b.capital_disbursed_amount, {_usd(['capital_disbursed_amount'])}
       FROM loan b LEFT JOIN fx r ON b.currency = r.currency AND b.disbursement_date = r.rate_date""",
    "loan fx",
)
def j15(src):
    df = src["loan"].select("loan_id", "currency", "disbursement_date", "capital_disbursed_amount")
    return X.to_usd(df, src["fx"], ["capital_disbursed_amount"], date="disbursement_date")


@query(
    "e15_group_maximum",
    "SELECT event_id, user_id, max(ts) OVER (PARTITION BY user_id) AS last_ts FROM events",
)
def e15(src):
    ev = src.table("events").select("event_id", "user_id", "ts")
    return group_max(ev, ["user_id"], "ts", "last_ts").drop("ts")
