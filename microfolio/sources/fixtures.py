"""Views that present the supplied star-schema tables as loan-portfolio tables.

Each view is one SELECT in the SQL both Spark and DuckDB accept; ``{orders}`` and the like stand
for the supplied tables. Money is whole cents (or hundredths of cents) in 64-bit integers, so
sums and products are exact. Every view reads its tables whole and keeps every row; where two tables
must disagree, a row carries a key that the other one lacks (negative, or marked), or a zero amount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

_CCY = (
    "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'USD' "
    "WHEN o_orderpriority = '3-MEDIUM' THEN 'THB' ELSE 'KHR' END"
)
_EXT = "CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)"
_DISC = "CAST(floor(l_discount * 100 + 0.5) AS BIGINT)"
_TAX = "CAST(floor(l_tax * 100 + 0.5) AS BIGINT)"
_PRODUCT = "CASE {k} % 6 WHEN 0 THEN '21056' WHEN 1 THEN '3900' WHEN 2 THEN '21050' ELSE '21000' END"
_CURRENCY_OF_KEY = "CASE {k} % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END"



def _money(cents: str) -> str:
    """Cents as a text with two decimals."""
    return f"concat(CAST(CAST(floor(({cents}) / 100) AS BIGINT) AS STRING), '.', lpad(CAST(({cents}) % 100 AS STRING), 2, '0'))"


def _padded(prefix: str, key: str, digits: int) -> str:
    """A prefix and a number of fixed length; every 17th stays short."""
    return f"concat('{prefix}', CASE WHEN {key} % 17 = 0 THEN CAST({key} AS STRING) ELSE lpad(CAST({key} AS STRING), {digits}, '0') END)"


_CENTS = "CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)"

VIEWS = {
    # ---- text forms of the raw tables, for their contracts ----------------------------
    "c_customer": """
        SELECT CAST(c_custkey AS STRING) AS customer_id, CASE WHEN c_custkey % 23 <> 0 THEN CAST(c_custkey * 3 % 12000 AS STRING) END AS portfolio_manager_id,
               CASE WHEN c_custkey % 31 = 0 THEN '' ELSE substr(c_mktsegment, 1, 3) END AS department_id, CAST(c_nationkey AS STRING) AS area_code,
               CAST(1900 + c_custkey % 125 AS INT) AS birth_year, CAST(1 + c_custkey % 12 AS INT) AS birth_month,
               DATE '2019-01-01' + CAST(c_custkey % 300 AS INT) AS creation_date, DATE '2019-01-01' + CAST(c_custkey * 7 % 400 AS INT) AS update_date
        FROM {customer}""",
    "c_account": f"""
        SELECT CAST(c_custkey AS STRING) AS account_id, CAST(c_custkey * 5 % 1700 AS STRING) AS customer_id,
               CAST(c_custkey % 11000 AS STRING) AS portfolio_manager_id, substr(c_mktsegment, 1, 3) AS department_id,
               {_padded('', 'c_custkey % 9000', 4)} AS account_code, concat('0.', CAST(c_custkey % 13000 AS STRING)) AS interest_rate,
               concat(lpad(CAST(c_nationkey AS STRING), 3, '0'), '-', lpad(CAST(c_custkey AS STRING), CASE WHEN c_custkey % 9 = 0 THEN 6 ELSE 7 END, '0')) AS dashed_id,
               CASE WHEN c_custkey % 8 = 0 THEN 'TD' ELSE 'SA' END AS account_type, CASE WHEN c_custkey % 10 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status,
               DATE '2018-01-01' + CAST(c_custkey % 700 AS INT) AS start_date, CASE WHEN c_custkey % 20 = 0 THEN DATE '2020-01-31' END AS end_date,
               CASE WHEN c_custkey % 16 = 0 THEN DATE '2025-01-31' END AS maturity_date, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS balance
        FROM {{customer}}""",
    "c_loan": f"""
        SELECT {_padded('LD', 'o_orderkey', 10)} AS loan_id, CAST(o_custkey AS STRING) AS customer_id, upper(substr(o_orderpriority, 3, 3)) AS department_id,
               CAST(o_custkey % 12000 AS STRING) AS portfolio_manager_id, CAST(o_orderkey * 11 % 1500000 AS STRING) AS purpose_code,
               {_money(_CENTS)} AS disbursed_text, CASE WHEN o_custkey % 19 <> 0 THEN CAST(o_custkey * 2 AS STRING) END AS repayment_account_id,
               CASE WHEN o_custkey % 2 = 0 THEN '' ELSE CAST(o_custkey % 50 AS STRING) END AS guarantor_ids,
               CASE WHEN o_custkey % 3 <> 0 THEN CAST(o_custkey % 4 AS INT) END AS guarantors_number, CAST(o_orderdate AS DATE) AS start_date,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 6 - 1 AS INT) AS disbursement_date,
               CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + 365 END AS end_date,
               CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'ACTIVE' END AS status, {_CENTS} + o_orderkey % 7 - 5 AS net_disbursed_amount,
               {_CENTS} AS capital_disbursed_amount, CAST(o_orderkey % 84 AS INT) AS instalments_number, CAST(o_custkey % 1004 AS INT) AS cycle_number
        FROM {{orders}}""",
    "c_loan_balance": f"""
        SELECT {_padded('LD', 'l_orderkey', 10)} AS loan_id, CAST(l_partkey % 130000 AS STRING) AS product_code, CAST(l_partkey AS STRING) AS customer_id,
               {_DISC} AS principal_overdue, {_TAX} AS interest_overdue, CAST(l_linenumber % 2 AS BIGINT) AS penalty_overdue,
               CAST(l_suppkey % 23 AS BIGINT) AS days_overdue, {_EXT} AS principal_outstanding
        FROM {{lineitem}}""",
    "c_schedule": f"""
        SELECT {_padded('LD', 'l_orderkey', 10)} AS contract_id, l_linenumber AS instalment, {_money(_EXT + ' + ' + _TAX)} AS total_text,
               CASE WHEN l_linenumber % 2 = 0 THEN CAST({_EXT} AS STRING) ELSE {_money(_EXT)} END AS capital_text, {_money(_TAX)} AS interest_text,
               {_EXT} / 100.0 AS capital_due, {_TAX} / 100.0 AS interest_due,
               ({_EXT} + {_TAX} + CASE WHEN l_partkey % 41 = 0 THEN 1 ELSE 0 END) / 100.0 AS total_due, {_TAX} AS interest_cents
        FROM {{lineitem}}""",
    "c_event": f"""
        SELECT {_padded('LD', 'l_orderkey + l_suppkey % 3', 10)} AS contract_id, {_padded('', 'l_orderkey * 10 + l_linenumber % 4', 15)} AS transaction_id,
               CASE WHEN l_partkey % 37 <> 0 THEN {_money(_EXT)} END AS total_text, ({_EXT} - {_TAX} - {_DISC}) / 100.0 AS capital_paid, {_TAX} / 100.0 AS interest_paid,
               {_DISC} / 100.0 AS penalty_paid, ({_EXT} + CASE WHEN l_partkey % 29 = 0 THEN 5 ELSE 0 END) / 100.0 AS total_paid, {_DISC} AS penalty_cents,
               CASE WHEN l_suppkey % 4 = 0 THEN 'EP' ELSE 'NP' END AS event, CAST(l_shipdate AS DATE) AS due_date,
               CAST(l_shipdate AS DATE) + CAST(l_partkey % 9 - 7 AS INT) AS event_date
        FROM {{lineitem}}""",
    "c_transaction": f"""
        SELECT {_padded('', 'event_id', 15)} AS transaction_id, CAST(user_id * 9001 AS STRING) AS customer_id, CAST(user_id * 3 AS STRING) AS account_id,
               upper(substr(event_type, 1, 3)) AS department_id, CAST(event_id % 1100 AS STRING) AS type_code,
               CASE WHEN event_id % 3 = 0 THEN '[NULL]' WHEN event_id % 5 <> 0 THEN CAST(user_id AS STRING) END AS counterpart_id, 'OTC' AS operator_id,
               CAST(floor(value * 100 + 0.5) AS BIGINT) * (event_id % 3 - 1) AS amount, CAST(ts AS DATE) + CAST(event_id % 13 % 2 AS INT) AS value_date,
               CAST(ts AS DATE) AS event_date, CASE WHEN event_id % 11 = 0 THEN 'Y' ELSE 'N' END AS reversal_flag,
               CASE WHEN event_id % 22 = 0 THEN 'F' ELSE 'C' END AS success_code
        FROM {{events}}""",
    "c_application": f"""
        SELECT {_padded('ICLA', 'event_id % 4000', 10)} AS application_id, CAST(user_id AS STRING) AS customer_id, CAST(user_id * 7 % 12000 AS STRING) AS manager_id,
               concat(lpad(CAST(event_id % 300 AS STRING), 3, '0'), '-', lpad(CAST(event_id AS STRING), 7, '0')) AS dashed_id,
               CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type END AS stage,
               CAST(floor(value * 80 + 0.5) AS BIGINT) + event_id % 90 AS approved_amount, CAST(floor(value * 100 + 0.5) AS BIGINT) AS requested_amount
        FROM {{events}}""",
    # ---- allocation -------------------------------------------------------------------
    "schedule": f"""
        SELECT l_orderkey AS contract_id, l_linenumber AS instalment, CAST(l_shipdate AS DATE) AS due_date,
               {_EXT} * (100 - {_DISC}) AS capital_due, {_EXT} * {_TAX} AS interest_due
        FROM {{lineitem}}""",
    "payment": f"""
        SELECT l_orderkey AS contract_id,
               CAST(l_shipdate AS DATE) + CAST(l_suppkey % 15 - 5 AS INT) AS event_date,
               {_EXT} * 90 AS amount,
               CASE WHEN l_linenumber = 7 THEN '752' WHEN l_returnflag = 'R' THEN '420'
                    WHEN l_returnflag = 'A' THEN '434' ELSE '423' END AS code
        FROM {{lineitem}}""",
    "opening_arrears": """
        SELECT o_orderkey AS contract_id, DATE '1994-12-31' AS balance_date,
               CASE WHEN o_orderstatus = 'P' THEN CAST(floor(o_totalprice + 0.5) AS BIGINT) * 100 ELSE 0 END AS principal_overdue,
               CASE WHEN o_custkey % 4 = 0 THEN CAST(floor(o_totalprice + 0.5) AS BIGINT) ELSE 0 END AS interest_overdue
        FROM {orders}""",
    # ---- loans, customers, accounts ---------------------------------------------------
    "loan": f"""
        SELECT o_orderkey AS loan_id, o_custkey AS customer_id, {_CCY} AS currency,
               CAST(o_orderdate AS DATE) AS disbursement_date,
               CAST(o_orderdate AS DATE) + CAST(365 + 365 * (o_orderkey % 3) AS INT) AS maturity_date,
               CAST(o_orderdate AS DATE) + CAST(300 + o_orderkey % 200 AS INT) AS end_date,
               CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS update_date,
               CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'ACTIVE' END AS status,
               o_orderstatus = 'P' AS restructured,
               {_PRODUCT.format(k='o_orderkey')} AS product_code,
               CASE WHEN o_orderkey % 7 = 0 THEN 'FLEXIBLE' ELSE 'FIXED' END AS payment_type,
               CAST(o_custkey % 25 AS STRING) AS department_id,
               CAST(o_custkey % 100 AS STRING) AS portfolio_manager_id,
               1 + o_orderkey % 4 AS cycle,
               CAST(o_custkey % 90 AS BIGINT) AS repayment_account_id,
               CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT) AS capital_disbursed_amount
        FROM {{orders}}""",
    "loan_history": f"""
        SELECT l_orderkey AS loan_id, CAST(l_shipdate AS DATE) AS update_date,
               l_partkey AS line_part, l_suppkey AS line_supp, l_linenumber AS line_no,
               CAST(l_suppkey % 25 AS STRING) AS department_id, CAST(l_partkey % 7 AS STRING) AS product_code,
               CAST(l_suppkey % 100 AS STRING) AS portfolio_manager_id,
               {_CURRENCY_OF_KEY.format(k='l_orderkey')} AS currency,
               {_EXT} AS capital_disbursed_amount, {_EXT} - {_DISC} * 100 AS net_disbursed_amount
        FROM {{lineitem}}""",
    "loan_snapshot": f"""
        SELECT l_orderkey AS loan_id, CAST(l_shipdate AS DATE) AS balance_date, l_partkey AS line_part,
               l_partkey % 1500 AS customer_id, CAST(l_partkey % 7 AS STRING) AS product_code,
               CASE WHEN l_linestatus = 'O' THEN 'ACTIVE' ELSE 'CLOSED' END AS status,
               {_CURRENCY_OF_KEY.format(k='l_orderkey')} AS currency,
               {_EXT} AS principal_outstanding, {_EXT} * {_DISC} AS principal_overdue,
               {_EXT} * {_TAX} AS interest_outstanding, {_TAX} * 100 AS interest_overdue,
               CAST(l_quantity AS BIGINT) AS penalty_overdue
        FROM {{lineitem}}""",
    "year_snapshot": f"""
        SELECT l_orderkey AS loan_id, CAST(date_trunc('year', l_shipdate) AS DATE) AS balance_date,
               max(CASE WHEN l_linestatus = 'O' THEN 'ACTIVE' ELSE 'CLOSED' END) AS status,
               CAST(sum({_EXT}) AS BIGINT) AS principal_outstanding
        FROM {{lineitem}} GROUP BY 1, 2""",
    "customer_history": """
        SELECT o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS update_date, o_orderkey AS record_id,
               CAST(o_custkey % 5 AS STRING) AS area_code, CAST(o_orderkey % 25 AS STRING) AS department_id,
               CAST(o_orderkey % 7 AS STRING) AS sector_code, CAST(o_orderkey % 5 AS STRING) AS subsector_code
        FROM {orders}""",
    "manager_history": """
        SELECT s_suppkey % 40 AS portfolio_manager_id, s_suppkey AS record_id,
               DATE '2019-01-01' + CAST(s_suppkey % 9 AS INT) AS update_date, s_name AS manager_name,
               CAST(s_nationkey AS STRING) AS department_id, CAST(n_regionkey AS STRING) AS company_sublevel1_id,
               CAST(s_nationkey % 3 AS STRING) AS department_sublevel1_id
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey""",
    "account": """
        SELECT c_custkey AS account_id, c_custkey AS customer_id, CAST(c_nationkey AS STRING) AS department_id,
               CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'CA' ELSE 'SA' END AS account_type,
               CAST(c_nationkey AS STRING) AS account_code, c_mktsegment,
               CASE c_custkey % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END AS currency,
               CASE WHEN c_custkey % 10 = 0 THEN 'CLOSED' ELSE 'OPEN' END AS status,
               CASE WHEN c_custkey % 20 = 0 THEN DATE '2020-01-31' END AS end_date,
               CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS capital_balance
        FROM {customer}""",
    "account_history": """
        SELECT user_id AS account_id, CAST(ts AS DATE) AS update_date, event_id AS record_id,
               CAST(user_id % 25 AS STRING) AS department_id, CAST(event_id % 25 AS STRING) AS account_code,
               CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END AS currency,
               CAST(floor(value * 100 + 0.5) AS BIGINT) AS overdraft_amount
        FROM {events}""",
    "account_balance": """
        SELECT user_id AS account_id, user_id AS customer_id, CAST(ts AS DATE) AS balance_date,
               CAST(user_id % 25 AS STRING) AS account_code,
               CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END AS currency,
               CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS capital_balance,
               CAST(max(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS available_balance
        FROM {events} GROUP BY user_id, CAST(ts AS DATE)""",
    "account_movement": """
        SELECT event_id AS transaction_id, user_id AS account_id, user_id AS customer_id, ts AS transaction_time,
               CAST(ts AS DATE) AS event_date, CAST(floor(value * 100 + 0.5) AS BIGINT) AS amount,
               CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'Cr' ELSE 'Db' END AS dbcr,
               CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN '213' ELSE CAST(event_id % 5 AS STRING) END AS code,
               CAST(user_id % 25 AS STRING) AS department_id,
               CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END AS currency,
               CASE WHEN event_id % 11 = 0 THEN 'F' ELSE 'C' END AS success
        FROM {events}""",
    "loan_application": """
        SELECT event_id % 4000 AS application_id, ts AS update_time, event_id AS record_id,
               CAST(user_id AS BIGINT) AS customer_id, CAST(user_id % 100 AS STRING) AS portfolio_manager_id,
               CASE event_type WHEN 'view' THEN 'Opened' WHEN 'click' THEN 'Reviewed' WHEN 'signup' THEN 'Approved'
                    WHEN 'purchase' THEN 'Disbursed' ELSE 'Closed' END AS stage,
               CAST(event_id % 5 AS STRING) AS stage_code, CAST(user_id % 25 AS STRING) AS department_id,
               CAST(event_id % 7 AS STRING) AS purpose_code, CAST(event_id % 7 AS STRING) AS product_code,
               CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END AS currency,
               CASE WHEN event_type = 'purchase' THEN event_id * 2 END AS loan_id,
               CAST(floor(value * 100 + 0.5) AS BIGINT) AS requested_amount,
               CAST(floor(value * 90 + 0.5) AS BIGINT) AS reviewed_amount, CAST(floor(value * 80 + 0.5) AS BIGINT) AS approved_amount
        FROM {events}""",
    "payment_event": f"""
        SELECT l_orderkey AS contract_id, l_linenumber AS instalment, l_suppkey % 4 AS transaction_id,
               l_partkey AS line_part, CAST(l_shipdate AS DATE) AS due_date,
               l_shipdate AS event_time, {_CURRENCY_OF_KEY.format(k='l_orderkey')} AS currency,
               {_EXT} AS total_paid, {_EXT} - {_TAX} AS capital_paid, {_TAX} AS interest_paid,
               {_DISC} AS penalty_paid, {_EXT} * {_TAX} AS capital_remaining, {_EXT} * {_DISC} AS interest_remaining
        FROM {{lineitem}}""",
    "instalment_history": f"""
        SELECT l_orderkey AS contract_id, l_linenumber AS instalment, CAST(l_shipdate AS DATE) AS update_date,
               l_partkey AS line_part, l_suppkey AS line_supp,
               CAST(l_shipdate AS DATE) + CAST(l_partkey % 90 AS INT) AS due_date,
               {_CURRENCY_OF_KEY.format(k='l_orderkey')} AS currency,
               CASE WHEN l_quantity > 45 THEN 'Skipped' WHEN l_quantity > 25 THEN 'DUE' END AS status,
               {_EXT} + {_TAX} * 100 AS total_due, {_EXT} AS capital_due, {_TAX} * 100 AS interest_due
        FROM {{lineitem}}""",
    # ---- reference data ---------------------------------------------------------------
    "dictionary": """
        SELECT 'Department_ID' AS field_name, CAST(n_nationkey AS STRING) AS field_code, n_name AS field_description
        FROM {nation}
        UNION ALL SELECT 'ACCOUNT_CODE', CAST(n_nationkey AS STRING), concat('PRODUCT ', n_name) FROM {nation}
        UNION ALL SELECT 'CUSTOMER_AREA_CODE', CAST(r_regionkey AS STRING), r_name FROM {region}
        UNION ALL SELECT 'SUBSECTOR_CODE', CAST(r_regionkey AS STRING), concat('SUB ', r_name) FROM {region}
        UNION ALL SELECT 'SECTOR_CODE', CAST(r_regionkey AS STRING), concat('SECTOR ', r_name) FROM {region}
        UNION ALL SELECT 'LOAN_PRODUCT_CODE', CAST(r_regionkey AS STRING), concat('LOAN ', r_name) FROM {region}
        UNION ALL SELECT 'LOAN_PURPOSE_CODE', CAST(r_regionkey AS STRING), concat('FOR ', r_name) FROM {region}
        UNION ALL SELECT 'LOANAPPLICATION_STAGE_CODE', CAST(r_regionkey AS STRING), concat('STAGE ', r_name) FROM {region}
        UNION ALL SELECT 'TRANSACTION_TYPE_CODE', CAST(r_regionkey AS STRING), concat('TXN ', r_name) FROM {region}
        UNION ALL SELECT 'COMPANY_SUBLEVEL1_ID', CAST(r_regionkey AS STRING), concat('COMPANY ', r_name) FROM {region}
        UNION ALL SELECT 'DEPARTMENT_SUBLEVEL1_ID', CAST(r_regionkey AS STRING), concat('BRANCH ', r_name) FROM {region}""",
    "fx": f"""
        SELECT {_CCY} AS currency, CAST(o_orderdate AS DATE) AS rate_date,
               CAST(1 + sum(o_orderkey) % 9 AS BIGINT) AS rate
        FROM {{orders}} GROUP BY 1, 2""",
    "fx_events": """
        SELECT CASE WHEN event_type = 'view' AND user_id % 2 = 1 THEN 'XXX' WHEN user_id % 3 = 0 THEN 'USD' WHEN user_id % 3 = 1 THEN 'THB'
                    ELSE 'KHR' END AS currency,
               CAST(ts AS DATE) AS rate_date, CAST(1 + sum(event_id) % 9 AS BIGINT) AS rate
        FROM {events} GROUP BY 1, 2""",
    "department_scoring": """
        SELECT CASE WHEN n_regionkey <> 4 THEN CAST(n_nationkey AS STRING) ELSE concat('X', CAST(n_nationkey AS STRING)) END AS department_id,
               n_nationkey * 9 AS department_id_scoring
        FROM {nation}""",
    # ---- reconciliation ---------------------------------------------------------------
    "r_schedule": f"""
        SELECT l_orderkey AS contract_id, DATE '1998-01-01' + CAST(l_partkey % 240 AS INT) AS due_date,
               DATE '1997-12-01' + CAST(l_suppkey % 5 AS INT) AS update_date,
               {_EXT} AS capital_due, {_EXT} * {_TAX} AS interest_due
        FROM {{lineitem}}""",
    "r_loan": f"""
        SELECT o_orderkey AS loan_id, o_custkey AS customer_id, {_CCY} AS currency,
               DATE '1997-12-15' + CAST(o_orderkey % 40 AS INT) AS disbursement_date,
               DATE '1998-06-01' + CAST(o_custkey % 100 AS INT) AS maturity_date,
               DATE '1998-05-01' + CAST(o_custkey % 100 AS INT) AS end_date,
               DATE '1997-12-01' + CAST(o_custkey % 7 AS INT) AS update_date,
               CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'ACTIVE' END AS status,
               o_orderstatus = 'P' AS restructured, CAST(1000000000 AS BIGINT) AS capital_disbursed_amount
        FROM {{orders}}""",
    "r_payment": f"""
        SELECT l_orderkey AS contract_id, DATE '1998-01-01' + CAST(l_partkey % 240 AS INT) AS event_date,
               CASE WHEN l_linenumber <> 3 THEN {_EXT} ELSE 0 END AS amount, '420' AS code
        FROM {{lineitem}}
        UNION ALL
        SELECT l_orderkey, DATE '1998-01-01' + CAST(l_partkey % 240 AS INT), CASE WHEN l_linenumber <> 5 THEN {_EXT} * {_TAX} ELSE 0 END, '434'
        FROM {{lineitem}}
        UNION ALL
        SELECT l_orderkey, DATE '1998-01-01' + CAST(l_partkey % 240 AS INT), CASE WHEN l_linenumber = 7 THEN l_suppkey ELSE 0 END, '752'
        FROM {{lineitem}}""",
    "r_closing": f"""
        SELECT CASE WHEN l_orderkey % 13 <> 0 THEN l_orderkey ELSE -l_orderkey END AS loan_id,
               CAST(1000000000 - sum(CASE WHEN l_linenumber <> 3 THEN {_EXT} ELSE 0 END)
                    + max(CASE WHEN l_orderkey % 5 = 0 THEN 7 ELSE 0 END) AS BIGINT) AS principal_outstanding,
               CAST(sum(CASE WHEN l_linenumber = 3 AND l_orderkey % 2 = 0 THEN {_EXT} ELSE 0 END) AS BIGINT) AS principal_overdue,
               CAST(sum({_EXT} * {_TAX}) AS BIGINT) AS interest_outstanding,
               CAST(sum(CASE WHEN l_linenumber = 5 AND l_orderkey % 2 = 0 THEN {_EXT} * {_TAX} ELSE 0 END) AS BIGINT) AS interest_overdue
        FROM {{lineitem}} GROUP BY l_orderkey""",
    "r_opening": f"""
        SELECT CASE WHEN l_orderkey % 2 = 0 THEN l_orderkey ELSE -l_orderkey END AS loan_id,
               CAST(CASE WHEN l_orderkey % 3 = 0 THEN 999999995 ELSE 0 END AS BIGINT) AS principal_outstanding,
               CAST(sum(CASE WHEN l_linenumber = 2 AND l_orderkey % 4 = 0 THEN {_EXT} ELSE 0 END) AS BIGINT) AS principal_overdue,
               CAST(sum(CASE WHEN l_linenumber = 2 AND l_orderkey % 4 = 0 THEN {_TAX} ELSE 0 END) AS BIGINT) AS interest_overdue
        FROM {{lineitem}} GROUP BY l_orderkey""",
    "typed_event": f"""
        SELECT l_orderkey AS contract_id, l_linenumber AS instalment, CAST(l_shipdate AS DATE) AS due_date,
               CAST(l_shipdate AS DATE) + CAST(l_suppkey % 9 - 4 AS INT) AS event_date,
               CASE WHEN l_returnflag = 'N' AND l_linenumber = 7 THEN 'Penalty'
                    WHEN l_returnflag = 'A' THEN 'Interest' ELSE 'Principal' END AS payment_type,
               {_EXT} - CASE WHEN l_suppkey % 10 = 0 THEN 500 WHEN l_suppkey % 10 = 1 THEN -700 ELSE 0 END AS amount,
               CASE WHEN l_suppkey % 50 = 0 AND l_linestatus = 'O' THEN 'Y' ELSE 'N' END AS early_termination,
               CASE WHEN l_suppkey % 9 = 0 THEN 'LP' ELSE 'OK' END AS event,
               {_CURRENCY_OF_KEY.format(k='l_orderkey')} AS currency
        FROM {{lineitem}}""",
    "due_instalment": f"""
        SELECT CASE WHEN l_orderkey % 17 <> 0 THEN l_orderkey ELSE -l_orderkey END AS contract_id,
               CASE WHEN l_quantity > 2 THEN l_linenumber ELSE l_linenumber + 100 END AS instalment, min(CAST(l_shipdate AS DATE)) AS due_date,
               CAST(sum({_EXT}) AS BIGINT) AS amount_due, CAST(sum({_EXT} * (100 - {_TAX})) AS BIGINT) AS capital_due,
               CAST(sum({_EXT} * {_TAX}) AS BIGINT) AS interest_due
        FROM {{lineitem}} GROUP BY 1, 2""",
    "past_due": """
        SELECT o_orderkey AS loan_id, CAST(o_orderdate AS DATE) AS balance_date,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(500 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS principal_overdue,
               CASE WHEN o_orderkey % 6 = 0 THEN CAST(200 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS interest_overdue,
               CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'ACTIVE' END AS status
        FROM {orders}""",
    "month_start_balance": f"""
        SELECT l_orderkey AS loan_id, CAST(sum(CASE WHEN l_shipdate >= DATE '1998-03-01' THEN {_EXT} ELSE 0 END) AS BIGINT) AS principal_outstanding,
               CAST(max({_TAX}) AS BIGINT) AS interest_outstanding
        FROM {{lineitem}} GROUP BY l_orderkey""",
    "month_end_balance": f"""
        SELECT CASE WHEN l_orderkey % 19 <> 0 THEN l_orderkey ELSE -l_orderkey END AS loan_id, CAST(sum(CASE WHEN l_shipdate >= DATE '1998-04-01' THEN {_EXT} ELSE 0 END) AS BIGINT) AS principal_outstanding,
               CAST(max({_TAX}) AS BIGINT) AS interest_outstanding
        FROM {{lineitem}} GROUP BY l_orderkey""",
    "opening_account": """
        SELECT CASE WHEN c_custkey % 6 <> 1 THEN c_custkey ELSE -c_custkey END AS account_id, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) AS capital_balance FROM {customer}""",
    "closing_account": """
        SELECT CASE WHEN c_custkey % 5 <> 2 THEN c_custkey ELSE -1000000000 - c_custkey END AS account_id, CAST(floor(c_acctbal * 100 + 0.5) AS BIGINT) + coalesce(m, 0)
               + CASE WHEN c_custkey % 8 = 0 THEN 55 ELSE 0 END AS capital_balance
        FROM {customer} LEFT JOIN
             (SELECT user_id, CAST(sum(CASE WHEN (event_type = 'error' AND event_id % 3 = 0) OR event_type IN ('view', 'click', 'signup')
                              THEN CAST(floor(value * 100 + 0.5) AS BIGINT) ELSE -CAST(floor(value * 100 + 0.5) AS BIGINT) END) AS BIGINT) AS m
              FROM {events} GROUP BY user_id) ON c_custkey = user_id""",
    "activity_summary": """
        SELECT CASE WHEN event_id % 11 <> 0 AND (user_id % 4 > 0 OR event_id % 7 > 0) AND user_id % 9 <> 4 THEN user_id ELSE -1 - user_id END AS account_id, CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN '213' ELSE CAST(event_id % 5 AS STRING) END AS code,
               CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'Cr' ELSE 'Db' END AS dbcr,
               CAST(count(*) AS BIGINT) AS tt_number, CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) AS BIGINT) AS tt_volume
        FROM {events} GROUP BY 1, 2, 3""",
    "advance_instalment": """
        SELECT event_id AS contract_id, CAST(user_id AS BIGINT) AS customer_id,
               CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END AS currency,
               CAST(ts AS DATE) + CAST(event_id % 8 AS INT) AS due_date, 1 AS instalment_number,
               (1 + event_id % 4) * 20000 AS amount_due,
               CAST(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 37 END AS DOUBLE) AS delay
        FROM {events}""",
    "month_rate": """
        SELECT currency, CAST(date_trunc('month', d) AS DATE) AS rate_date, CAST(1 + sum(event_id) % 5 AS BIGINT) AS rate FROM
          (SELECT CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END AS currency, event_id,
                  CAST(ts AS DATE) - 31 AS d FROM {events}
           UNION ALL SELECT CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END, event_id, CAST(ts AS DATE) FROM {events}
           UNION ALL SELECT CASE user_id % 3 WHEN 0 THEN 'USD' WHEN 1 THEN 'THB' ELSE 'KHR' END, event_id, CAST(ts AS DATE) + 31 FROM {events})
        GROUP BY 1, 2""",
    "core_text": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS d,
          CASE l_suppkey % 5
            WHEN 0 THEN CAST(year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate) AS STRING)
            WHEN 1 THEN lpad(CAST(((year(l_shipdate) % 100) * 10000 + month(l_shipdate) * 100 + day(l_shipdate)) * CAST(10000 AS BIGINT)
                             + (l_suppkey % 24) * 100 + l_partkey % 60 AS STRING), 10, '0')
            WHEN 2 THEN CAST(year(l_shipdate) * 1000 + dayofyear(l_shipdate) AS STRING)
            WHEN 3 THEN 'no date'
            ELSE '99999999' END AS date_text,
          CASE l_partkey % 4 WHEN 0 THEN '[NULL]' WHEN 1 THEN '' WHEN 2 THEN '12x' ELSE CAST(l_suppkey AS STRING) END AS number_text
        FROM {lineitem}""",
    "written_off": "SELECT CASE WHEN l_quantity = 50 THEN l_orderkey ELSE -l_orderkey END AS loan_id FROM {lineitem}",
    # ---- service generation -----------------------------------------------------------
    "hierarchy": """
        SELECT CAST(s_suppkey AS STRING) AS portfolio_manager_id, s_name AS portfolio_manager_name,
               CAST(n_nationkey AS STRING) AS department_id, n_name AS department_name, r_name AS company_name,
               DATE '2019-01-01' + CAST(s_suppkey % 300 AS INT) AS update_date,
               CASE WHEN s_suppkey % 17 = 16 THEN 2 ELSE 1 END AS version,
               CASE WHEN s_acctbal > 500 THEN 'Active' ELSE 'Left' END AS manager_status
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "s_loan": f"""
        SELECT l_orderkey AS loan_id, CAST(l_suppkey AS STRING) AS portfolio_manager_id,
               CAST(l_shipdate AS DATE) + 8200 AS update_date, CAST(l_shipdate AS DATE) + 8200 AS disbursement_date,
               CAST(l_shipdate AS DATE) + CAST(8200 + l_partkey % 400 AS INT) AS maturity_date,
               {_EXT} AS disbursement_amount, 1 + l_linenumber % 3 AS cycle, l_partkey % 1500 AS customer_id,
               l_linenumber AS version, {_CURRENCY_OF_KEY.format(k='l_orderkey')} AS currency,
               l_partkey AS line_part
        FROM {{lineitem}}""",
    "s_balance": """
        SELECT event_id AS loan_id, CAST(user_id AS BIGINT) AS customer_id, CAST(user_id % 100 AS STRING) AS portfolio_manager_id,
               ts AS r_time, CAST(ts AS DATE) AS balance_date, CAST(floor(value * 100 + 0.5) AS BIGINT) AS principal_outstanding,
               CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS days_overdue,
               CASE WHEN event_type <> 'error' THEN 'Active' ELSE 'Closed' END AS status,
               CASE WHEN event_type IN ('view', 'click') THEN 'Micro' ELSE 'Small' END AS loan_name,
               CAST(ts AS DATE) + CAST(event_id % 60 - 10 AS INT) AS maturity_date,
               CAST(event_id % 50 AS BIGINT) AS principal_due, CAST(event_id % 7 AS BIGINT) AS interest_outstanding,
               CAST(event_id % 3 AS BIGINT) AS interest_due, CAST(event_id % 2 AS BIGINT) AS penalty_due
        FROM {events}""",
    "s_scoring": """
        SELECT CAST(CASE WHEN user_id % 5 <> 0 THEN user_id ELSE -1 - user_id END AS BIGINT) AS customer_id, CAST(ts AS DATE) AS scoring_date,
               CASE WHEN event_type = 'view' THEN 'A' WHEN event_type = 'click' THEN 'B' WHEN event_type = 'signup' THEN 'C'
                    WHEN event_type = 'purchase' THEN 'D' ELSE 'Z' END AS class
        FROM {events}""",
    "s_eligible": """
        SELECT CASE WHEN event_type IN ('view', 'purchase') THEN event_id ELSE -1 - event_id END AS current_loan_id, CAST(ts AS DATE) AS scoring_date, CAST(floor(value * 150 + 0.5) AS BIGINT) AS new_loan_amount
        FROM {events}""",
    "s_objective": f"""
        SELECT CAST(l_suppkey AS STRING) AS portfolio_manager_id, DATE '2023-01-31' AS month_last_date,
               CAST(count(*) AS BIGINT) AS new_disbursements, CAST(sum({_EXT}) AS BIGINT) AS total_disbursement,
               CAST(sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) AS BIGINT) AS new_borrowers
        FROM {{lineitem}} GROUP BY l_suppkey""",
    "s_customer": """
        SELECT c_custkey AS customer_id, CAST(c_custkey % 100 AS STRING) AS portfolio_manager_id, c_name AS customer_name,
               c_mktsegment AS sector, CASE WHEN c_acctbal > 0 THEN 'Active' ELSE 'Closed' END AS status,
               CASE WHEN c_custkey % 9 = 8 THEN 2 ELSE 1 END AS version
        FROM {customer}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame; scans stay plain Parquet scans with pruning and pushdown."""
    names = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    return spark.sql(VIEWS[name].format(**names))


def view_sql(name: str) -> str:
    """The same view for DuckDB, where the tables carry their own names."""
    return VIEWS[name].format(**{t: t for t in TABLES})
