"""Contracts of the raw tables, checked over text forms of the supplied tables."""

from pyspark.sql import functions as F

from ..operators import contracts as K
from ..operators.quality import PATTERNS
from .base import query

CONTRACTS = {
    "c_customer": K.TableContract(
        formats={"customer_id": "customer_id", "portfolio_manager_id": "manager_id", "department_id": "department_id", "area_code": "account_id"},
        filled=("department_id", "portfolio_manager_id"),
        rules={
            "birth year in range": "birth_year < 1915 OR birth_year > 2020",
            "update not before creation": "update_date < creation_date",
        },
        keys={"customer": ("customer_id",), "customer and update": ("customer_id", "update_date")},
        measures=("birth_year", "birth_month"),
    ),
    "c_account": K.TableContract(
        formats={
            "account_id": "account_id", "portfolio_manager_id": "manager_id", "customer_id": "customer_id", "department_id": "department_id",
            "account_code": "account_code", "interest_rate": "rate", "dashed_id": "dashed_id",
        },
        filled=("department_id", "start_date"),
        rules={
            "closed has an end date": "status = 'CLOSED' AND end_date IS NULL",
            "term deposit has a maturity": "account_type = 'TD' AND maturity_date IS NULL",
        },
        references={"customer_id": ("c_customer", "customer_id")},
        keys={"account": ("account_id",), "customer": ("customer_id",)},
        measures=("balance",),
    ),
    "c_loan": K.TableContract(
        formats={
            "loan_id": "contract_id", "customer_id": "customer_id", "department_id": "department_id", "portfolio_manager_id": "manager_id",
            "purpose_code": "purpose_code", "disbursed_text": "short_amount", "repayment_account_id": "account_id",
        },
        filled=("repayment_account_id", "guarantor_ids"),
        rules={
            "start not after disbursement": "disbursement_date < start_date",
            "closed has an end date": "status = 'CLOSED' AND end_date IS NULL",
            "guarantor number with guarantors": "guarantors_number IS NULL AND guarantor_ids <> ''",
            "net not above capital": "net_disbursed_amount > capital_disbursed_amount",
            "has instalments": "instalments_number = 0",
            "cycle below a thousand": "cycle_number = 0 OR cycle_number >= 1000",
        },
        references={"customer_id": ("c_customer", "customer_id"), "repayment_account_id": ("c_account", "account_id")},
        keys={"loan": ("loan_id",), "customer": ("customer_id",), "customer and loan": ("customer_id", "loan_id")},
        measures=("capital_disbursed_amount", "net_disbursed_amount", "instalments_number"),
    ),
    "c_loan_balance": K.TableContract(
        formats={"loan_id": "contract_id", "product_code": "product_code", "customer_id": "customer_id"},
        rules={
            "overdue capital has overdue days": "principal_overdue > 0 AND days_overdue = 0",
            "overdue days have an overdue amount": "principal_overdue = 0 AND interest_overdue = 0 AND penalty_overdue = 0 AND days_overdue > 0",
        },
        references={"loan_id": ("c_loan", "loan_id"), "customer_id": ("c_customer", "customer_id")},
        measures=("days_overdue", "principal_outstanding"),
    ),
    "c_schedule": K.TableContract(
        formats={"contract_id": "contract_id", "total_text": "amount", "capital_text": "amount", "interest_text": "amount"},
        rules={
            "total is capital and interest": "round(capital_due + interest_due, 3) <> round(total_due, 3)",
            "has interest": "interest_due = 0",
        },
        references={"contract_id": ("c_loan", "loan_id")},
        keys={"instalment": ("contract_id", "instalment"), "contract": ("contract_id",)},
        measures=("interest_cents",),
    ),
    "c_event": K.TableContract(
        formats={"contract_id": "contract_id", "total_text": "amount", "transaction_id": "transaction_id"},
        filled=("total_text",),
        rules={
            "total is its parts": "round(capital_paid + interest_paid + penalty_paid, 3) <> round(total_paid, 3)",
            "early payment before due date": "event = 'EP' AND due_date < event_date",
        },
        references={"contract_id": ("c_loan", "loan_id")},
        keys={"transaction": ("transaction_id",)},
        measures=("penalty_cents",),
    ),
    "c_transaction": K.TableContract(
        formats={
            "transaction_id": "transaction_id", "customer_id": "customer_id", "account_id": "account_id", "department_id": "department_id",
            "type_code": "type_code", "counterpart_id": "customer_id",
        },
        filled=("counterpart_id", "operator_id"),
        rules={"amount is not zero": "amount = 0", "value date is the day": "value_date <> event_date", "reversals failed": "reversal_flag = 'Y' AND success_code <> 'F'"},
        references={"account_id": ("c_account", "account_id")},
        keys={"transaction": ("transaction_id",)},
        measures=("amount",),
    ),
    "c_application": K.TableContract(
        formats={"application_id": "application_id", "customer_id": "customer_id", "manager_id": "manager_id", "dashed_id": "dashed_id"},
        filled=("stage",),
        rules={"approved not above requested": "approved_amount > requested_amount"},
        keys={"application": ("application_id",)},
        measures=("requested_amount", "approved_amount"),
    ),
}
VIEWS = " ".join(CONTRACTS)
_PM = "CAST(CASE WHEN {d} = 0 THEN NULL ELSE {n} * 1000000 // {d} END AS BIGINT)"
PROBS = [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1]


def _tables(src):
    return {t: src[t] for t in CONTRACTS}


def _conditions_sql(c):
    yield from ((f"format {n}", f"regexp_matches(CAST({n} AS VARCHAR), '{PATTERNS[p]}')") for n, p in c.formats.items())
    yield from ((f"empty {n}", f"({n} IS NULL OR CAST({n} AS VARCHAR) IN ('', '[NULL]'))") for n in c.filled)
    yield from ((f"broken {n}", e) for n, e in c.rules.items())


def _shared(selects):
    return f"WITH x AS ({' UNION ALL '.join(selects)}) SELECT *, {_PM.format(n='matches', d='obs')} AS share FROM x"


@query(
    "m16_contract_rows",
    _shared(
        f"SELECT '{t}' AS \"table\", '{n}' AS rule, CAST(count(*) FILTER ({e}) AS BIGINT) AS matches, count(*) AS obs FROM {t}"
        for t, c in CONTRACTS.items() for n, e in _conditions_sql(c)
    ),
    VIEWS,
)
def m16_rows(src):
    """Formats, empty columns and cross-column rules of all raw tables."""
    return K.row_report(_tables(src), CONTRACTS)


@query(
    "m17_contract_references",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{n} not in {o}' AS rule, count(*) FILTER (k IS NULL) AS matches, count(*) AS obs
        FROM (SELECT DISTINCT {n} AS v FROM {t} WHERE {n} IS NOT NULL) LEFT JOIN (SELECT DISTINCT {key} AS k FROM {o} WHERE {key} IS NOT NULL) ON v = k"""
        for t, c in CONTRACTS.items() for n, (o, key) in c.references.items()
    ),
    VIEWS,
)
def m17_references(src):
    """Values that the referenced raw table lacks."""
    return K.reference_report(_tables(src), CONTRACTS)


@query(
    "m17_contract_keys",
    _shared(
        f"""SELECT '{t}' AS "table", '{n}' AS rule, count(DISTINCT {cols[0] if len(cols) == 1 else ' || '.join(f'CAST({x} AS VARCHAR)' for x in cols)}) AS matches, count(*) AS obs FROM {t}"""
        for t, c in CONTRACTS.items() for n, cols in c.keys.items()
    ),
    VIEWS,
)
def m17_keys(src):
    """Uniqueness of the keys of all raw tables."""
    return K.key_report(_tables(src), CONTRACTS)


_PROFILED = ("c_customer", "c_account", "c_loan", "c_loan_balance", "c_schedule", "c_event", "c_transaction", "c_application")


def _profile_sql(t, columns):
    return " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", count(*) AS obs, count(*) FILTER ({c} IS NULL) AS missing,
        count(*) FILTER (CAST({c} AS VARCHAR) IN ('', '[NULL]')) AS blank, count(*) FILTER (TRY_CAST(CAST({c} AS VARCHAR) AS DOUBLE) = 0) AS zero,
        count(DISTINCT {c}) AS "distinct", min(CAST({c} AS VARCHAR)) AS smallest, max(CAST({c} AS VARCHAR)) AS largest FROM {t}"""
        for c in columns
    )


#: Columns of the text forms, for the SQL counterpart of the profile.
COLUMNS = {
    "c_customer": "customer_id portfolio_manager_id department_id area_code birth_year birth_month creation_date update_date",
    "c_account": "account_id customer_id portfolio_manager_id department_id account_code interest_rate dashed_id account_type status start_date end_date maturity_date balance",
    "c_loan": "loan_id customer_id department_id portfolio_manager_id purpose_code disbursed_text repayment_account_id guarantor_ids guarantors_number start_date disbursement_date end_date status net_disbursed_amount capital_disbursed_amount instalments_number cycle_number",
    "c_loan_balance": "loan_id product_code customer_id principal_overdue interest_overdue penalty_overdue days_overdue principal_outstanding",
    "c_schedule": "contract_id instalment total_text capital_text interest_text interest_cents",
    "c_event": "contract_id transaction_id total_text penalty_cents event due_date event_date",
    "c_transaction": "transaction_id customer_id account_id department_id type_code counterpart_id operator_id amount value_date event_date reversal_flag success_code",
    "c_application": "application_id customer_id manager_id dashed_id stage approved_amount requested_amount",
}


@query("m18_contract_profile", " UNION ALL ".join(_profile_sql(t, COLUMNS[t].split()) for t in _PROFILED), VIEWS)
def m18_columns(src):
    """Every column of every raw table; prices in whole units are profiled by their texts and cents."""
    return K.column_report({t: src[t].select(*COLUMNS[t].split()) for t in CONTRACTS}, CONTRACTS)


@query(
    "m18_contract_measures",
    " UNION ALL ".join(
        f"""SELECT '{t}' AS "table", '{c}' AS "column", {', '.join(f'CAST(round(quantile_cont(CAST({c} AS DOUBLE), {p}) * 1000) AS BIGINT) AS q{round(p * 100)}' for p in PROBS)} FROM {t}"""
        for t, k in CONTRACTS.items() for c in k.measures
    ),
    VIEWS,
)
def m18_measures(src):
    """Exact quantiles of every measure of every raw table, in thousandths."""
    out = K.measure_report(_tables(src), CONTRACTS, PROBS)
    return out.select("table", "column", *[F.round(F.col(c) * 1000).cast("long").alias(c) for c in out.columns[2:]])
