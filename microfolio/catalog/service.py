"""Service marts. Ratios are compared as whole millionths."""

from pyspark.sql import functions as F

from ..operators import versioning as V
from ..plans import service as M
from .base import query

RUN = "2024-01-15"
_D = f"DATE '{RUN}'"
_MONTH = "DATE '2024-01-01'"
H = ["portfolio_manager_name", "department_id", "department_name", "company_name"]
_H = ", ".join("h." + c for c in H)
_PM = "h AS (SELECT * FROM hierarchy WHERE version = 1)"
_FIRST = """first_loan AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY loan_id ORDER BY update_date NULLS FIRST) AS n
   FROM s_loan {where}) WHERE n = 1)"""
_APPS = """app AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY application_id ORDER BY update_time DESC) AS n FROM loan_application)
   WHERE n = 1 AND stage NOT IN ('Disbursed', 'Closed'))"""
_APP_SUM = "SELECT portfolio_manager_id, count(*) AS loan_applications, CAST(sum(reviewed_amount) AS BIGINT) AS amount_reviewed FROM app GROUP BY 1"


def millionths(df, cols):
    return df.withColumns({c: F.round(F.col(c) * 1000000).cast("long") for c in cols})


def applications(src):
    return V.version_counter(src["loan_application"], ["application_id"], "update_time")


def _sums(names):
    return ", ".join(f"CAST(sum({e}) AS BIGINT) AS {n}" for n, e in names.items())


P1 = f"""{_PM}, {_FIRST.format(where='')},
 st AS (SELECT portfolio_manager_id, min(update_date) AS start_date FROM hierarchy GROUP BY 1),
 di AS (SELECT portfolio_manager_id, count(*) AS disbursed_loans, CAST(sum(disbursement_amount) AS BIGINT) AS disbursed_amount FROM first_loan GROUP BY 1),
 dy AS (SELECT portfolio_manager_id, balance_date, sum(CASE WHEN days_overdue > 0 THEN principal_outstanding ELSE 0 END) / sum(principal_outstanding) AS p0,
               sum(CASE WHEN days_overdue > 30 THEN principal_outstanding ELSE 0 END) / sum(principal_outstanding) AS p30
        FROM s_balance WHERE status = 'Active' GROUP BY 1, 2 HAVING sum(principal_outstanding) > 0),
 sh AS (SELECT portfolio_manager_id, CAST(round(avg(p0) * 1000000) AS BIGINT) AS average_par0_percentage,
               CAST(round(avg(p30) * 1000000) AS BIGINT) AS average_par30_percentage FROM dy GROUP BY 1),
 p1 AS (SELECT h.portfolio_manager_id, {_H}, {_D} AS update_date, start_date, disbursed_loans, disbursed_amount,
        average_par0_percentage, average_par30_percentage
 FROM h LEFT JOIN st USING (portfolio_manager_id) LEFT JOIN di USING (portfolio_manager_id) LEFT JOIN sh USING (portfolio_manager_id))"""
P1_VIEWS = "hierarchy s_loan s_balance"


def history_box(src):
    out = M.history_box(src["hierarchy"], src["s_loan"], src["s_balance"], RUN)
    return millionths(out, ["average_par0_percentage", "average_par30_percentage"])


@query("p1_history_box", f"WITH {P1} SELECT * FROM p1", P1_VIEWS)
def p1(src):
    return history_box(src)


_CLASSES = {c: f"scoring_class = '{c.upper()}'" for c in "abcd"} | {
    "other": "(scoring_class NOT IN ('A','B','C','D') OR scoring_class IS NULL)"
}
P2 = f"""{_PM}, {_FIRST.format(where=f'WHERE disbursement_date >= {_MONTH}')}, {_APPS},
 di AS (SELECT portfolio_manager_id, count(*) AS disbursed_loans, CAST(sum(disbursement_amount) AS BIGINT) AS disbursed_amount FROM first_loan GROUP BY 1),
 ap AS ({_APP_SUM}),
 sc AS (SELECT customer_id, scoring_date, max(class) AS scoring_class FROM s_scoring GROUP BY 1, 2),
 cu AS (SELECT b.portfolio_manager_id, b.customer_id, scoring_class, CAST(r_time AS DATE) AS d, count(*) AS loans, sum(principal_outstanding) AS o,
               sum(CASE WHEN days_overdue > 0 THEN principal_outstanding ELSE 0 END) AS p0,
               sum(CASE WHEN days_overdue > 30 THEN principal_outstanding ELSE 0 END) AS p30
        FROM s_balance b LEFT JOIN sc ON b.customer_id = sc.customer_id AND CAST(r_time AS DATE) = scoring_date
        WHERE status = 'Active' GROUP BY 1, 2, 3, 4),
 po AS (SELECT portfolio_manager_id, d, {_sums({'outstanding_loans': 'loans', 'principal_outstanding': 'o', 'par0_outstanding': 'p0', 'par30_outstanding': 'p30',
        **{f'{c}_outstanding': f'CASE WHEN {m} THEN o ELSE 0 END' for c, m in _CLASSES.items()},
        **{f'{c}_customers': f'CASE WHEN {m} THEN 1 ELSE 0 END' for c, m in _CLASSES.items()}})} FROM cu GROUP BY 1, 2),
 p2 AS (SELECT h.portfolio_manager_id, {_H}, {_D} AS update_date, disbursed_loans, disbursed_amount, loan_applications, amount_reviewed,
        po.* EXCLUDE (portfolio_manager_id, d)
 FROM h LEFT JOIN di ON h.portfolio_manager_id = di.portfolio_manager_id LEFT JOIN ap ON h.portfolio_manager_id = ap.portfolio_manager_id
 LEFT JOIN po ON h.portfolio_manager_id = po.portfolio_manager_id AND po.d = {_D})"""
P2_VIEWS = "hierarchy s_loan loan_application s_balance s_scoring"


def summary_stats(src):
    return M.summary_stats(
        src["hierarchy"], src["s_loan"], applications(src), src["s_balance"], src["s_scoring"], RUN
    )


@query("p2_summary_stats", f"WITH {P2} SELECT * FROM p2", P2_VIEWS)
def p2(src):
    return summary_stats(src)


def _perc(n, d):
    return f"CASE WHEN {d} > 0 THEN CAST(round(CAST({n} AS DOUBLE) / {d} * 1000000) AS BIGINT) END"


P3 = f"""{_PM}, {_FIRST.format(where=f'WHERE disbursement_date >= {_MONTH}')}, {_APPS},
 re AS (SELECT portfolio_manager_id, count(*) AS rzd_disbursed_loans, CAST(sum(disbursement_amount) AS BIGINT) AS rzd_disbursed_amount,
        CAST(sum(CASE WHEN cycle = 1 THEN 1 ELSE 0 END) AS BIGINT) AS rzd_cycle1_loans FROM first_loan GROUP BY 1),
 ap AS ({_APP_SUM}),
 ob AS (SELECT portfolio_manager_id, CAST(month_last_date + INTERVAL 1 YEAR AS DATE) AS obj_date, new_disbursements AS obj_disbursed_loans,
        total_disbursement AS obj_disbursed_amount, new_borrowers AS obj_cycle1_disbursed_loans FROM s_objective),
 p3 AS (SELECT h.portfolio_manager_id, {_H}, {_D} AS update_date, rzd_disbursed_loans, rzd_disbursed_amount, rzd_cycle1_loans,
        loan_applications, amount_reviewed, obj_disbursed_loans, obj_disbursed_amount, obj_cycle1_disbursed_loans,
        CAST(NULL AS BIGINT) AS cycle1_loan_applications,
        coalesce(rzd_disbursed_loans, 0) + coalesce(loan_applications, 0) AS pot_disbursed_loans,
        coalesce(rzd_disbursed_amount, 0) + coalesce(amount_reviewed, 0) AS pot_disbursed_amount,
        coalesce(rzd_cycle1_loans, 0) AS pot_cycle1_loans,
        {_perc('rzd_disbursed_loans', 'obj_disbursed_loans')} AS rzd_disbursed_loans_perc,
        {_perc('rzd_disbursed_amount', 'obj_disbursed_amount')} AS rzd_disbursed_amount_perc,
        {_perc('rzd_cycle1_loans', 'obj_cycle1_disbursed_loans')} AS rzd_cycle1_loans_perc
 FROM h LEFT JOIN re ON h.portfolio_manager_id = re.portfolio_manager_id LEFT JOIN ap ON h.portfolio_manager_id = ap.portfolio_manager_id
 LEFT JOIN ob ON h.portfolio_manager_id = ob.portfolio_manager_id AND year(obj_date) = year({_D}) AND month(obj_date) = month({_D}))"""
P3_VIEWS = "hierarchy s_loan loan_application s_objective"


def disbursements_summary(src):
    out = M.disbursements_summary(src["hierarchy"], src["s_loan"], applications(src), src["s_objective"], RUN)
    return millionths(out, ["rzd_disbursed_loans_perc", "rzd_disbursed_amount_perc", "rzd_cycle1_loans_perc"])


@query("p3_disbursements_summary", f"WITH {P3} SELECT * FROM p3", P3_VIEWS)
def p3(src):
    return disbursements_summary(src)


P4 = f"""{_PM}, p4 AS (SELECT l.portfolio_manager_id, customer_id, disbursement_date, loan_id, cycle, maturity_date,
        disbursement_amount AS total_amount, currency, {_D} AS update_date, {_H}
 FROM s_loan l LEFT JOIN h ON l.portfolio_manager_id = h.portfolio_manager_id
 WHERE disbursement_date >= {_MONTH} AND l.version = 1)"""
P4_VIEWS = "hierarchy s_loan"


def disbursements_details(src):
    return M.disbursements_details(src["hierarchy"], src["s_loan"], RUN)


@query("p4_disbursements_details", f"WITH {P4} SELECT * FROM p4", P4_VIEWS)
def p4(src):
    return disbursements_details(src)


@query(
    "p5_pipeline_details",
    f"""WITH {_PM}, {_APPS} SELECT a.portfolio_manager_id, customer_id, application_id, stage, update_time, requested_amount,
        reviewed_amount, approved_amount, currency, {_D} AS date, {_H}
        FROM app a LEFT JOIN h ON a.portfolio_manager_id = h.portfolio_manager_id""",
    "hierarchy loan_application",
)
def p5(src):
    return M.pipeline_details(src["hierarchy"], applications(src), RUN)


_PAR = (0, 7, 30, 60, 120)
P6 = f"""{_PM}, ar AS (SELECT portfolio_manager_id, balance_date AS date, {_sums({
    'arrear_loans': 'CASE WHEN days_overdue > 0 THEN 1 ELSE 0 END',
    'arrear_amount': 'CASE WHEN days_overdue > 0 THEN principal_outstanding ELSE 0 END',
    **{f'par{d}_number': f'CASE WHEN days_overdue > {d} THEN 1 ELSE 0 END' for d in _PAR},
    **{f'par{d}_amount': f'CASE WHEN days_overdue > {d} THEN principal_outstanding ELSE 0 END' for d in _PAR},
    'principal_outstanding': 'principal_outstanding'})} FROM s_balance WHERE status = 'Active' GROUP BY 1, 2),
 p6 AS (SELECT h.portfolio_manager_id, {_H}, {_D} AS update_date, ar.* EXCLUDE (portfolio_manager_id),
        {', '.join(f"{_perc(f'par{d}_amount', 'principal_outstanding')} AS par{d}_perc" for d in _PAR)}
 FROM h LEFT JOIN ar ON h.portfolio_manager_id = ar.portfolio_manager_id)"""
P6_VIEWS = "hierarchy s_balance"


def arrears_summary(src):
    return millionths(M.arrears_summary(src["hierarchy"], src["s_balance"], RUN), [f"par{d}_perc" for d in _PAR])


@query("p6_arrears_summary", f"WITH {P6} SELECT * FROM p6", P6_VIEWS)
def p6(src):
    return arrears_summary(src)


P7 = f"""{_PM}, p7 AS (SELECT b.portfolio_manager_id, balance_date AS date, loan_id, days_overdue, principal_due, penalty_due,
        principal_outstanding, {_H} FROM s_balance b LEFT JOIN h ON b.portfolio_manager_id = h.portfolio_manager_id
 WHERE status = 'Active' AND days_overdue > 0)"""


def arrears_details(src):
    return M.arrears_details(src["hierarchy"], src["s_balance"])


@query("p7_arrears_details", f"WITH {P7} SELECT * FROM p7", P6_VIEWS)
def p7(src):
    return arrears_details(src)


P8 = f"""{_PM}, p8 AS (SELECT b.portfolio_manager_id, {_H}, balance_date AS date, loan_name, count(*) AS outstanding_loans,
        CAST(sum(principal_outstanding) AS BIGINT) AS amount
 FROM s_balance b LEFT JOIN h ON b.portfolio_manager_id = h.portfolio_manager_id WHERE status = 'Active' GROUP BY ALL)"""


def outstanding_summary(src):
    return M.outstanding_summary(src["hierarchy"], src["s_balance"])


@query("p8_outstanding_summary", f"WITH {P8} SELECT * FROM p8", P6_VIEWS)
def p8(src):
    return outstanding_summary(src)


OUTSTANDING = f"""{_PM}, od AS (SELECT b.portfolio_manager_id, balance_date AS date, loan_id, loan_name, principal_outstanding, {_H}
 FROM s_balance b LEFT JOIN h ON b.portfolio_manager_id = h.portfolio_manager_id WHERE status = 'Active')"""


def outstanding_details(src):
    return M.outstanding_details(src["hierarchy"], src["s_balance"])


_MATURING = """mt AS (SELECT b.portfolio_manager_id, b.loan_id, b.principal_outstanding, b.balance_date AS date, CAST(b.r_time AS DATE) AS update_date,
        l.maturity_date, l.customer_id, e.scoring_date, CASE WHEN e.current_loan_id IS NOT NULL THEN 1 END AS hit, e.new_loan_amount,
        CAST(l.maturity_date - CAST(b.r_time AS DATE) AS INT) AS days_to_maturity
 FROM s_balance b LEFT JOIN s_loan l ON b.loan_id = l.loan_id AND l.version = 1
 LEFT JOIN s_eligible e ON b.loan_id = e.current_loan_id AND CAST(b.r_time AS DATE) = e.scoring_date
 WHERE b.status = 'Active' AND b.maturity_date > b.balance_date)"""
P9 = f"""{_PM}, {_MATURING}, ms AS (SELECT portfolio_manager_id, update_date, days_to_maturity, count(*) AS maturing_loans,
        CAST(sum(principal_outstanding) AS BIGINT) AS maturing_amount, CAST(sum(hit) AS BIGINT) AS ra_loans,
        CAST(sum(CASE WHEN hit = 1 THEN principal_outstanding ELSE 0 END) AS BIGINT) AS ra_amount FROM mt GROUP BY 1, 2, 3),
 p9 AS (SELECT ms.*, {_H} FROM ms LEFT JOIN h ON ms.portfolio_manager_id = h.portfolio_manager_id)"""
P9_VIEWS = "hierarchy s_balance s_loan s_eligible"


def maturing_summary(src):
    return M.maturing_summary(src["hierarchy"], src["s_balance"], src["s_loan"], src["s_eligible"])


@query("p9_maturing_summary", f"WITH {P9} SELECT * FROM p9", P9_VIEWS)
def p9(src):
    return maturing_summary(src)


P10 = f"""{_PM}, {_MATURING}, p10 AS (SELECT mt.* EXCLUDE (hit), CASE WHEN hit = 1 THEN 'Y' END AS ra_eligible, {_H}
 FROM mt LEFT JOIN h ON mt.portfolio_manager_id = h.portfolio_manager_id)"""


def maturing_details(src):
    return M.maturing_details(src["hierarchy"], src["s_balance"], src["s_loan"], src["s_eligible"])


@query("p10_maturing_details", f"WITH {P10} SELECT * FROM p10", P9_VIEWS)
def p10(src):
    return maturing_details(src)


@query(
    "p11_disbursements_daily",
    f"""WITH {_PM}, {_FIRST.format(where='')},
 dd AS (SELECT portfolio_manager_id, disbursement_date, count(*) AS disbursed_loans, CAST(sum(disbursement_amount) AS BIGINT) AS disbursed_amount
        FROM first_loan GROUP BY 1, 2)
 SELECT dd.*, {_H} FROM dd LEFT JOIN h ON dd.portfolio_manager_id = h.portfolio_manager_id""",
    "hierarchy s_loan",
)
def p11(src):
    return M.disbursements_daily(src["hierarchy"], src["s_loan"])


_DEBT = {
    "principal_outstanding_amount": "principal_outstanding",
    "principal_due_amount": "principal_due",
    "interests_outstanding_amount": "interest_outstanding",
    "interests_due_amount": "interest_due",
    "penalty_due_amount": "penalty_due",
}
P12 = f"""{_PM},
 ab AS (SELECT customer_id, balance_date, CAST(sum(capital_balance) AS BIGINT) AS capital_balance, CAST(sum(available_balance) AS BIGINT) AS available_balance
        FROM account_balance GROUP BY 1, 2),
 am AS (SELECT ab.* FROM ab JOIN (SELECT customer_id, max(balance_date) AS d FROM account_balance GROUP BY 1) m
        ON ab.customer_id = m.customer_id AND ab.balance_date = m.d),
 lb AS (SELECT customer_id, balance_date, count(*) AS loans_outstanding_number, {_sums(_DEBT)} FROM s_balance WHERE status = 'Active' GROUP BY 1, 2),
 lm AS (SELECT lb.* FROM lb JOIN (SELECT customer_id, max(balance_date) AS d FROM s_balance GROUP BY 1) m
        ON lb.customer_id = m.customer_id AND lb.balance_date = m.d),
 p12 AS (SELECT c.*, {_H}, am.balance_date AS account_update_date, am.capital_balance, am.available_balance,
        lm.balance_date AS loan_update_date, loans_outstanding_number, {', '.join(_DEBT)},
        CASE WHEN lm.customer_id IS NOT NULL THEN concat_ws(',', CASE WHEN loans_outstanding_number > 0 THEN 'Borrower' END,
          CASE WHEN principal_due_amount + interests_outstanding_amount > 0 THEN 'Late' ELSE 'On Time' END) END AS tag,
        principal_outstanding_amount + interests_outstanding_amount AS total_outstanding_amount
 FROM s_customer c LEFT JOIN h ON c.portfolio_manager_id = h.portfolio_manager_id
 LEFT JOIN am ON c.customer_id = am.customer_id LEFT JOIN lm ON c.customer_id = lm.customer_id WHERE c.version = 1)"""


@query("p12_customer_card", f"WITH {P12} SELECT * FROM p12", "hierarchy s_customer account_balance s_balance")
def p12(src):
    out = M.customer_card(src["hierarchy"], src["s_customer"], src["account_balance"], src["s_balance"])
    return out.withColumn("tag", F.array_join("tag", ","))
