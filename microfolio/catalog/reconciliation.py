"""Reconciliation of paid, due and overdue amounts."""

from pyspark.sql import functions as F

from ..functions.scalars import classify
from ..operators import allocation as A
from ..operators import reconcile as R
from ..session import parts_for
from .base import query

AS_OF, SINCE = "1998-06-30", "1998-01-05"
_A, _S = f"DATE '{AS_OF}'", f"DATE '{SINCE}'"
_LIMIT = "CASE {c} WHEN 'USD' THEN 10 WHEN 'THB' THEN 100 WHEN 'KHR' THEN 10000 END"


def _class(diff, ccy="currency", codes=(-1, 0, 1)):
    lim = _LIMIT.format(c=ccy)
    return f"CAST(CASE WHEN {diff} > {lim} THEN {codes[2]} WHEN {diff} < -({lim}) THEN {codes[0]} ELSE {codes[1]} END AS INT)"


VIEWS = "r_schedule r_loan r_payment r_closing r_opening"
_PAID = """paid AS (SELECT contract_id, CAST(sum(CASE WHEN code IN ('420','423','750') THEN amount ELSE 0 END) AS BIGINT) AS capital_paid,
   CAST(sum(CASE WHEN code IN ('434','751') THEN amount ELSE 0 END) AS BIGINT) AS interest_paid FROM r_payment GROUP BY 1)"""


def _cut(closed):
    running = f"((maturity_date > {_A} AND due_date <= {_A}) OR (maturity_date <= {_A} AND due_date <= maturity_date))"
    if closed is None:
        return running
    return f"((status = 'CLOSED' AND due_date <= {closed}) OR (status <> 'CLOSED' AND {running}))"


def _due(closed):
    return f"""due AS (SELECT contract_id, CAST(sum(capital_due) AS BIGINT) AS capital_due, CAST(sum(interest_due) AS BIGINT) AS interest_due FROM
   (SELECT s.*, l.disbursement_date, l.maturity_date, l.end_date, l.status,
           max(s.update_date) OVER (PARTITION BY contract_id, date_trunc('month', due_date)) AS newest
    FROM (SELECT * FROM r_schedule WHERE due_date >= {_S}) s JOIN r_loan l ON contract_id = loan_id WHERE l.disbursement_date >= {_S})
   WHERE update_date = newest AND due_date > disbursement_date AND {_cut(closed)} GROUP BY 1)"""


def _totals(closed):
    return f"""{_PAID}, {_due(closed)},
 tot AS (SELECT l.*, coalesce(capital_paid, 0) AS capital_paid, coalesce(interest_paid, 0) AS interest_paid,
   coalesce(capital_due, 0) AS capital_due, coalesce(interest_due, 0) AS interest_due,
   coalesce(principal_overdue, 0) AS principal_overdue, coalesce(principal_outstanding, 0) AS principal_outstanding,
   coalesce(interest_overdue, 0) AS interest_overdue, coalesce(interest_outstanding, 0) AS interest_outstanding
  FROM r_loan l LEFT JOIN paid ON l.loan_id = paid.contract_id LEFT JOIN due ON l.loan_id = due.contract_id
  LEFT JOIN r_closing c ON l.loan_id = c.loan_id WHERE l.disbursement_date >= {_S})"""


_OVER = {"capital": "principal_overdue", "interest": "interest_overdue"}


def _step1(c, closed):
    return f"{_totals(closed)}, kos AS (SELECT *, {_class(f'({c}_paid + {_OVER[c]} - {c}_due)')} AS ok FROM tot)"


def _first(src, c, closed):
    return R.first_step(
        src["r_loan"], src["r_schedule"], src["r_payment"], src["r_closing"], c, AS_OF, SINCE, closed, scale=100
    )


_VERSION = f"""ver AS (SELECT *, count(*) OVER (PARTITION BY contract_id, m ORDER BY update_date DESC) AS version FROM
   (SELECT DISTINCT contract_id, date_trunc('month', due_date) AS m, update_date FROM r_schedule WHERE due_date >= {_S}))"""


def _step2(c, trace):
    cond = "AND capital_disbursed_amount - capital_paid = principal_outstanding" if trace else ""
    return f"""{_VERSION}, fix AS (SELECT loan_id, 0 AS ok2 FROM (
   SELECT k.loan_id, k.{c}_paid AS p, sum(s.{c}_due) AS d FROM kos k JOIN r_schedule s ON k.loan_id = s.contract_id AND s.due_date >= {_S}
   JOIN ver v ON v.contract_id = s.contract_id AND v.m = date_trunc('month', s.due_date) AND v.update_date = s.update_date
   WHERE k.ok = 1 {cond} AND s.due_date <= k.maturity_date AND (version = 1 OR (version = 2 AND k.{c}_paid - k.{c}_due = s.{c}_due))
   GROUP BY 1, 2) WHERE p = d),
 kos2 AS (SELECT kos.*, fix.ok2 FROM kos LEFT JOIN fix USING (loan_id) WHERE ok <> 0)"""


@query(
    "l1_classify",
    f"SELECT loan_id, currency, amount_gap, {_class('amount_gap')} AS ok, {_class('amount_gap', codes=(0, 1, 2))} AS ok_r FROM "
    "(SELECT loan_id, currency, principal_overdue % 30001 - 15000 AS amount_gap FROM r_loan JOIN r_closing USING (loan_id))",
    VIEWS,
)
def l1(src):
    df = src["r_loan"].select("loan_id", "currency").join(src["r_closing"].select("loan_id", "principal_overdue"), "loan_id")
    df = df.select("loan_id", "currency", (F.col("principal_overdue") % 30001 - 15000).alias("amount_gap"))
    return df.withColumns(
        {
            "ok": classify("amount_gap", "currency", scale=100),
            "ok_r": classify("amount_gap", "currency", scale=100, codes=R.R_CODES),
        }
    )


@query("l2_due_in_force", f"WITH {_due('maturity_date')} SELECT * FROM due", VIEWS)
def l2(src):
    return R.due_in_force(src["r_schedule"], src["r_loan"], AS_OF, SINCE)


@query("l3_reconcile_1", f"WITH {_step1('capital', 'maturity_date')} SELECT * FROM kos WHERE ok <> 0", VIEWS)
def l3(src):
    return _first(src, "capital", "maturity_date").where(F.col("ok") != 0)


def _second(src):
    kos = _first(src, "capital", "maturity_date").where(F.col("ok") != 0)
    return kos, R.second_step(kos, src["r_schedule"], "capital", SINCE, traceable_only=True)


_TWO = f"{_step1('capital', 'maturity_date')}, {_step2('capital', True)}"


@query("l4_reconcile_2", f"WITH {_TWO} SELECT * FROM kos2", VIEWS)
def l4(src):
    return _second(src)[1]


@query(
    "l5_reconcile_3",
    f"""WITH {_TWO} SELECT loan_id, capital_paid, CAST(d AS BIGINT) AS capital_due, 0 AS ok3 FROM (
     SELECT k.loan_id, k.capital_paid, sum(s.capital_due) AS d FROM kos2 k JOIN r_schedule s ON k.loan_id = s.contract_id AND s.due_date >= {_S}
     WHERE ok = -1 AND ok2 IS NULL AND capital_disbursed_amount - k.capital_paid = principal_outstanding AND restructured
       AND s.capital_due > 0 AND s.due_date <= {_A}
       AND ((s.update_date < k.update_date AND s.due_date < k.update_date) OR s.update_date > k.update_date)
     GROUP BY 1, 2) WHERE capital_paid = d""",
    VIEWS,
)
def l5(src):
    return R.third_step(_second(src)[1], src["r_loan"], src["r_schedule"], AS_OF, SINCE)


@query(
    "l6_outcome_matrix",
    f"WITH {_TWO} SELECT k.ok, x.ok2, count(*) AS obs FROM (SELECT * FROM kos WHERE ok <> 0) k LEFT JOIN kos2 x USING (loan_id) GROUP BY 1, 2",
    VIEWS,
)
def l6(src):
    return R.outcome_matrix(*_second(src))


@query("l7_interest_1", f"WITH {_step1('interest', 'end_date')} SELECT * FROM kos WHERE ok <> 0", VIEWS)
def l7(src):
    return _first(src, "interest", "end_date").where(F.col("ok") != 0)


@query(
    "l7_interest_2", f"WITH {_step1('interest', 'end_date')}, {_step2('interest', False)} SELECT * FROM kos2", VIEWS
)
def l7_second(src):
    kos = _first(src, "interest", "end_date").where(F.col("ok") != 0)
    return R.second_step(kos, src["r_schedule"], "interest", SINCE, traceable_only=False)


def _pipeline_sql(c, later: bool) -> str:
    """The three steps one after another, each over its own selection of loans."""
    closed = "maturity_date" if c == "capital" else "end_date"
    over = _OVER[c]
    r = (0, 1, 2)
    net = f"{c}_paid + over_close - over_open"
    if later:
        target = f"SELECT l.* FROM r_loan l WHERE loan_id IN (SELECT contract_id FROM r_schedule WHERE due_date >= {_S} AND due_date <= {_A})"
        opening = f"coalesce(o.principal_outstanding, 0) AS out_open, coalesce(o.{over}, 0) AS over_open"
        lim = _LIMIT.format(c="currency")
        consistent = f"CASE WHEN abs(CASE WHEN out_open > 0 THEN out_open ELSE capital_disbursed_amount END - out_close - capital_paid) > {lim} THEN 0 ELSE 1 END"
        match = f"abs(x.{c}_due - (t.{c}_paid - t.due1)) < {_LIMIT.format(c='t.currency')}"
        trace, after, last = "", "AND s.due_date > l.disbursement_date", net
    else:
        target = f"SELECT l.* FROM r_loan l WHERE disbursement_date >= {_S}"
        opening = "0 AS out_open, 0 AS over_open"
        consistent = "1"
        match = f"x.{c}_due = t.{c}_paid - t.due1"
        trace = "AND capital_disbursed_amount - out_close - capital_paid = 0" if c == "capital" else ""
        after = ""
        last = net if c == "capital" else f"{c}_paid + pover_close - over_open"
    return f"""{_PAID}, {_VERSION},
 tgt AS ({target}),
 rw AS (SELECT s.contract_id, s.due_date, s.update_date AS sd, s.{c}_due, v.version, l.currency, l.update_date AS ld
   FROM r_schedule s JOIN ver v ON v.contract_id = s.contract_id AND v.m = date_trunc('month', s.due_date) AND v.update_date = s.update_date
   JOIN tgt l ON l.loan_id = s.contract_id WHERE s.due_date >= {_S} AND version <= 2 {after} AND {_cut(closed)}),
 d1 AS (SELECT contract_id, sum({c}_due) AS due1 FROM rw WHERE version = 1 GROUP BY 1),
 b AS (SELECT l.*, coalesce(capital_paid, 0) AS capital_paid, coalesce(interest_paid, 0) AS interest_paid, coalesce(due1, 0) AS due1,
   coalesce(k.principal_outstanding, 0) AS out_close, coalesce(k.{over}, 0) AS over_close, coalesce(k.principal_overdue, 0) AS pover_close, {opening}
   FROM tgt l LEFT JOIN paid ON paid.contract_id = l.loan_id LEFT JOIN d1 ON d1.contract_id = l.loan_id
   LEFT JOIN r_closing k ON k.loan_id = l.loan_id LEFT JOIN r_opening o ON o.loan_id = l.loan_id),
 t AS (SELECT *, {consistent} AS consistent, {_class(f'({net} - due1)', codes=r)} AS ok1 FROM b),
 r2 AS (SELECT x.* FROM t JOIN rw x ON t.loan_id = x.contract_id WHERE ok1 = 2 AND consistent = 1 {trace} AND (version = 1 OR {match})),
 s2 AS (SELECT contract_id, sum({c}_due) AS due2 FROM r2 GROUP BY 1),
 r3 AS (SELECT x.* FROM t JOIN rw x ON t.loan_id = x.contract_id WHERE ok1 = 0 AND consistent = 1 AND restructured AND version = 1
        AND ((sd < ld AND x.due_date < ld) OR sd >= ld)),
 s3 AS (SELECT contract_id, sum({c}_due) AS due3 FROM r3 GROUP BY 1),
 j AS (SELECT t.*, CASE WHEN due2 IS NULL THEN 0 ELSE {_class(f'({net} - due2)', codes=r)} END AS ok2,
        CASE WHEN due3 IS NULL THEN 0 ELSE {_class(f'({last} - due3)', codes=r)} END AS ok3
   FROM t LEFT JOIN s2 ON s2.contract_id = t.loan_id LEFT JOIN s3 ON s3.contract_id = t.loan_id),
 res AS (SELECT *, CASE WHEN ok1 = 1 OR ok2 = 1 OR ok3 = 1 THEN 1 ELSE ok1 END AS ok FROM j)"""


def _rules(c, later=True):
    base = dict(as_of=AS_OF, since=SINCE, component=c, scale=100)
    base["closed_until"] = "maturity_date" if c == "capital" else "end_date"
    if not later:
        base |= R.EARLIER
        base |= {"traceable_only": c == "capital", "principal_in_last_step": c == "interest"}
    return R.Rules(**base)


def _pipelines(src, *rules):
    return R.pipelines(src["r_loan"], src["r_schedule"], src["r_payment"], src["r_closing"], src["r_opening"], list(rules))


def _pipeline(src, c, later=True):
    return _pipelines(src, _rules(c, later))[0]


def _outcome(rec):
    return rec.loans.select("loan_id", "ok1", "ok2", "ok3", "ok", F.col(f"{rec.rules.component}_due").alias("due"))


_OUT = "SELECT loan_id, ok1, ok2, ok3, ok, CAST(due1 AS BIGINT) AS due FROM res"


@query("l8_earlier_capital", f"WITH {_pipeline_sql('capital', False)} {_OUT}", VIEWS)
def l8_capital(src):
    return _outcome(_pipeline(src, "capital", later=False))


@query("l8_earlier_interest", f"WITH {_pipeline_sql('interest', False)} {_OUT}", VIEWS)
def l8_interest(src):
    return _outcome(_pipeline(src, "interest", later=False))


@query("l9_later_capital", f"WITH {_pipeline_sql('capital', True)} {_OUT}", VIEWS)
def l9_capital(src):
    return _outcome(_pipeline(src, "capital"))


@query("l9_later_interest", f"WITH {_pipeline_sql('interest', True)} {_OUT}", VIEWS)
def l9_interest(src):
    return _outcome(_pipeline(src, "interest"))


@query(
    "l10_start_amount",
    f"""WITH {_pipeline_sql('capital', True)} SELECT loan_id, CAST(CASE WHEN out_open > 0 THEN out_open ELSE capital_disbursed_amount END AS BIGINT) AS start_amount,
       CAST(consistent AS INT) AS consistent FROM res""",
    VIEWS,
)
def l10(src):
    return _pipeline(src, "capital").loans.select("loan_id", "start_amount", "consistent")


def _accepted_sql(c, rest=False):
    tail = f"UNION ALL SELECT x.* FROM res JOIN rw x ON loan_id = contract_id WHERE consistent = 1 AND ok <> 1 AND version = 1" if rest else ""
    return f"""SELECT contract_id, due_date, currency, {c}_due FROM (
   SELECT x.* FROM res JOIN rw x ON loan_id = contract_id WHERE consistent = 1 AND ok1 = 1 AND version = 1
   UNION ALL SELECT r2.* FROM r2 JOIN res ON loan_id = contract_id WHERE ok2 = 1
   UNION ALL SELECT r3.* FROM r3 JOIN res ON loan_id = contract_id WHERE ok3 = 1 {tail}) WHERE {c}_due <> 0"""


@query("l9_accepted_capital", f"WITH {_pipeline_sql('capital', True)} {_accepted_sql('capital')}", VIEWS)
def l9_accepted(src):
    return R.accepted_rows(_pipeline(src, "capital"))


def _nested(c):
    return f"SELECT * FROM (WITH {_pipeline_sql(c, True)} {_accepted_sql(c, c == 'interest')})"


@query(
    "l11_final_schedule",
    f"""WITH cap AS ({_nested('capital')}), itr AS ({_nested('interest')}),
     i2 AS (SELECT * FROM itr WHERE contract_id IN (SELECT contract_id FROM cap))
     SELECT coalesce(cap.contract_id, i2.contract_id) AS contract_id, coalesce(cap.due_date, i2.due_date) AS due_date,
            coalesce(cap.currency, i2.currency) AS currency, capital_due, interest_due
     FROM cap FULL JOIN i2 ON cap.contract_id = i2.contract_id AND cap.due_date = i2.due_date AND cap.currency = i2.currency""",
    VIEWS,
)
def l11(src):
    return R.final_schedule(*_pipelines(src, _rules("capital"), _rules("interest")))


@query(
    "l12_inconsistent_loans",
    f"""WITH {_pipeline_sql('capital', True)} SELECT loan_id, capital_disbursed_amount, currency, CAST(out_open AS BIGINT) AS outstanding_open,
       CAST(out_close AS BIGINT) AS outstanding_close, capital_paid FROM res WHERE consistent = 0""",
    VIEWS,
)
def l12_inconsistent(src):
    return R.exceptions(_pipeline(src, "capital"))[0]


@query(
    "l12_mismatched_loans",
    f"WITH {_pipeline_sql('capital', True)} SELECT loan_id, CAST(due1 AS BIGINT) AS capital_due, capital_paid FROM res WHERE consistent = 1 AND ok <> 1",
    VIEWS,
)
def l12_mismatched(src):
    return R.exceptions(_pipeline(src, "capital"))[1]


_DAILY = """daily AS (SELECT contract_id, event_date, CAST(sum(amount) AS BIGINT) AS total_paid,
   CAST(sum(CASE WHEN code IN ('420','423','750') THEN amount ELSE 0 END) AS BIGINT) AS capital_paid,
   CAST(sum(CASE WHEN code IN ('434','751') THEN amount ELSE 0 END) AS BIGINT) AS interest_paid
  FROM r_payment WHERE code IN ('420','423','434','750','751') GROUP BY 1, 2)"""
_MONEY = ["total_due", "capital_due", "interest_due", "total_paid", "capital_paid", "interest_paid"]
_LINE = f"""{_DAILY},
 rec AS (SELECT s.*, count(*) OVER (PARTITION BY contract_id, s.update_date) AS n FROM r_schedule s JOIN r_loan ON contract_id = loan_id
         WHERE disbursement_date >= DATE '1997-12-20'),
 nw AS (SELECT *, max(update_date) OVER (PARTITION BY contract_id, date_trunc('month', due_date)) AS newest FROM rec WHERE n > 1),
 kp AS (SELECT contract_id, due_date, capital_due, interest_due FROM nw WHERE update_date = newest
        UNION ALL SELECT contract_id, due_date, capital_due, interest_due FROM rec WHERE n = 1),
 du AS (SELECT contract_id, due_date, CAST(sum(capital_due) AS BIGINT) AS capital_due, CAST(sum(interest_due) AS BIGINT) AS interest_due,
        CAST(sum(capital_due + interest_due) AS BIGINT) AS total_due FROM kp GROUP BY 1, 2),
 pd AS (SELECT daily.* FROM daily JOIN r_loan ON contract_id = loan_id WHERE disbursement_date >= DATE '1997-12-20'),
 ln AS (SELECT coalesce(du.contract_id, pd.contract_id) AS contract_id, coalesce(due_date, event_date) AS date, due_date, event_date,
        {', '.join(f'coalesce({m}, 0) AS {m}' for m in _MONEY)}
        FROM du FULL JOIN pd ON du.contract_id = pd.contract_id AND du.due_date = pd.event_date),
 line AS (SELECT *, {', '.join(f'CAST(sum({m}) OVER (PARTITION BY contract_id ORDER BY date) AS BIGINT) AS {m}_cum' for m in _MONEY)}
        FROM ln WHERE date BETWEEN {_S} AND {_A})"""


def _line(src):
    parts = parts_for(src["r_schedule"], src["r_payment"])
    paid = A.daily_payments(src["r_payment"], parts=parts)
    return R.events_from_transactions(src["r_schedule"], src["r_loan"], paid, "1997-12-20", SINCE, AS_OF, parts)


@query("l13_events_from_transactions", f"WITH {_LINE} SELECT * FROM line", VIEWS)
def l13(src):
    return _line(src)


@query(
    "l14_assign_due_date",
    f"""WITH {_LINE}, f AS (SELECT *,
     last_value(due_date IGNORE NULLS) OVER (PARTITION BY contract_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p,
     last_value(due_date IGNORE NULLS) OVER (PARTITION BY contract_id ORDER BY date DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x
     FROM line),
     g AS (SELECT *, CASE WHEN total_due_cum - capital_paid_cum - interest_paid_cum < 0 THEN x ELSE p END AS chosen FROM f)
     SELECT g.contract_id, g.chosen AS due_date, g.date, g.event_date, g.total_paid, g.capital_paid, g.interest_paid,
       {', '.join(f'g.{m}_cum' for m in _MONEY)}, g.capital_due_cum - g.capital_paid_cum AS capital_overdue,
       g.interest_due_cum - g.interest_paid_cum AS interest_overdue, a.total_due, a.capital_due, a.interest_due
     FROM g LEFT JOIN (SELECT contract_id, due_date, total_due, capital_due, interest_due FROM line WHERE due_date IS NOT NULL) a
       ON g.contract_id = a.contract_id AND g.chosen = a.due_date""",
    VIEWS,
)
def l14(src):
    return R.assign_due_date(_line(src))


@query(
    "l15_overdue_mismatch",
    f"""WITH {_LINE}, lt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY contract_id ORDER BY date DESC) AS rn FROM line) WHERE rn = 1),
     x AS (SELECT lt.*, abs(capital_due_cum - capital_paid_cum - principal_overdue) > 0.001 AS wc,
           abs(interest_due_cum - interest_paid_cum - interest_overdue) > 0.001 AS wi FROM lt LEFT JOIN r_closing ON contract_id = loan_id),
     n AS (SELECT count(*) AS loans, count(*) FILTER (wc) AS capital_mismatches, count(*) FILTER (wi) AS interest_mismatches,
           count(*) FILTER (wc OR wi) AS any_mismatch FROM x)
     SELECT *, CAST(round(capital_mismatches / loans * 1000000) AS BIGINT) AS capital_mismatches_share,
       CAST(round(interest_mismatches / loans * 1000000) AS BIGINT) AS interest_mismatches_share,
       CAST(round(any_mismatch / loans * 1000000) AS BIGINT) AS any_mismatch_share FROM n""",
    VIEWS,
)
def l15(src):
    out = R.overdue_mismatch(_line(src), src["r_closing"])
    shares = [c for c in out.columns if c.endswith("_share")]
    return out.withColumns({c: F.round(F.col(c) * 1000000).cast("long") for c in shares})


_CLASS_VIEWS = "typed_event loan due_instalment past_due"


def _class_sql(strict):
    early = "AND contract_id IN (SELECT contract_id FROM typed_event GROUP BY 1 HAVING max(early_termination) = 'N')" if strict else ""
    product = "AND l.product_code <> '21050'" if strict else ""
    after = "WHERE s.due_date > l.disbursement_date" if strict else ""
    return f"""ev AS (SELECT contract_id, currency, CAST(sum(CASE WHEN payment_type = 'Principal' THEN amount ELSE 0 END) AS BIGINT) AS principal_paid,
     CAST(sum(CASE WHEN payment_type = 'Interest' THEN amount ELSE 0 END) AS BIGINT) AS interest_paid, CAST(sum(amount) AS BIGINT) AS total_paid
     FROM typed_event WHERE TRUE {early} GROUP BY 1, 2),
   sc AS (SELECT contract_id, CAST(sum(amount_due) AS BIGINT) AS amount_due FROM due_instalment s JOIN loan l ON s.contract_id = l.loan_id {after} GROUP BY 1),
   q AS (SELECT ev.*, l.disbursement_date, l.product_code, coalesce(amount_due, 0) AS amount_due,
     coalesce(principal_overdue, 0) + coalesce(interest_overdue, 0) AS past_due
     FROM ev JOIN loan l ON ev.contract_id = l.loan_id LEFT JOIN sc ON ev.contract_id = sc.contract_id
     LEFT JOIN past_due b ON ev.contract_id = b.loan_id WHERE l.disbursement_date >= DATE '1995-03-01' {product}),
   cl AS (SELECT *, CAST(CASE WHEN abs(amount_due - total_paid - past_due) < 10 THEN 0 WHEN amount_due = 0 THEN 1
     WHEN amount_due > 0 AND amount_due - total_paid - past_due < 0 THEN 2
     WHEN amount_due > 0 AND amount_due - total_paid - past_due > 0 THEN 3 END AS INT) AS mismatch FROM q)"""


def _classes(src, strict):
    return R.mismatch_class(
        src["typed_event"], src["loan"], src["due_instalment"], src["past_due"], "1995-03-01", limit=10, strict=strict
    )


@query("l16_mismatch_list", f"WITH {_class_sql(False)} SELECT * FROM cl WHERE mismatch <> 0", _CLASS_VIEWS)
def l16_list(src):
    return _classes(src, strict=False).where(F.col("mismatch") != 0)


@query(
    "l16_mismatch_class", f"WITH {_class_sql(True)} SELECT mismatch, count(*) AS obs FROM cl GROUP BY 1", _CLASS_VIEWS
)
def l16(src):
    return _classes(src, strict=True).groupBy("mismatch").agg(F.count(F.lit(1)).alias("obs"))


@query(
    "l17_delay_with_class",
    f"""WITH {_class_sql(True)}, k AS (SELECT contract_id, max(mismatch) AS mismatch FROM cl GROUP BY 1),
      lp AS (SELECT DISTINCT contract_id FROM typed_event WHERE event = 'LP')
      SELECT d.contract_id, d.instalment, coalesce(k.mismatch, 4) AS mismatch,
        CAST(CASE WHEN lp.contract_id IS NOT NULL THEN 1 ELSE 0 END AS INT) AS late_flag
      FROM due_instalment d LEFT JOIN k ON d.contract_id = k.contract_id LEFT JOIN lp ON d.contract_id = lp.contract_id""",
    _CLASS_VIEWS,
)
def l17(src):
    delays = src["due_instalment"].select("contract_id", "instalment")
    return R.delay_with_class(delays, _classes(src, strict=True), src["typed_event"])


@query(
    "l18_outside_tolerance",
    f"""WITH {_totals(None)} SELECT * FROM tot WHERE NOT (
      coalesce(abs(capital_paid + principal_overdue - capital_due) <= {_LIMIT.format(c='currency')}, FALSE)
      OR coalesce(abs(capital_disbursed_amount - capital_paid) <= {_LIMIT.format(c='currency')}, FALSE) OR restructured)""",
    VIEWS,
)
def l18(src):
    return R.outside_tolerance(
        src["r_loan"], src["r_schedule"], src["r_payment"], src["r_closing"], AS_OF, SINCE, scale=100
    )


_MOVES = """mv AS (SELECT account_id, CAST(sum(CASE WHEN code = '213' THEN amount WHEN dbcr = 'Cr' THEN amount ELSE -amount END) AS BIGINT) AS m
   FROM account_movement GROUP BY 1),
 ab AS (SELECT coalesce(o.account_id, mv.account_id) AS account_id, coalesce(capital_balance, 0) AS o, coalesce(m, 0) AS m
   FROM opening_account o FULL JOIN mv ON o.account_id = mv.account_id),
 abc AS (SELECT coalesce(ab.account_id, c.account_id) AS account_id, coalesce(o, 0) AS o, coalesce(m, 0) AS m, coalesce(c.capital_balance, 0) AS c
   FROM ab FULL JOIN closing_account c ON ab.account_id = c.account_id)"""
_ACC_VIEWS = "opening_account account_movement closing_account"


@query(
    "l19_account_conservation",
    f"WITH {_MOVES} SELECT CAST(CASE WHEN abs(o + m - c) > 10 THEN 0 ELSE 1 END AS INT) AS ok, count(*) AS obs FROM abc GROUP BY 1",
    _ACC_VIEWS,
)
def l19(src):
    return R.account_conservation(src["opening_account"], src["account_movement"], src["closing_account"], limit=10)


def _roll_sql(how):
    keep = "WHERE o.account_id IS NOT NULL" if how else ""
    return f"""WITH mv AS (SELECT account_id, sum(CASE WHEN dbcr = 'Cr' THEN amount ELSE -amount END) AS m FROM account_movement
       WHERE success = 'C' AND event_date >= DATE '2024-01-05' AND event_date < DATE '2024-01-25' GROUP BY 1),
     k AS (SELECT coalesce(o.account_id, mv.account_id, c.account_id) AS a, coalesce(o.capital_balance, 0) + coalesce(m, 0) - c.capital_balance AS gap
       FROM opening_account o FULL JOIN mv ON o.account_id = mv.account_id
       FULL JOIN closing_account c ON coalesce(o.account_id, mv.account_id) = c.account_id {keep}),
     n AS (SELECT count(*) AS accounts, count(*) FILTER (abs(gap) > 10) AS off_0, count(*) FILTER (abs(gap) > 100) AS off_1 FROM k)
     SELECT *, CAST(floor(off_0 * 100 / accounts) AS BIGINT) AS off_0_percent, CAST(floor(off_1 * 100 / accounts) AS BIGINT) AS off_1_percent FROM n"""


def _roll(src, only_opened):
    out = R.account_rollforward(
        src["opening_account"], src["account_movement"], src["closing_account"], "2024-01-05", "2024-01-25", (10, 100), only_opened
    )
    return out.withColumns({c: F.floor(c).cast("long") for c in ("off_0_percent", "off_1_percent")})


@query("l20_account_rollforward", _roll_sql(False), _ACC_VIEWS)
def l20(src):
    return _roll(src, False)


@query("l20_account_rollforward_opened", _roll_sql(True), _ACC_VIEWS)
def l20_opened(src):
    return _roll(src, True)


_IN = "event_date >= DATE '2024-01-01' AND event_date < DATE '2024-02-01' AND success = 'C'"


@query(
    "l21_activity_by_account",
    f"""WITH s AS (SELECT account_id, CAST(sum(tt_number) AS BIGINT) AS txns_stated, CAST(sum(CASE WHEN dbcr = 'Cr' THEN tt_volume ELSE -tt_volume END) AS BIGINT) AS movement_stated
       FROM activity_summary GROUP BY 1),
     f AS (SELECT account_id, count(*) AS txns_found, CAST(sum(CASE WHEN dbcr = 'Db' THEN -amount ELSE amount END) AS BIGINT) AS movement_found
       FROM account_movement WHERE {_IN} GROUP BY 1)
     SELECT s.*, f.txns_found, f.movement_found FROM s LEFT JOIN f USING (account_id)
     WHERE abs(txns_stated - txns_found) > 0.1 OR abs(movement_stated - movement_found) > 0.1""",
    "activity_summary account_movement",
)
def l21(src):
    return R.activity_by_account(src["activity_summary"], src["account_movement"], "2024-01-01", "2024-02-01")


@query(
    "l21_activity_by_code",
    f"""WITH s AS (SELECT code, CAST(sum(tt_number) AS BIGINT) AS txns_stated, CAST(sum(tt_volume) AS BIGINT) AS volume_stated FROM activity_summary GROUP BY 1),
     f AS (SELECT code, count(*) AS txns_found, CAST(sum(amount) AS BIGINT) AS volume_found FROM account_movement
       WHERE {_IN} AND account_id IN (SELECT account_id FROM activity_summary) GROUP BY 1)
     SELECT coalesce(s.code, f.code) AS code, txns_stated, volume_stated, txns_found, volume_found FROM s FULL JOIN f ON s.code = f.code
     WHERE txns_stated <> txns_found OR volume_stated <> volume_found""",
    "activity_summary account_movement",
)
def l21_code(src):
    return R.activity_by_code(src["activity_summary"], src["account_movement"], "2024-01-01", "2024-02-01")


@query(
    "l22_instalment_payments",
    """WITH e AS (SELECT contract_id, instalment, event_date, sum(CASE WHEN payment_type = 'Principal' THEN amount ELSE 0 END) AS cp,
         sum(CASE WHEN payment_type = 'Interest' THEN amount ELSE 0 END) AS ip FROM typed_event
         WHERE event_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' GROUP BY 1, 2, 3),
       j AS (SELECT s.*, b.status, coalesce(principal_overdue, 0) + coalesce(interest_overdue, 0) AS past_due, coalesce(cp, 0) AS cp,
         coalesce(CASE WHEN event_date < due_date AND ip < s.interest_due AND status = 'CLOSED' THEN s.interest_due ELSE ip END, 0) AS ip
         FROM due_instalment s LEFT JOIN e USING (contract_id, instalment) LEFT JOIN past_due b ON s.contract_id = b.loan_id
         WHERE s.due_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'),
       p AS (SELECT contract_id, instalment, due_date, amount_due, past_due, status, CAST(sum(cp + ip) AS BIGINT) AS amount_paid,
         CAST(CASE WHEN abs(amount_due - sum(cp + ip)) > 10 THEN 0 ELSE 1 END AS INT) AS paid_ok FROM j GROUP BY 1, 2, 3, 4, 5, 6),
       c AS (SELECT contract_id, CAST(CASE WHEN abs(sum(amount_due) - sum(amount_paid) - past_due) > 10 THEN 0 ELSE 1 END AS INT) AS contract_ok
         FROM p WHERE paid_ok = 0 GROUP BY contract_id, status, past_due)
       SELECT p.*, contract_ok, CAST(CASE WHEN paid_ok = 1 OR contract_ok = 1 THEN 1 ELSE 0 END AS INT) AS pay_ok
       FROM p LEFT JOIN c USING (contract_id)""",
    "typed_event due_instalment past_due",
)
def l22(src):
    return R.instalment_payments(
        src["due_instalment"], src["typed_event"], src["past_due"], "1996-01-01", "1998-12-31", limit=10
    )


@query(
    "l22_payments_without_schedule",
    """SELECT payment_type, early_termination, count(*) AS obs FROM typed_event e WHERE NOT EXISTS
       (SELECT 1 FROM due_instalment s WHERE s.contract_id = e.contract_id AND s.instalment = e.instalment) GROUP BY 1, 2""",
    "typed_event due_instalment",
)
def l22_missing(src):
    return R.payments_without_schedule(src["typed_event"], src["due_instalment"])


@query(
    "l23_outstanding_rollforward",
    """WITH e AS (SELECT contract_id AS loan_id, CAST(sum(amount) AS BIGINT) AS amount_paid FROM typed_event
         WHERE event_date BETWEEN DATE '1998-03-01' AND DATE '1998-03-31' AND payment_type IN ('Principal', 'Interest') GROUP BY 1),
       x AS (SELECT coalesce(a.loan_id, b.loan_id, e.loan_id) AS loan_id,
         coalesce(a.principal_outstanding, 0) + coalesce(a.interest_outstanding, 0) AS outstanding_start,
         coalesce(b.principal_outstanding, 0) + coalesce(b.interest_outstanding, 0) AS outstanding_end, coalesce(amount_paid, 0) AS amount_paid
         FROM month_start_balance a FULL JOIN month_end_balance b ON a.loan_id = b.loan_id FULL JOIN e ON coalesce(a.loan_id, b.loan_id) = e.loan_id)
       SELECT x.*, disbursement_date, outstanding_start - amount_paid - outstanding_end AS difference FROM x LEFT JOIN loan USING (loan_id)
       WHERE abs(outstanding_start - amount_paid - outstanding_end) > 10 AND disbursement_date < DATE '1998-03-01'""",
    "typed_event month_start_balance month_end_balance loan",
)
def l23(src):
    return R.outstanding_rollforward(
        src["month_start_balance"], src["month_end_balance"], src["typed_event"], src["loan"], "1998-03-01", "1998-03-31", limit=10
    )
