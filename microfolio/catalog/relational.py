"""The relational building blocks on their own: projections, filters, joins, windows, sets, scalars."""

from functools import reduce

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import core_bank as C
from ..operators import joins as J
from ..operators import windows as W
from ..plans.serving import permitted
from ..sources.writers import range_bucket
from .base import query


@query(
    "a10_range_buckets",
    """SELECT CASE WHEN p_size * 5 - 10 >= 0 AND p_size * 5 - 10 < 200 THEN p_size * 5 - 10 END AS bucket, count(*) AS obs FROM part GROUP BY 1""",
)
def a10(src):
    df = src.table("part").select((F.col("p_size") * 5 - 10).alias("x"))
    return range_bucket(df, "x").groupBy("bucket").agg(F.count(F.lit(1)).alias("obs"))


@query(
    "b2_except_columns",
    "SELECT * EXCLUDE (restructured, payment_type), capital_disbursed_amount // 100 AS whole_units FROM loan",
    "loan",
)
def b2(src):
    whole = F.floor(F.col("capital_disbursed_amount") / 100).cast("long")
    return src["loan"].drop("restructured", "payment_type").withColumn("whole_units", whole)


@query(
    "b9_negated_tree",
    """SELECT loan_id FROM loan WHERE NOT ((currency = 'USD' AND cycle > 2) OR (currency = 'KHR' AND restructured) OR status = 'CLOSED')""",
    "loan",
)
def b9(src):
    ccy = F.col("currency")
    tree = ((ccy == "USD") & (F.col("cycle") > 2)) | ((ccy == "KHR") & F.col("restructured")) | (F.col("status") == "CLOSED")
    return src["loan"].where(~tree).select("loan_id")


@query(
    "b12_between",
    "SELECT loan_id, disbursement_date FROM loan WHERE disbursement_date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'",
    "loan",
)
def b12(src):
    return src["loan"].where(F.col("disbursement_date").between("1997-01-01", "1997-06-30")).select("loan_id", "disbursement_date")


@query(
    "b14_contains", "SELECT s_suppkey, s_name FROM supplier WHERE lower(s_name) LIKE lower('%R#00000000%')"
)
def b14(src):
    return src.table("supplier").where(S.has_text("s_name", "R#00000000")).select("s_suppkey", "s_name")


@query(
    "b17_permission",
    "SELECT loan_id, department_id FROM loan WHERE (department_id = '3' OR department_id = '4') AND status = 'ACTIVE'",
    "loan",
)
def b17(src):
    allowed = (F.col("department_id") == "3") | (F.col("department_id") == "4")
    return permitted(src["loan"], allowed).where(F.col("status") == "ACTIVE").select("loan_id", "department_id")


@query(
    "b19_membership",
    """SELECT contract_id, count(*) AS obs FROM schedule WHERE contract_id IN (SELECT loan_id FROM loan WHERE restructured)
       AND contract_id NOT IN (SELECT loan_id FROM written_off) GROUP BY 1""",
    "schedule loan written_off",
)
def b19(src):
    kept = J.keep_in(src["schedule"], src["loan"].where("restructured"), "contract_id", "loan_id")
    return J.keep_in(kept, src["written_off"], "contract_id", "loan_id", negate=True).groupBy("contract_id").agg(
        F.count(F.lit(1)).alias("obs")
    )


@query(
    "b20_conditional_update",
    "SELECT loan_id, CASE WHEN status = 'CLOSED' AND end_date < maturity_date THEN end_date ELSE maturity_date END AS final_date FROM loan",
    "loan",
)
def b20(src):
    early = (F.col("status") == "CLOSED") & (F.col("end_date") < F.col("maturity_date"))
    return src["loan"].select("loan_id", F.when(early, F.col("end_date")).otherwise(F.col("maturity_date")).alias("final_date"))


@query(
    "b22_prefix", "SELECT customer_id, sector FROM s_customer WHERE substring(customer_name, 1, 16) = 'Customer#0000000'", "s_customer"
)
def b22(src):
    return src["s_customer"].where(F.substring("customer_name", 1, 16) == "Customer#0000000").select("customer_id", "sector")


@query(
    "c3_full_join",
    """SELECT coalesce(a.account_id, m.account_id) AS account_id, coalesce(a.capital_balance, 0) AS opening, coalesce(m.n, 0) AS movements
       FROM opening_account a FULL JOIN (SELECT account_id, count(*) AS n FROM account_movement GROUP BY 1) m ON a.account_id = m.account_id""",
    "opening_account account_movement",
)
def c3(src):
    moves = src["account_movement"].groupBy("account_id").agg(F.count(F.lit(1)).alias("n"))
    out = src["opening_account"].join(moves, "account_id", "full")
    return out.select(
        "account_id", S.zero_if_null("capital_balance").alias("opening"), S.zero_if_null("n").alias("movements")
    )


@query(
    "c5_join_on_shared",
    """SELECT a.contract_id, a.due_date, a.capital_due, b.n FROM schedule a LEFT JOIN
       (SELECT contract_id, due_date, count(*) AS n FROM due_instalment GROUP BY 1, 2) b ON a.contract_id = b.contract_id AND a.due_date = b.due_date""",
    "schedule due_instalment",
)
def c5(src):
    left = src["schedule"].select("contract_id", "due_date", "capital_due")
    right = src["due_instalment"].groupBy("contract_id", "due_date").agg(F.count(F.lit(1)).alias("n"))
    return J.join_on_shared(left, right, "left")


@query(
    "c6_renamed_keys",
    "SELECT s.contract_id, s.instalment, l.status FROM schedule s JOIN loan l ON s.contract_id = l.loan_id",
    "schedule loan",
)
def c6(src):
    rows = src["schedule"].select("contract_id", "instalment")
    return J.join_renamed(rows, src["loan"].select("loan_id", "status"), {"contract_id": "loan_id"}, "inner")


@query(
    "c8_theta_join",
    """SELECT l.loan_id, CAST(sum(s.capital_due) AS BIGINT) AS due_after FROM loan l JOIN schedule s
       ON l.loan_id = s.contract_id AND s.due_date > l.disbursement_date GROUP BY 1""",
    "loan schedule",
)
def c8(src):
    later = (F.col("loan_id") == F.col("contract_id")) & (F.col("due_date") > F.col("disbursement_date"))
    return src["loan"].join(src["schedule"], later).groupBy("loan_id").agg(F.sum("capital_due").alias("due_after"))


@query(
    "c15_null_aware_not_in",
    """SELECT loan_id FROM loan WHERE customer_id NOT IN (SELECT CASE WHEN customer_id > 100 THEN customer_id ELSE 0 END FROM account_balance)""",
    "loan account_balance",
)
def c15(src):
    listed = src["account_balance"].select(F.when(F.col("customer_id") > 100, F.col("customer_id")).otherwise(0).alias("k"))
    return J.not_in(src["loan"], listed, "customer_id", "k").select("loan_id")


@query(
    "d12_average_of_daily_ratios",
    """SELECT portfolio_manager_id, CAST(round(avg(p) * 1000000) AS BIGINT) AS average_share FROM
       (SELECT portfolio_manager_id, balance_date, sum(CASE WHEN days_overdue > 7 THEN principal_outstanding ELSE 0 END) / sum(principal_outstanding) AS p
        FROM s_balance GROUP BY 1, 2) GROUP BY 1""",
    "s_balance",
)
def d12(src):
    days = src["s_balance"].groupBy("portfolio_manager_id", "balance_date").agg(
        S.ratio(S.sum_if(F.col("days_overdue") > 7, "principal_outstanding"), F.sum("principal_outstanding")).alias("p")
    )
    return days.groupBy("portfolio_manager_id").agg(F.round(F.avg("p") * 1000000).cast("long").alias("average_share"))


@query(
    "d14_sum_of_filtered",
    """SELECT contract_id, CAST(sum(CASE WHEN payment_type = 'Principal' THEN amount ELSE 0 END) AS BIGINT) AS principal,
       CAST(sum(CASE WHEN payment_type = 'Interest' THEN amount ELSE 0 END) AS BIGINT) AS interest FROM typed_event GROUP BY 1""",
    "typed_event",
)
def d14(src):
    kind = F.col("payment_type")
    return src["typed_event"].groupBy("contract_id").agg(
        S.sum_if(kind == "Principal", "amount").alias("principal"), S.sum_if(kind == "Interest", "amount").alias("interest")
    )


@query(
    "e6_running_sum",
    """SELECT contract_id, instalment, due_date, capital_due,
       CAST(sum(capital_due) OVER (PARTITION BY contract_id ORDER BY due_date) AS BIGINT) AS capital_cum FROM schedule""",
    "schedule",
)
def e6(src):
    df = src["schedule"].select("contract_id", "instalment", "due_date", "capital_due")
    return W.running_sum(df, ["contract_id"], "due_date", {"capital_due": "capital_cum"})


@query(
    "e6_running_sum_timestamp",
    """SELECT event_id, user_id, ts, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS id_cum
       FROM events""",
)
def e6_timestamp(src):
    df = src.table("events").select("event_id", "user_id", "ts")
    return W.running_sum(df, ["user_id"], "ts", {"event_id": "id_cum"})


@query(
    "e7_previous_or_zero",
    """SELECT account_id, balance_date, coalesce(lag(capital_balance) OVER (PARTITION BY account_id ORDER BY balance_date), 0) AS before FROM account_balance""",
    "account_balance",
)
def e7(src):
    out = W.previous(src["account_balance"], ["account_id"], ["balance_date"], {"capital_balance": "before"})
    return out.select("account_id", "balance_date", "before")


@query(
    "e9_previous_balance",
    """SELECT account_id, balance_date, lead(capital_balance) OVER (PARTITION BY account_id ORDER BY balance_date DESC) AS before FROM account_balance""",
    "account_balance",
)
def e9(src):
    out = W.previous(src["account_balance"], ["account_id"], ["balance_date"], {"capital_balance": "before"}, default=None)
    return out.select("account_id", "balance_date", "before")


@query(
    "e10_global_maximum",
    "SELECT account_id, balance_date, max(balance_date) OVER () AS last_date FROM account_balance",
    "account_balance",
)
def e10(src):
    df = src["account_balance"].select("account_id", "balance_date")
    return df.withColumn("last_date", df.select(F.max("balance_date")).scalar())


@query(
    "e11_reverse_running_sum",
    """SELECT account_id, balance_date, CAST(sum(capital_balance) OVER (PARTITION BY account_id ORDER BY balance_date DESC) AS BIGINT) AS ahead FROM account_balance""",
    "account_balance",
)
def e11(src):
    out = W.running_over_grain(src["account_balance"], ["account_id"], "balance_date", {"capital_balance": "ahead"}, desc=True)
    return out.select("account_id", "balance_date", "ahead")


@query(
    "e14_row_number",
    "SELECT account_id, balance_date, CAST(row_number() OVER (PARTITION BY account_id ORDER BY balance_date) AS INT) AS row_no FROM account_balance",
    "account_balance",
)
def e14(src):
    out = W.row_number(src["account_balance"], ["account_id"], [F.col("balance_date")])
    return out.select("account_id", "balance_date", "row_no")


@query(
    "e19_priority",
    """SELECT contract_id, customer_id, due_date, count(v) OVER (PARTITION BY customer_id, due_date ORDER BY amount_due DESC, contract_id
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS priority
       FROM (SELECT *, CASE WHEN delay < 30 THEN amount_due END AS v FROM advance_instalment)""",
    "advance_instalment",
)
def e19(src):
    df = src["advance_instalment"].withColumn("v", F.when(F.col("delay") < 30, F.col("amount_due")))
    out = W.priority_number(df, ["customer_id", "due_date"], [F.desc("amount_due"), "contract_id"], "v")
    return out.select("contract_id", "customer_id", "due_date", "priority")


_FILL = """WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS day, CASE WHEN event_type = 'view' THEN event_id END AS seen FROM events),
 g AS (SELECT user_id, day, max(seen) AS seen FROM e GROUP BY 1, 2),
 f AS (SELECT user_id, day, last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY day {d} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen_filled FROM g)
 SELECT e.event_id, e.user_id, e.day, f.seen_filled FROM e JOIN f ON e.user_id = f.user_id AND e.day = f.day"""


def _fill(src, backward):
    df = src.table("events").select(
        "event_id", "user_id", F.col("ts").cast("date").alias("day"), F.when(F.col("event_type") == "view", F.col("event_id")).alias("seen")
    )
    return W.fill(df, ["user_id"], "day", ["seen"], backward).drop("seen")


@query("e17_fill_forward", _FILL.format(d=""))
def e17(src):
    return _fill(src, False)


@query("e18_fill_backward", _FILL.format(d="DESC"))
def e18(src):
    return _fill(src, True)


@query(
    "f4_page",
    "SELECT loan_id, capital_disbursed_amount FROM loan ORDER BY capital_disbursed_amount DESC, loan_id LIMIT 50 OFFSET 10",
    "loan",
)
def f4(src):
    df = src["loan"].select("loan_id", "capital_disbursed_amount")
    return df.orderBy(F.desc("capital_disbursed_amount"), "loan_id").offset(10).limit(50)


@query(
    "g4_live_and_snapshot",
    """SELECT account_id, CAST(balance_date AS TIMESTAMP) AS at, capital_balance FROM account_balance
       UNION ALL SELECT account_id, TIMESTAMP '2023-12-31 00:00:00', capital_balance FROM opening_account""",
    "account_balance opening_account",
)
def g4(src):
    live = src["account_balance"].select("account_id", F.col("balance_date").cast("timestamp_ntz").alias("at"), "capital_balance")
    old = src["opening_account"].select("account_id", F.expr("TIMESTAMP_NTZ '2023-12-31 00:00:00'").alias("at"), "capital_balance")
    return live.union(old)


@query(
    "g6_unpivot",
    """SELECT contract_id, instalment, due_date, 'Capital' AS type, capital_due AS due_amount FROM schedule WHERE capital_due > 0
       UNION ALL SELECT contract_id, instalment, due_date, 'Interest', interest_due FROM schedule WHERE interest_due > 0""",
    "schedule",
)
def g6(src):
    return C.split_components(src["schedule"])


@query(
    "h_dates",
    """SELECT loan_id, CAST(date_trunc('month', disbursement_date) AS DATE) AS month_start, CAST(disbursement_date - INTERVAL 6 MONTH AS DATE) AS half_year_before,
       CAST(maturity_date - disbursement_date AS INT) AS days, CAST(year(disbursement_date) AS INT) AS y, CAST(month(disbursement_date) AS INT) AS m,
       CAST(disbursement_date + INTERVAL 1 YEAR AS DATE) AS next_year FROM loan""",
    "loan",
)
def h_dates(src):
    d = F.col("disbursement_date")
    return src["loan"].select(
        "loan_id",
        S.month_of(d).alias("month_start"),
        S.months_before(d, 6).alias("half_year_before"),
        S.midnights(d, "maturity_date").alias("days"),
        F.year(d).alias("y"),
        F.month(d).alias("m"),
        F.add_months(d, 12).alias("next_year"),
    )


@query(
    "h9_day_differences",
    """SELECT event_id, CAST(date_diff('day', ts, TIMESTAMP '2024-02-01 12:00:00') AS INT) AS midnights,
       CAST(date_sub('day', ts, TIMESTAMP '2024-02-01 12:00:00') AS BIGINT) AS whole_days FROM events""",
)
def h9(src):
    end = F.expr("TIMESTAMP_NTZ '2024-02-01 12:00:00'")
    return src.table("events").select(
        "event_id", S.midnights("ts", end).alias("midnights"), S.whole_days("ts", end).alias("whole_days")
    )


@query(
    "h13_month_spine",
    """SELECT loan_id, CAST(unnest(generate_series(date_trunc('month', disbursement_date), date_trunc('month', end_date), INTERVAL 1 MONTH)) AS DATE) AS month FROM loan""",
    "loan",
)
def h13(src):
    spine = S.date_spine(S.month_of("disbursement_date"), S.month_of("end_date"), "1 month")
    return src["loan"].select("loan_id", F.explode(spine).alias("month"))


@query(
    "h19_round_half_even",
    "SELECT l_orderkey, l_partkey, CAST(round_even(CAST(l_suppkey AS DOUBLE) / 2, 0) AS BIGINT) AS even, "
    "CAST(round(CAST(l_suppkey AS DOUBLE) / 2) AS BIGINT) AS away FROM lineitem",
)
def h19(src):
    half = F.col("l_suppkey").cast("double") / 2
    return src.table("lineitem").select(
        "l_orderkey", "l_partkey", S.round_half_even(half).cast("long").alias("even"), S.to_long(half).alias("away")
    )


@query(
    "h22_clamp",
    "SELECT event_id, least(greatest(CAST(round(value * 100) AS BIGINT), 1000), 5000) AS limited FROM events",
)
def h22(src):
    return src.table("events").select(
        "event_id", S.clamp(F.round(F.col("value") * 100).cast("long"), 1000, 5000).alias("limited")
    )


@query(
    "i1_core_dates",
    """SELECT l_orderkey, l_linenumber, l_partkey, date_text,
       CASE l_suppkey % 5 WHEN 0 THEN strftime(d, '%Y-%m-%d') || ' 00:00' WHEN 2 THEN strftime(d, '%Y-%m-%d') || ' 00:00'
         WHEN 1 THEN CASE WHEN date_text[1] <> '9' THEN strftime(d, '%Y-%m-%d') || ' ' || lpad(CAST(l_suppkey % 24 AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_partkey % 60 AS VARCHAR), 2, '0') END
       END AS parsed FROM core_text""",
    "core_text",
)
def i1(src):
    return C.parse_dates(src["core_text"].withColumn("t", F.col("date_text")), ["t"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "date_text", F.date_format("t", "yyyy-MM-dd HH:mm").alias("parsed")
    )


@query(
    "i2_text_numbers",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(coalesce(TRY_CAST(number_text AS DOUBLE), 0) AS BIGINT) AS number,
       CASE WHEN number_text NOT IN ('', '[NULL]') THEN number_text END AS filled FROM core_text""",
    "core_text",
)
def i2(src):
    return src["core_text"].select(
        "l_orderkey", "l_linenumber", "l_partkey", S.to_number("number_text").cast("long").alias("number"),
        S.blank_to_null("number_text").alias("filled"),
    )


_CORE = """SELECT concat('LD', lpad(CAST(l_orderkey AS STRING), 10, '0')) AS loan, l_orderkey, l_linenumber, l_suppkey, d, date_text, CAST(l_partkey AS STRING) AS trnamt,
  CAST(l_suppkey AS STRING) AS priamt, number_text AS intamt FROM core_text"""


@query(
    "l13_core_payments",
    f"""WITH c AS ({_CORE.replace('STRING', 'VARCHAR')}),
     r AS (SELECT c.*, CASE l_linenumber WHEN 1 THEN '420' WHEN 2 THEN '434' WHEN 3 THEN '752' WHEN 4 THEN '402' ELSE '430' END AS code,
        coalesce(TRY_CAST(intamt AS DOUBLE), 0) AS i, CAST(l_suppkey AS DOUBLE) AS p FROM c)
     SELECT loan AS contract_id, CASE WHEN l_suppkey % 5 IN (0, 2) OR (l_suppkey % 5 = 1 AND date_text[1] <> '9') THEN d END AS event_date, CAST(sum(CAST(trnamt AS BIGINT)) AS BIGINT) AS total_paid,
       CAST(sum(p) AS BIGINT) AS capital_paid, CAST(sum(i) AS BIGINT) AS interest_paid, CAST(0 AS BIGINT) AS penalty_paid
     FROM r WHERE code IN ('420', '434', '752') AND (p > 0 OR i > 0) GROUP BY 1, 2""",
    "core_text",
)
def l13_core(src):
    code = F.expr("CASE l_linenumber WHEN 1 THEN '420' WHEN 2 THEN '434' WHEN 3 THEN '752' WHEN 4 THEN '402' ELSE '430' END")
    loan = F.concat(F.lit("LD"), F.lpad(F.col("l_orderkey").cast("string"), 10, "0"))
    raw = src["core_text"].select(
        F.lit("2").alias("trnid"),
        F.when(F.col("l_linenumber") == 2, F.concat(F.lit("PD"), loan)).otherwise(loan).alias("acc"),
        code.alias("trncode"),
        F.col("date_text").alias("trndate"),
        F.col("date_text").alias("valuedate"),
        F.col("l_partkey").cast("string").alias("trnamt"),
        F.col("l_suppkey").cast("string").alias("priamt"),
        F.col("number_text").alias("intamt"),
        F.lit("x").alias("penamt"),
    )
    out = C.loan_payments(raw)
    money = ["total_paid", "capital_paid", "interest_paid", "penalty_paid"]
    return reduce(lambda d, m: d.withColumn(m, F.col(m).cast("long")), money, out)
