"""Hand-made frames: ties, NULLs, empty groups, hot keys, boundaries."""

import datetime as dt
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from microfolio.functions import scalars as S
from microfolio.catalog import contracts as catalog_contracts
from microfolio.operators import activity, allocation, contracts, delay, fx, joins, quality, reconcile, versioning, windows
from microfolio.operators.decode import decode
from microfolio.plans import serving
from microfolio.session import staged


def day(n):
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ---- versions -------------------------------------------------------------------------------


def test_tied_newest_rows_share_their_number(spark):
    df = spark.createDataFrame([("a", day(1), 1), ("a", day(2), 2), ("a", day(2), 3), ("b", day(5), 4)], "k string, d date, i int")
    out = versioning.version_counter(df, ["k"], "d")
    assert rows(out, "i", "version") == [(1, 3), (2, 2), (3, 2), (4, 1)]
    # the tie leaves key a without a version 1
    assert rows(versioning.first_version(df, ["k"], "d", ["i"]), "k", "i") == [("b", 4)]
    assert rows(versioning.first_version(df, ["k"], "d", ["i"], oldest=True), "k", "i") == [("a", 1), ("b", 4)]


def test_null_dates_are_oldest(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", day(2), 2)], "k string, d date, i int")
    assert rows(versioning.version_counter(df, ["k"], "d"), "i", "version") == [(1, 2), (2, 1)]
    assert rows(versioning.first_version(df, ["k"], "d", ["i"], oldest=True), "i") == [(1,)]
    assert rows(versioning.first_version(df, ["k"], "d", ["i"]), "i") == [(2,)]


def test_null_keys_form_one_group(spark):
    df = spark.createDataFrame([(None, day(1), 1), (None, day(2), 2)], "k string, d date, i int")
    assert rows(versioning.version_counter(df, ["k"], "d"), "i", "version") == [(1, 2), (2, 1)]


def test_validity_end_among_ties(spark):
    df = spark.createDataFrame([("a", day(1), 1), ("a", day(1), 2), ("a", day(4), 3)], "k string, d date, i int")
    out = versioning.with_history(df, ["k"], "d", ["i"])
    assert rows(out, "i", "valid_to", "version") == [(1, day(1), 3), (2, day(4), 3), (3, None, 1)]


def test_primary_department_order(spark):
    loans = spark.createDataFrame(
        [(1, 10, 500, "x"), (1, 9, 500, "y"), (1, 8, None, "z"), (2, 7, None, "w")],
        "customer_id int, loan_id int, capital_disbursed_amount int, department_id string",
    )
    deps = spark.createDataFrame([("y", 4)], "department_id string, department_id_scoring int")
    out = versioning.primary_department(loans, deps)
    assert rows(out, "customer_id", "department_id", "department_id_scoring") == [(1, "y", 4), (2, "w", None)]


def test_running_sum_over_hot_key_and_timestamps(spark):
    base = dt.datetime(2020, 1, 1)
    data = [("hot", base + dt.timedelta(minutes=7 * (i % 900)), i) for i in range(3000)]
    data += [(f"k{i}", base + dt.timedelta(minutes=i), i) for i in range(600)]
    df = spark.createDataFrame(data, "k string, t timestamp, v long")
    for desc in (False, True):
        got = rows(windows.running_sum(df, ["k"], "t", {"v": "s"}, desc=desc), "k", "t", "v", "s")
        df.createOrReplaceTempView("hot_rows")
        order = "DESC" if desc else "ASC"
        want = rows(spark.sql(f"SELECT *, sum(v) OVER (PARTITION BY k ORDER BY t {order}) AS s FROM hot_rows"), "k", "t", "v", "s")
        assert got == want


def test_previous_zeroes_a_null_predecessor(spark):
    df = spark.createDataFrame([("a", day(1), None), ("a", day(2), 5)], "k string, d date, v int")
    assert rows(windows.previous(df, ["k"], ["d"], {"v": "p"}), "d", "p") == [(day(1), 0), (day(2), 0)]


# ---- joins ----------------------------------------------------------------------------------


@pytest.mark.parametrize("listed", [[1, 2], [1, None], []])
def test_not_in_has_sql_null_rules(spark, listed):
    left = spark.createDataFrame([(1,), (3,), (None,)], "k int")
    right = spark.createDataFrame([(v,) for v in listed], "k int")
    left.createOrReplaceTempView("left_rows")
    right.createOrReplaceTempView("right_rows")
    want = rows(spark.sql("SELECT k FROM left_rows WHERE k NOT IN (SELECT k FROM right_rows)"), "k")
    assert rows(joins.not_in(left, right, "k"), "k") == want


def test_shared_columns_and_renamed_keys(spark):
    a = spark.createDataFrame([(1, "x", 5)], "id int, c string, v int")
    b = spark.createDataFrame([(1, "x", 7), (1, "y", 8)], "id int, c string, w int")
    assert rows(joins.join_on_shared(a, b), "v", "w") == [(5, 7)]
    with pytest.raises(ValueError):
        joins.join_on_shared(a.select("v"), b.select("w"))
    c = spark.createDataFrame([(1, "q")], "key int, z string")
    assert rows(joins.join_renamed(a, c, {"id": "key"}), "id", "z") == [(1, "q")]


def test_duplicated_dictionary_rows_multiply(spark):
    df = spark.createDataFrame([("1",), ("2",)], "code string")
    names = spark.createDataFrame([("Kind", "1", "a"), ("KIND", "1", "b")], "field_name string, field_code string, field_description string")
    out = decode(df, names, {"code": ("KIND", "name")})
    assert rows(out, "code", "name") == [("1", "a"), ("1", "b"), ("2", None)]
    assert rows(decode(df, names, {"code": ("KIND", "name")}, exact_case=True), "code", "name") == [("1", "b"), ("2", None)]


# ---- money ----------------------------------------------------------------------------------


def test_missing_rate_is_one_in_usd_and_null_in_three(spark):
    df = spark.createDataFrame([("KHR", day(1), 8000), ("USD", day(1), 10), ("EUR", day(1), 3)], "currency string, update_date date, x long")
    rates = spark.createDataFrame([("KHR", day(1), 1.0), ("USD", day(1), 0.00025), ("THB", day(1), 0.0075)], "currency string, rate_date date, rate double")
    usd = spark.createDataFrame([("KHR", day(1), 0.00025)], "currency string, rate_date date, rate double")
    assert rows(fx.to_usd(df, usd, ["x"]), "currency", "x_usd") == [("EUR", 3.0), ("KHR", 2.0), ("USD", 10.0)]
    three = fx.to_three(df, rates, ["x"], fixed_date="2020-01-02")
    got = {r["currency"]: (r["x_khr"], r["x_usd"], r["x_thb"]) for r in three.collect()}
    assert got["KHR"] == (8000.0, 2.0, 60.0)
    assert got["USD"][1] == 10.0
    assert got["EUR"] == (None, None, None)


def test_classifier_boundaries(spark):
    df = spark.createDataFrame(
        [("USD", 0.1), ("USD", 0.11), ("USD", -0.2), ("THB", 1.0), ("KHR", -100.0), ("KHR", -100.5), ("EUR", 9e9), ("USD", None)],
        "ccy string, d double",
    )
    out = df.select("ccy", "d", S.classify("d", "ccy").alias("ok"), S.classify("d", "ccy", codes=(0, 1, 2)).alias("r")).collect()
    assert [r["ok"] for r in out] == [0, 1, -1, 0, 0, -1, 0, 0]
    assert [r["r"] for r in out] == [1, 2, 0, 1, 1, 0, 1, 1]


# ---- allocation -----------------------------------------------------------------------------


def brute_allocation(dues, pays):
    """Pairwise definition for one contract; dues and pays are {day: amount} of totals."""
    out, prev = [], {}
    dc = 0
    spans = []
    for d in sorted(dues):
        spans.append((d, dues[d], dc, dc + dues[d]))
        dc += dues[d]
    for d, due, d0, d1 in spans:
        pc, before = 0, 0
        for e in sorted(pays):
            p0, p1 = pc, pc + pays[e]
            pc = p1
            if p1 > d0 and p0 < d1:
                left = max(d1 - p1, 0)
                if before > 0 and pays[e] > before:
                    amount = before
                elif before == 0 and p1 > d1:
                    amount = due
                elif p0 < d0:
                    amount = p1 - d0
                else:
                    amount = pays[e]
                before = left
                out.append((d, e, amount))
    return sorted(out)


@pytest.mark.parametrize("reversals", [False, True])
def test_allocation_equals_pairwise_definition(spark, reversals):
    rnd = random.Random(5 if reversals else 4)
    sched, pay, want = [], [], []
    for c in range(120):
        dues = {day(rnd.randrange(40)): rnd.choice([0, 10, 25, 40]) for _ in range(rnd.randrange(6))}
        low = -20 if reversals else 0
        pays = {day(rnd.randrange(40)): rnd.choice([low, 0, 5, 10, 35, 90]) for _ in range(rnd.randrange(7))}
        sched += [(c, 1, d, a, 0) for d, a in dues.items()]
        pay += [(c, e, a, "420") for e, a in pays.items()]
        want += [(c, d, e, a) for d, e, a in brute_allocation(dues, pays)]
    s = spark.createDataFrame(sched, "contract_id int, instalment int, due_date date, capital_due long, interest_due long")
    p = spark.createDataFrame(pay, "contract_id int, event_date date, amount long, code string")
    due, paid = allocation.due_side(s), allocation.paid_side(allocation.daily_payments(p))
    everything = allocation.allocate(due, paid, residue=float("-inf"))
    assert rows(everything, "contract_id", "due_date", "event_date", "total_settled") == sorted(want, key=repr)
    kept = allocation.allocate(due, paid)
    assert rows(kept, "contract_id", "due_date", "event_date", "total_settled") == sorted([w for w in want if w[3] > 0.00001], key=repr)


def test_instalments_of_one_day_are_kept_apart(spark):
    d = day(30)
    s = spark.createDataFrame([(1, 1, d, 100, 0), (1, 2, d, 50, 0), (1, 3, day(60), 40, 0)], "contract_id int, instalment int, due_date date, capital_due long, interest_due long")
    p = spark.createDataFrame([(1, day(5), 120, "420"), (1, day(31), 45, "420")], "contract_id int, event_date date, amount long, code string")
    out = allocation.event_calculated(s, p)
    want = [(1, day(5), 100), (2, day(5), 20), (2, day(31), 30), (3, day(31), 15)]
    assert rows(out, "instalment", "event_date", "total_paid") == sorted(want, key=repr)


def test_allocated_sum_is_the_smaller_of_paid_and_due(spark):
    s = spark.createDataFrame([(1, i, day(30 * i), 100, 10) for i in range(1, 5)], "contract_id int, instalment int, due_date date, capital_due long, interest_due long")
    p = spark.createDataFrame([(1, day(5), 250, "420"), (1, day(90), 33, "434")], "contract_id int, event_date date, amount long, code string")
    out = allocation.event_calculated(s, p)
    assert out.agg(F.sum("total_paid")).first()[0] == min(283, 440)
    assert out.count() == 4


def test_opening_arrears_are_instalment_zero(spark):
    s = spark.createDataFrame([(1, 1, day(30), 100, 0)], "contract_id int, instalment int, due_date date, capital_due long, interest_due long")
    o = spark.createDataFrame([(1, day(0), 40, 0), (2, day(0), 0, 0)], "contract_id int, balance_date date, principal_overdue long, interest_overdue long")
    p = spark.createDataFrame([(1, day(10), 60, "423")], "contract_id int, event_date date, amount long, code string")
    ev = allocation.event_calculated(s, p, o)
    assert rows(ev, "instalment", "total_paid", "capital_decrease_flag") == [(0, 40, 1), (1, 20, 1)]
    moved = allocation.shift_capital_decrease(ev)
    assert rows(moved, "instalment", "event_date", "total_paid") == [(0, day(0), 40), (1, day(30), 20)]


def test_decimal_money(spark):
    s = spark.createDataFrame([("L1", 1, day(30), "100.10", "0.40")], "contract_id string, instalment int, due_date date, c string, i string")
    s = s.select("contract_id", "instalment", "due_date", F.col("c").cast("decimal(18,2)").alias("capital_due"), F.col("i").cast("decimal(18,2)").alias("interest_due"))
    for amount in ("50.25", "-3.00"):
        p = spark.createDataFrame([("L1", day(3), amount, "420"), ("L1", day(4), "10.00", "420")], "contract_id string, event_date date, a string, code string")
        p = p.withColumn("amount", F.col("a").cast("decimal(18,2)"))
        out = allocation.event_calculated(s, p)
        assert float(out.agg(F.sum("total_paid")).first()[0]) > 0


def test_early_terminations_look_at_all_later_payments(spark):
    data = [(1, day(30), day(10), 50), (1, day(60), day(40), 50), (2, day(30), day(20), 50), (2, day(60), day(70), 50)]
    df = spark.createDataFrame(data, "contract_id int, due_date date, event_date date, instalment_paid int")
    got = rows(allocation.advance_classes(df), "negative_days", "rounding_issues", "early_terminations", "payments")
    assert got == [(0, 0, 0, 1), (1, 0, 0, 1), (1, 0, 1, 2)]


# ---- reconciliation -------------------------------------------------------------------------


def test_previous_update_explains_overpayment(spark):
    loans = spark.createDataFrame(
        [Row(loan_id=1, currency="USD", disbursement_date=day(0), maturity_date=day(400), end_date=day(400), update_date=day(0),
             status="ACTIVE", restructured=False, capital_disbursed_amount=1000)]
    )
    sched = spark.createDataFrame(
        [(1, day(40), day(1), 70, 0), (1, day(41), day(2), 100, 0), (1, day(80), day(2), 100, 0)],
        "contract_id int, due_date date, update_date date, capital_due long, interest_due long",
    )
    txn = spark.createDataFrame([(1, day(41), 270, "420")], "contract_id int, event_date date, amount long, code string")
    close = spark.createDataFrame([(1, 730, 0, 0, 0)], "loan_id int, principal_outstanding long, principal_overdue long, interest_outstanding long, interest_overdue long")
    first = reconcile.first_step(loans, sched, txn, close, "capital", "2020-06-01", "2020-01-01")
    assert first.first()["ok"] == 1
    second = reconcile.second_step(first, sched, "capital", "2020-01-01", traceable_only=True)
    assert second.first()["ok2"] == 0
    rec = reconcile.pipeline(loans, sched, txn, close, close.limit(0), reconcile.Rules(as_of="2020-06-01", since="2020-01-01"))
    got = rec.loans.first()
    assert (got["ok1"], got["ok2"], got["ok"], got["consistent"]) == (2, 1, 1, 1)
    assert rows(reconcile.accepted_rows(rec), "capital_due") == [(100,), (100,), (70,)]


def test_account_conservation_sides(spark):
    o = spark.createDataFrame([("a", 100), ("b", 5)], "account_id string, capital_balance long")
    m = spark.createDataFrame([("a", 30, "Db", "1"), ("a", 10, "Db", "213"), ("c", 7, "Cr", "1")], "account_id string, amount long, dbcr string, code string")
    c = spark.createDataFrame([("a", 80), ("c", 7), ("d", 9)], "account_id string, capital_balance long")
    assert rows(reconcile.account_conservation(o, m, c), "ok", "obs") == [(0, 2), (1, 2)]


# ---- behaviour ------------------------------------------------------------------------------


def test_weighted_delay_of_part_payments_and_none(spark):
    ev = spark.createDataFrame(
        [("c", 1, "USD", 1, day(10), 100, day(20), 50), ("c", 1, "USD", 1, day(10), 100, day(5), 20), ("c", 1, "USD", 2, day(40), 100, None, None),
         ("c", 1, "USD", 3, day(500), 100, None, None)],
        "customer_id string, contract_id int, currency string, instalment_number int, due_date date, amount_due long, event_date date, paid_amount long",
    )
    got = rows(delay.weighted_delay(ev, day(60).isoformat()), "instalment_number", "delay")
    # 10 days x 50/100 plus 50 days x the unpaid 30/100; the early part counts 0
    assert got == [(1, 20.0), (2, 20.0), (3, None)]


def brute_cover(inst, bal, n):
    out = {}
    by_customer = {}
    for c, due, amount in inst:
        by_customer.setdefault(c, []).append((due, amount))
    for c, items in by_customer.items():
        dates = {d - dt.timedelta(days=k) for d, _ in items for k in range(n + 1)}
        for date in dates:
            live = sorted([(d, -a) for d, a in items if d - dt.timedelta(days=n) <= date <= d])
            rest = bal.get((c, date), 0.0)
            for d, neg in live:
                cover = min(max(max(rest, 0.0) / -neg, 0.0), 1.0)
                key = (c, d - dt.timedelta(days=n))
                out[key] = out.get(key, 0.0) + cover
                rest -= -neg
    return {k: min(v, float(n)) for k, v in out.items()}


def test_advance_cover_equals_brute_force(spark):
    rnd = random.Random(3)
    inst = [(rnd.randrange(3), day(30 + rnd.randrange(25)), rnd.choice([100, 100, 250])) for _ in range(60)]
    bal = {(c, day(n)): float(rnd.randrange(0, 900)) for c in range(3) for n in range(0, 60) if rnd.random() < 0.8}
    i = spark.createDataFrame([(c, "KHR", d, a) for c, d, a in inst], "customer_id int, currency string, due_date date, amount_due long")
    b = spark.createDataFrame([(c, d, v) for (c, d), v in bal.items()], "customer_id int, date date, balance_khr double")
    r = spark.createDataFrame([("USD", day(0), 2.0)], "currency string, rate_date date, rate double")
    got = {(x["customer_id"], x["window_start"]): x["advance"] for x in delay.advance_cover(i, b, r).collect()}
    want = brute_cover(inst, bal, 20)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_daily_balances_fill_gaps(spark):
    b = spark.createDataFrame([("x", 1, "KHR", day(2), 10), ("y", 1, "KHR", day(4), 5), ("z", 2, "USD", day(1), 4)], "account_id string, customer_id int, currency string, balance_date date, capital_balance long")
    r = spark.createDataFrame([("KHR", day(0), 1.0)], "currency string, rate_date date, rate double")
    got = rows(delay.daily_balances(b, r, day(0).isoformat(), day(5).isoformat()), "customer_id", "date", "balance_khr")
    assert got == sorted([(1, day(2), 10.0), (1, day(3), 10.0), (1, day(4), 15.0), (1, day(5), 15.0)] + [(2, day(n), 0.0) for n in range(1, 6)], key=repr)


def test_score_limits(spark):
    d = spark.createDataFrame([(1, day(30), 0.0), (1, day(31), 45.0), (2, day(30), 0.0)], "customer_id int, due_date date, delay double")
    c = spark.createDataFrame([(1, day(10), 12.5)], "customer_id int, window_start date, advance double")
    assert rows(delay.payment_score(d, c), "score", "truncated_score") == [(-12.5, 0.0), (0.0, 0.0), (30.0, 30.0)]


def test_active_customers_compare_with_all_history(spark):
    lb = spark.createDataFrame([(1, 7, day(-400), 100, 0), (1, 7, day(0), 90, 0), (2, 8, day(0), 5, 0)], "loan_id int, customer_id int, balance_date date, principal_outstanding long, interest_outstanding long")
    tx = spark.createDataFrame([(9, day(-300))], "customer_id int, event_date date")
    ab = spark.createDataFrame([("a", 7, day(-1), 5), ("a", 7, day(0), 6)], "account_id string, customer_id int, balance_date date, capital_balance long")
    assert activity.active_customers(lb, tx, ab, day(5).isoformat()).first()["customers"] == 1


# ---- quality --------------------------------------------------------------------------------


def test_quantiles_are_exact_with_hot_values(spark):
    rnd = np.random.default_rng(1)
    values = np.concatenate([np.full(2000, 7.5), rnd.normal(0, 100, 3000), rnd.integers(-5, 5, 1000)])
    df = spark.createDataFrame([(float(v), float(-v) if i % 3 else None) for i, v in enumerate(values)], "a double, b double")
    probs = [0, 0.1, 0.25, 0.333, 0.5, 0.9, 1]
    got = {r["column"]: r for r in quality.quantiles(df, ["a", "b"], probs).collect()}
    b = np.array([-v for i, v in enumerate(values) if i % 3])
    for p in probs:
        assert abs(got["a"][f"q{round(p * 100)}"] - np.quantile(values, p)) < 1e-9
        assert abs(got["b"][f"q{round(p * 100)}"] - np.quantile(b, p)) < 1e-9


def test_profile_counts(spark):
    df = spark.createDataFrame([("x", 0), ("", 5), (None, 0), ("[NULL]", None)], "s string, n int")
    got = {r["column"]: r for r in quality.profile(df).collect()}
    assert (got["s"]["obs"], got["s"]["missing"], got["s"]["blank"], got["s"]["distinct"]) == (4, 1, 2, 3)
    assert (got["n"]["missing"], got["n"]["zero"], got["n"]["distinct"]) == (1, 2, 2)


def test_profile_counts_columns_by_themselves(spark):
    """No column shares a hash table with the others and no values are sorted; typed values and their texts count alike."""
    df = spark.createDataFrame(
        [(7, Decimal("0.00"), day(3), True, -0.0), (10, Decimal("1.50"), day(3), None, 0.0), (9, None, None, False, float("nan")), (None, Decimal("1.50"), day(5), True, 0.0)],
        "n long, d decimal(9,2), t date, b boolean, f double",
    )
    out = quality.profile(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "Generate" not in plan
    got = {r.column: tuple(r)[1:] for r in out.collect()}
    assert got == {
        "n": (4, 1, 0, 0, 3, "10", "9"), "d": (4, 1, 0, 1, 2, "0.00", "1.50"), "t": (4, 1, 0, 0, 2, str(day(3)), str(day(5))),
        "b": (4, 1, 0, 0, 2, "false", "true"), "f": (4, 0, 0, 3, 3, "-0.0", "NaN"),
    }
    assert quality.profile(df.where("false")).count() == 0


def test_profile_casts_only_what_may_be_zero(spark):
    zeros = ["0", "-0", "+0.", ".0", "00.00", " 0\t", "0\n", "0d", "0.0F", "0e5", "0E-3", "7e-999", "0x0p0", "-0X.0P+3", "0x1p-2000", "0." + "0" * 400 + "1"]
    others = ["", ".", "+", "1", "0.01", "1e0", "1e5", "LD0000000000", "003-0000000", "2019-01-01", "[NULL]", "NaN", "Infinity", "0x", "0 0", "٠", "9" * 400, "0xp1", "00e"]
    df = spark.createDataFrame([(t,) for t in zeros + others], "t string")
    cast = [r.t for r in df.where(F.col("t").try_cast("double") == 0).collect()]
    assert sorted(cast) == sorted(zeros) and quality.profile(df).first().zero == len(zeros)
    assert not df.where(F.col("t").isin("LD0000000000", "003-0000000", "2019-01-01", "", "1", "0.01") & F.col("t").rlike(quality.MAYBE_ZERO)).count()


def test_key_report_ignores_null_parts(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", 1)], "k string, d int")
    got = quality.key_report(df, {"pair": ["k", "d"], "k": ["k"]}).first()
    assert (got["obs"], got["pair"], got["k"]) == (3, 1, 1)


def test_frequency_omits_nulls(spark):
    df = spark.createDataFrame([("a",), (None,), ("a",)], "k string")
    assert rows(quality.proportion(df, ["k"]), "k", "obs", "share") == [("a", 2, 1000000)]


# ---- scalars and reads ----------------------------------------------------------------------


def test_core_dates_and_numbers(spark):
    df = spark.createDataFrame([("20200131",), ("2001311530",), ("2015032",), ("2015400",), ("9912311200",), ("12x",), (None,)], "t string")
    got = [r[0] for r in df.select(F.date_format(S.core_date("t"), "yyyy-MM-dd HH:mm")).collect()]
    assert got == ["2020-01-31 00:00", "2020-01-31 15:30", "2015-02-01 00:00", None, None, None, None]
    nums = spark.createDataFrame([("12x",), ("",), (None,), ("-3.5",)], "t string").select(S.to_number("t")).collect()
    assert [r[0] for r in nums] == [0.0, 0.0, 0.0, -3.5]


def test_scalar_edges(spark):
    r = spark.range(1).select(
        S.ratio(F.lit(1), F.lit(0)).alias("none"),
        S.to_long(F.lit(2.5)).alias("three"),
        S.to_long(F.lit(-2.5)).alias("minus_three"),
        S.clamp(F.lit(None).cast("double"), 0, 1).alias("null_stays"),
        S.months_before(F.lit("2021-08-31").cast("date"), 6).alias("clamped"),
        F.size(S.date_spine(F.lit("2020-02-01").cast("date"), F.lit("2020-01-01").cast("date"), "1 month")).alias("empty"),
        S.whole_days(F.lit("2020-01-01 23:00:00").cast("timestamp"), F.lit("2020-01-02 01:00:00").cast("timestamp")).alias("whole"),
        S.midnights(F.lit("2020-01-01").cast("date"), F.lit("2020-01-02").cast("date")).alias("nights"),
    ).first()
    assert (r.none, r.three, r.minus_three, r.null_stays, r.empty, r.whole, r.nights) == (None, 3, -3, None, 0, 0, 1)
    assert r.clamped == dt.date(2021, 2, 28)


def test_reads_with_permission_and_defaults(spark):
    df = spark.createDataFrame([("Pm1", day(0), "a"), ("PM1", day(1), "b"), ("pm2", day(0), "a")], "portfolio_manager_id string, date date, department_id string")
    assert serving.by_manager_between(df, "pm1", day(0).isoformat()).count() == 1
    both = serving.by_manager_between(df, "pm1", day(0).isoformat(), day(1).isoformat())
    assert [r["date"] for r in both.collect()] == [day(1), day(0)]
    seen = serving.by_manager_between(df, "pm1", day(0).isoformat(), day(1).isoformat(), permission=F.col("department_id") == "a")
    assert seen.count() == 1
    people = spark.createDataFrame([("A_1", "Active", 1), ("AX1", "Active", 1), ("A_2", "Closed", 1)], "customer_id string, status string, version int")
    assert rows(serving.customers(people, "a_"), "customer_id") == [("A_1",)]
    feed = spark.createDataFrame([("1", i) for i in range(5)], "portfolio_manager_id string, date_time int")
    assert [r["date_time"] for r in serving.events_feed(feed, "1", limit=2).collect()] == [3, 2]


def test_allocation_with_one_contract_holding_a_third_of_the_rows(spark):
    rnd = random.Random(8)
    sched = [(0 if i % 3 == 0 else i, i, day(rnd.randrange(300)), rnd.randrange(1, 90), rnd.randrange(9)) for i in range(3000)]
    pay = [(0 if i % 3 == 0 else i, day(rnd.randrange(300)), rnd.randrange(1, 80), "420") for i in range(3000)]
    s = spark.createDataFrame(sched, "contract_id int, instalment int, due_date date, capital_due long, interest_due long")
    p = spark.createDataFrame(pay, "contract_id int, event_date date, amount long, code string")
    got = {r["contract_id"]: r["x"] for r in allocation.event_calculated(s, p).groupBy("contract_id").agg(F.sum("total_paid").alias("x")).collect()}
    due, paid = {}, {}
    for c, _, _, a, b in sched:
        due[c] = due.get(c, 0) + a + b
    for c, _, a, _ in pay:
        paid[c] = paid.get(c, 0) + a
    assert got == {c: min(due[c], paid[c]) for c in due if c in paid}


def test_two_rates_of_a_day_follow_one_rule(spark):
    rates = spark.createDataFrame([("USD", "2024-01-01", 4.0), ("USD", "2024-01-01", 2.0), ("THB", "2024-01-01", 8.0)], "currency string, rate_date string, rate double")
    rows = spark.createDataFrame([(1, "USD", "2024-01-01", 8.0)], "id int, currency string, update_date string, amount double")
    assert [(r.id, r.amount_usd) for r in fx.to_usd(rows, rates, ["amount"]).collect()] == [(1, 32.0)]
    three = fx.to_three(rows, rates, ["amount"], date="update_date").collect()
    assert [(r.amount_khr, r.amount_usd, r.amount_thb) for r in three] == [(2.0, 8.0, 16.0)]
    assert fx.to_three(rows, rates, ["amount"], fixed_date="2024-01-01").collect()[0].amount_thb == 16.0
    assert [(r.currency, r.rates) for r in fx.repeated_rates(rates).collect()] == [("USD", 2)]


def test_a_window_with_a_day_without_rate_has_no_cover(spark):
    day = dt.date(2024, 2, 5)
    due = spark.createDataFrame([(1, "USD", day, 100), (2, "KHR", day, 100)], "customer_id long, currency string, due_date date, amount_due long")
    saved = spark.createDataFrame([(c, day, 1000.0) for c in (1, 2)], "customer_id long, date date, balance_khr double")
    rates = spark.createDataFrame([("USD", dt.date(2024, 2, 1), 1)], "currency string, rate_date date, rate long")
    got = {r.customer_id: r.advance for r in delay.advance_cover(due, saved, rates).collect()}
    assert got[1] is None and got[2] == 1.0


def test_reconciliation_of_both_components_reads_each_table_once(spark, monkeypatch):
    """The final schedule of both components: few scans in all, and the same loans as one component at a time."""
    from microfolio.catalog import base, reconciliation

    def scans(df):
        return df._jdf.queryExecution().executedPlan().toString().count("FileScan")

    src = base.Source(spark, "/root/testdata/sf0.001")
    counted = []

    def counting(df, name):
        counted.append(scans(df))
        return staged(df, name)

    monkeypatch.setattr(reconcile, "staged", counting)
    both = reconciliation._pipelines(src, reconciliation._rules("capital"), reconciliation._rules("interest"))
    final = reconcile.final_schedule(*both)
    assert sum(counted) + scans(final) <= 25
    alone = reconciliation._pipeline(src, "interest")
    names = ["loan_id", "ok1", "ok2", "ok3", "ok", "interest_due"]
    assert rows(both[1].loans, *names) == rows(alone.loans, *names)
    with pytest.raises(ValueError):
        reconciliation._pipelines(src, reconciliation._rules("capital"), reconciliation._rules("capital"))


def test_hot_contract_is_cut_into_blocks(spark):
    """Half of all rows in one contract: settled totals are the intersections of intervals, and no block is large."""
    rng = random.Random(9)
    dues, paid = [], []
    for contract in ["hot"] * 3000 + [f"c{i}" for i in range(300) for _ in range(10)]:
        dues.append((contract, rng.randint(1, 4), day(rng.randint(0, 2400)), rng.randint(1, 900), rng.randint(0, 90)))
        paid.append((contract, day(rng.randint(0, 2400)), rng.randint(1, 1000), rng.choice(["420", "434"])))
    s = spark.createDataFrame(dues, "contract_id string, instalment int, due_date date, capital_due long, interest_due long")
    p = spark.createDataFrame(paid, "contract_id string, event_date date, amount long, code string")
    due, pays = allocation.due_side(s), allocation.paid_side(allocation.daily_payments(p))
    for side, block in ((due, "due_block"), (pays, "paid_block")):
        assert side.groupBy("contract_id", block).count().agg(F.max("count")).first()[0] < 200
    out = allocation.allocate(due, pays)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    alone = [line for line in plan.splitlines() if "Window [" in line and line.rstrip().split("], [")[1].count(",") == 0]
    assert all("block" in line for line in alone)  # only the totals of blocks are ordered by contract alone

    want = {}
    for contract in {d[0] for d in dues}:
        ends, at = [], 0
        amounts = {}
        for _, number, date, capital, interest in (d for d in dues if d[0] == contract):
            amounts[date, number] = amounts.get((date, number), 0) + capital + interest
        for key in sorted(amounts):
            ends.append((at, at + amounts[key], key))
            at += amounts[key]
        at, days = 0, {}
        for _, date, amount, _ in (q for q in paid if q[0] == contract):
            days[date] = days.get(date, 0) + amount
        first = 0
        for date in sorted(days):
            begin, end = at, at + days[date]
            at = end
            while first < len(ends) and ends[first][1] <= begin:
                first += 1
            for lo, hi, (due_date, number) in ends[first:]:
                if lo >= end:
                    break
                want[contract, due_date, number, date] = min(hi, end) - max(lo, begin)
    got = {(r.contract_id, r.due_date, r.instalment, r.event_date): r.total_settled for r in out.collect()}
    assert got == want


def test_quantiles_keep_whole_and_decimal_numbers_exact(spark):
    big = 2**53
    df = spark.createDataFrame([(big + 1,), (big,), (big + 1,), (-(2**62),), (None,)], "x long")
    got = quality.quantiles(df, ["x"], [0, 0.5, 1]).first()
    assert (got.q0, got.q50, got.q100) == (-(2**62), big + Decimal("0.5"), big + 1)
    assert quality.summary(df.where(f"x >= {big}"), ["x"]).first().median == big + 1
    money = spark.createDataFrame([(Decimal("12345678901234567890.01"),), (Decimal("12345678901234567890.03"),)], "m decimal(30,2)")
    assert quality.quantiles(money, ["m"], [0.5]).first().q50 == Decimal("12345678901234567890.02")


def test_quantiles_of_skewed_and_infinite_values(spark):
    rng = random.Random(3)
    values = [10.0 ** rng.randint(-300, 300) for _ in range(9000)] + [float("inf"), float("-inf"), 7.0] * 50 + [7.0] * 9000
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(5)
    got = quality.quantiles(df, ["x"], [0, 0.2, 0.5, 0.75, 1]).first()
    values.sort()
    assert [got.q0, got.q50, got.q100] == [values[0], 7.0, values[-1]]
    assert np.isclose(got.q75, np.quantile(values, 0.75)) and np.isclose(got.q20, np.quantile(values, 0.2))
    empty = quality.quantiles(df.where("false"), ["x"], [0.5]).first()
    assert empty.q50 is None


def test_hot_key_with_all_rows_in_one_hour(spark):
    """Blocks of a running sum follow the rows, not the clock."""
    start = dt.datetime(2024, 5, 1, 10)
    n = 8000
    rows_ = [("hot", start + dt.timedelta(microseconds=k * 400_000), k) for k in range(n)] + [(f"k{k}", start, k) for k in range(100)]
    df = spark.createDataFrame(rows_, "k string, ts timestamp, v long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would share one block
    blocks = windows.in_blocks(df, ["k"], ["ts"])
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in blocks.groupBy("__block").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 2 * np.median(sizes)
    got = {(r.k, r.v): r.cum for r in windows.running_sum(df, ["k"], "ts", {"v": "cum"}).collect()}
    assert all(got["hot", k] == k * (k + 1) // 2 for k in range(n)) and got["k7", 7] == 7
    down = {(r.k, r.v): r.cum for r in windows.running_sum(df, ["k"], "ts", {"v": "cum"}, desc=True).collect()}
    assert all(down["hot", k] == (n - 1) * n // 2 - k * (k - 1) // 2 for k in range(0, n, 97))


def test_ranks_in_a_skewed_group(spark):
    rng = random.Random(8)
    rows_ = [(None if k % 7 == 0 else "hot", rng.randint(0, 50), k, None if k % 3 else k) for k in range(5000)]
    df = spark.createDataFrame(rows_, "k string, a int, id long, v long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = windows.priority_number(df, ["k"], [F.desc("a"), "id"], "v")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    numbered = windows.row_number(got, ["k"], [F.desc("a"), "id"])
    found = {r.id: (r.priority, r.row_no) for r in numbered.collect()}
    for key in (None, "hot"):
        filled = 0
        for place, (_, _, i, v) in enumerate(sorted((r for r in rows_ if r[0] == key), key=lambda r: (-r[1], r[2])), 1):
            filled += v is not None
            assert found[i] == (filled, place)
    assert got.where("k = 'hot'").count() + got.where("k is null").count() == 5000


def test_two_rates_of_a_month_double_nothing(spark):
    rates = spark.createDataFrame([("USD", day(3), 2.0), ("USD", day(20), 4.0), ("USD", day(20), 3.0)], "currency string, rate_date date, rate double")
    bal = spark.createDataFrame([("a", "c", "USD", day(1), 100)], "account_id string, customer_id string, currency string, balance_date date, capital_balance long")
    got = delay.daily_balances(bal, rates, day(1).isoformat(), day(4).isoformat())
    assert rows(got, "date", "balance_khr") == [(day(k), 25.0) for k in range(1, 5)]


def test_cover_days_are_not_expanded(spark):
    """Against a plain walk over days, with months of different rates, ties, and one currency without a rate in a month."""
    rng = random.Random(2)
    rate = {("USD", 1): 0.5, ("USD", 2): 0.25, ("USD", 3): 0.2, ("THB", 1): 4.0, ("THB", 2): 8.0}
    rates = spark.createDataFrame([(c, dt.date(2020, m, 5), r) for (c, m), r in rate.items()], "currency string, rate_date date, rate double")
    ins = [(rng.choice("xy"), rng.choice(["USD", "THB", "KHR"]), day(rng.randint(10, 80)), rng.choice([40, 100, 260])) for _ in range(60)]
    held = {(c, day(k)): rng.choice([0.0, 300.0, 900.0, 4000.0]) for c in "xy" for k in range(0, 90) if k % 5}
    frame = spark.createDataFrame(ins, "customer_id string, currency string, due_date date, amount_due long")
    bal = spark.createDataFrame([(c, d, b) for (c, d), b in held.items()], "customer_id string, date date, balance_khr double")
    cover = delay.advance_cover(frame, bal, rates)

    def khr(i, d):
        return float(i[3]) if i[1] == "KHR" else i[3] / rate[i[1], d.month] if (i[1], d.month) in rate else None

    want = {}
    for start in {(i[0], i[2]) for i in ins}:
        total, known = 0.0, True
        for k in range(-20, 1):
            d = start[1] + dt.timedelta(days=k)
            taken = 0.0
            active = [i for i in ins if i[0] == start[0] and d <= i[2] <= d + dt.timedelta(days=20)]
            for i in sorted(active, key=lambda i: (i[2], -(khr(i, d) or -1e9), i[1], i[3])):
                value = khr(i, d)
                if i[2] == start[1]:
                    known &= value is not None
                    if value:
                        total += min(max(held.get((start[0], d), 0.0) - taken, 0.0) / value, 1.0)
                taken += value or 0.0
        want[start[0], start[1] - dt.timedelta(days=20)] = round(min(total, 20.0), 6) if known else None
    got = {(r.customer_id, r.window_start): None if r.advance is None else round(r.advance, 6) for r in cover.collect()}
    assert got == want and None in want.values()


def test_key_counts_exchange_the_fact_once(spark, monkeypatch):
    df = spark.createDataFrame([(k % 7, k % 3, "1" if k % 2 else None, "2") for k in range(500)], "a int, b int, c string, d string")
    made = []
    monkeypatch.setattr(quality, "staged", lambda frame, name: (made.append(frame), staged(frame, name))[1])
    got = quality.key_report(df, {"fine": ["a", "b", "c"], "pair": ["a", "b"], "one": ["a"], "other": ["c", "d"]}).first()
    assert tuple(got) == (500, 21, 21, 7, 1) and len(made) == 1
    assert made[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert tuple(quality.uniqueness(df, {"a": ["a"], "cd": ["c", "d"]}).first()) == (14000, 4000)
    assert quality.key_report(df.where("false"), {"one": ["a"]}).first().obs == 0


def test_contract_of_a_table(spark):
    """Formats, empty columns, broken rules, missing references, keys and exact measures of hand-made rows."""
    loans = spark.createDataFrame(
        [("LD0123456789", "7", "CLOSED", None, 5), ("LD12", "8", "CLOSED", day(3), 7), (None, "", "ACTIVE", None, 2**53 + 1), ("LD0123456789", "[NULL]", None, None, None)],
        "loan_id string, customer_id string, status string, end_date date, amount long",
    )
    people = spark.createDataFrame([("7",), (None,)], "customer_id string")
    contract = contracts.TableContract(
        formats={"loan_id": "contract_id"}, filled=("customer_id",), rules={"closed ends": "status = 'CLOSED' AND end_date IS NULL"},
        references={"customer_id": ("people", "customer_id")}, keys={"loan": ("loan_id",), "both": ("loan_id", "customer_id")}, measures=("amount",),
    )
    tables, declared = {"loans": loans, "people": people}, {"loans": contract}
    got = rows(contracts.row_report(tables, declared), "rule", "matches", "obs", "share")
    assert got == [("broken closed ends", 1, 4, 250000), ("empty customer_id", 2, 4, 500000), ("format loan_id", 2, 4, 500000)]
    assert rows(contracts.reference_report(tables, declared), "rule", "matches", "obs") == [("customer_id not in people", 3, 4)]
    assert rows(contracts.key_report(tables, declared), "rule", "matches", "obs") == [("both", 3, 4), ("loan", 2, 4)]
    assert contracts.measure_report(tables, declared, [1]).first().q100 == 2**53 + 1
    profile = {r.column: (r.missing, r.blank) for r in contracts.column_report(tables, declared).collect()}
    assert profile["customer_id"] == (0, 2) and profile["status"] == (1, 0)
    empty = {"loans": loans.where("false"), "people": people}
    assert {r.obs for r in contracts.row_report(empty, declared).collect()} == {0}
    assert all(p in {v for c in catalog_contracts.CONTRACTS.values() for v in c.formats.values()} for p in quality.PATTERNS)


# ---- one layout by contract -----------------------------------------------------------------


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_allocation_lays_out_each_side_by_contract_once(spark, monkeypatch):
    from microfolio import session

    rnd = random.Random(1)
    some = lambda n: rnd.choice([None, *range(n)])
    when = lambda: None if rnd.random() < 0.05 else day(rnd.randrange(60))
    dues = [(some(9), some(3), when(), some(40), some(4)) for _ in range(160)]
    pays = [(some(9), when(), some(70), rnd.choice(["420", "423", "434", "900"])) for _ in range(120)]
    s = spark.createDataFrame(dues, "contract_id int, instalment int, due_date date, capital_due long, interest_due long")
    p = spark.createDataFrame(pays, "contract_id int, event_date date, amount long, code string")
    listed = [(c % 7, c, "USD", day(c % 3), 100, "21000") for c in range(9)]  # some loans are listed twice
    loans = spark.createDataFrame(listed, "loan_id int, customer_id int, currency string, disbursement_date date, capital_disbursed_amount int, product_code string")

    def results():
        events = allocation.event_calculated(s, p)
        first = allocation.schedule_instalments(s, loans, p, "2000-01-01", "21050")
        return [events, allocation.shift_capital_decrease(events), allocation.instalment_numbers(first)]

    whole = results()
    assert whole[0].rdd.getNumPartitions() <= 8
    monkeypatch.setattr(session, "ROWS_OF_A_TASK", 10)
    spread = results()
    assert [exchanges(df) for df in spread[:2]] == [4, 4]  # the sums and the layout of each side
    # a part holds 10 rows whatever the session's number of partitions
    assert spread[0].rdd.getNumPartitions() == spread[1].rdd.getNumPartitions() == 16
    monkeypatch.setattr(allocation, "LARGE", 15)  # some contracts are cut into blocks, with and without a layout in parts
    blocks = results()
    monkeypatch.setattr(session, "ROWS_OF_A_TASK", 10**6)
    for a, *others in zip(whole, spread, blocks, results()):
        assert all(sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) for b in others)


def test_time_line_is_laid_out_by_contract_once(spark):
    rnd = random.Random(3)
    update = lambda: rnd.choice([None, day(0), day(1)])
    dues = [(rnd.randrange(12), day(rnd.randrange(90)), update(), rnd.choice([None, 5, 30]), rnd.choice([0, 2])) for _ in range(120)]
    pays = [(c, day(n), 20, 15, 5) for c in range(14) for n in rnd.sample(range(90), 2)]
    sched = spark.createDataFrame(dues, "contract_id int, due_date date, update_date date, capital_due long, interest_due long")
    paid = spark.createDataFrame(pays, "contract_id int, event_date date, total_paid long, capital_paid long, interest_paid long")
    loans = spark.createDataFrame([(c, day(c - 2)) for c in range(14)], "loan_id int, disbursement_date date")
    line = reconcile.events_from_transactions(sched, loans, paid, day(0), day(5), day(80), parts=16)
    chosen = reconcile.assign_due_date(line)
    assert exchanges(chosen) <= 5
    plain = reconcile.assign_due_date(reconcile.events_from_transactions(sched, loans, paid, day(0), day(5), day(80)))
    assert sorted(map(repr, chosen.collect())) == sorted(map(repr, plain.collect()))

    want = {}
    for c in range(2, 12):
        mine = [d for d in dues if d[0] == c]
        several = [d for d in mine if sum(o[2] == d[2] for o in mine) > 1]
        newest = {}
        for d in several:
            if d[2] is not None:
                newest[d[1].replace(day=1)] = max(d[2], newest.get(d[1].replace(day=1), d[2]))
        for d in mine:
            alone = d not in several
            if (alone or d[2] is not None and d[2] == newest.get(d[1].replace(day=1))) and day(5) <= d[1] <= day(80):
                want[c, d[1]] = want.get((c, d[1]), 0) + (d[3] or 0)
    got = {(r.contract_id, r.date): r.capital_due for r in line.where("due_date is not null").collect()}
    assert got == want
    amounts = {(r.contract_id, r.due_date): r.capital_due for r in line.collect()}
    for r in chosen.collect():
        assert r.capital_due == (amounts[r.contract_id, r.due_date] if r.due_date else None)


def test_departments_join_loans_not_payments(spark):
    from microfolio.plans import scoring

    events = spark.createDataFrame([(1, 1, day(9), day(3), 10, 8, 0), (2, 1, day(9), day(4), 5, 5, 1), (3, 1, day(9), day(4), 7, 7, 0)], "contract_id int, instalment int, due_date date, event_date date, total_paid long, capital_paid long, capital_decrease_flag int")
    loans = spark.createDataFrame([(1, 7, "KHR", day(90), "d1", 50), (2, 7, "KHR", day(90), "d2", 60), (3, None, "KHR", day(90), "d1", 1)], "loan_id int, customer_id int, currency string, maturity_date date, department_id string, capital_disbursed_amount long")
    closing = spark.createDataFrame([(1, "CLOSED")], "loan_id int, status string")
    deps = spark.createDataFrame([("d1", "s1"), ("d2", "s2")], "department_id string, department_id_scoring string")
    rates = spark.createDataFrame([("KHR", day(0), 1.0)], "currency string, rate_date date, rate double")
    out = scoring.event_scoring(events, loans, closing, deps, rates, day(0))
    got = {(r.contract_id, r.event_date): (r.customer_id, r.department_id_scoring) for r in out.collect()}
    assert got == {(1, day(3)): (7, "s2"), (2, day(9)): (7, "s2"), (3, day(4)): (None, None)}
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    joins = [(len(line) - len(line.lstrip(" :+-")), line) for line in plan if "Join" in line]
    by_customer = min(depth for depth, line in joins if "customer_id" in line.split("Join", 1)[1])
    assert by_customer > min(depth for depth, line in joins if "contract_id" in line.split("Join", 1)[1])
