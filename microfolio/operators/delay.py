"""Payment behaviour: weighted delay, savings cover before the due date, final score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import clamp, month_of, ratio
from .fx import to_khr_by_month


def weighted_delay(events: DataFrame, run_date, keys: list[str] | None = None) -> DataFrame:
    """Delay per instalment in days, weighted by the share of the amount due paid on each day.

    Every event counts max(0, days * paid / due). If the last event leaves a rest, the rest counts
    up to the run date on top of that event. An instalment without payment counts its
    full delay. Result rounded to 4 digits.

    The rest after the last event is due minus everything paid, so this is one aggregation
    per instalment; numerators are summed before the single division by the amount due. The last
    event is the one with the latest date, the larger payment on equal dates.
    """
    keys = keys or ["customer_id", "contract_id", "currency", "instalment_number", "due_date", "amount_due"]
    day = F.lit(run_date).cast("date")
    weight = F.datediff("event_date", "due_date") * F.col("paid_amount")
    sums = events.groupBy(*keys).agg(
        F.sum(F.when(weight.isNotNull(), F.greatest(weight, F.lit(0)))).alias("__all"),
        F.max(F.when(weight.isNotNull(), F.struct("event_date", "paid_amount"))).alias("__last"),
        F.sum("paid_amount").alias("__paid"),
    )
    last = F.datediff(F.col("__last.event_date"), F.col("due_date")) * F.col("__last.paid_amount")
    rest = F.greatest(F.col("amount_due") - F.col("__paid"), F.lit(0))
    total = (
        F.col("__all")
        - F.greatest(last, F.lit(0))
        + F.greatest(last + F.datediff(day, F.col("due_date")) * rest, F.lit(0))
    )
    delay = F.round(ratio(total.cast("double"), F.col("amount_due").cast("double")), 4)
    unpaid = F.when(F.col("due_date") < day, F.datediff(day, F.col("due_date")).cast("double"))
    return sums.select(*keys, F.coalesce(delay, unpaid).alias("delay"))


def daily_balances(
    balances: DataFrame, rates: DataFrame, start, end, amount: str = "capital_balance", date: str = "balance_date"
) -> DataFrame:
    """Savings in KHR per customer and day: each account's last balance holds until its next one.

    Accounts count from their first balance inside [start, end]. A day on which one account of a
    customer cannot be converted counts 0. Gaps are filled by exploding the span up to the next
    balance, which needs neither a calendar join nor a fill window.
    """
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = balances.where(F.col(date).between(lo, hi))
    w = Window.partitionBy("account_id").orderBy(date)
    spans = inside.withColumn("__to", F.coalesce(F.date_sub(F.lead(date).over(w), 1), hi))
    days = spans.where(F.col("__to") >= F.col(date)).select(
        "customer_id", "currency", amount, F.explode(F.sequence(F.col(date), F.col("__to"))).alias("date")
    )
    khr = to_khr_by_month(days, rates, amount, "date", "__khr")
    return khr.groupBy("customer_id", "date").agg(
        F.when(F.count_if(F.col("__khr").isNull()) > 0, F.lit(0.0)).otherwise(F.sum("__khr")).alias("balance_khr")
    )


def advance_cover(instalments: DataFrame, balances: DataFrame, rates: DataFrame, n_days: int = 20) -> DataFrame:
    """How far savings covered instalments in the days before they were due.

    For every day from due - n_days to due, the balance left after instalments of higher priority
    (earlier due date, then larger amount) over the amount, limited to [0, 1]; summed per customer
    and window start and capped at n_days. ``instalments`` are those paid without delay.

    A window with a day that has no rate has no cover (NULL), so it leaves the score alone. An instalment that cannot be
    converted takes nothing from those behind it.

    Equal instalments of a customer are counted first: n copies of amount a covered by a rest r
    sum to min(n, r / a), so no copy is expanded. Nor are days: a window is one row for each month it touches, as rates
    hold for a month. Of a day's higher priorities, those of the own due date are a running sum, and those due
    before are the due dates from that day on, which the row carries as a list (n_days entries at most) next to the
    balances of its month; the days are summed inside the row.
    """
    grain = instalments.groupBy("customer_id", "currency", "due_date", "amount_due").agg(F.count(F.lit(1)).alias("n"))
    window_start = F.date_sub("due_date", n_days)
    months = F.sequence(month_of(window_start), month_of("due_date"), F.expr("interval 1 month"))
    spans = grain.withColumn("window_start", window_start).withColumn("month_start", F.explode(months))
    spans = spans.withColumns({"from": F.greatest("window_start", "month_start"), "to": F.least("due_date", F.last_day("month_start"))})
    khr = to_khr_by_month(spans, rates, "amount_due", "month_start", "khr")

    same = ["customer_id", "month_start", "due_date"]
    ahead = (
        Window.partitionBy(*same).orderBy(F.col("khr").desc(), "currency", "amount_due")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    khr = khr.withColumn("ahead", F.coalesce(F.sum(F.col("n") * F.col("khr")).over(ahead), F.lit(0.0)))
    due = khr.groupBy(*same).agg(F.coalesce(F.sum(F.col("n") * F.col("khr")), F.lit(0.0)).alias("due_khr"))
    before = Window.partitionBy("customer_id", "month_start").orderBy(F.unix_date("due_date")).rangeBetween(-n_days, -1)
    due = due.select(*same, F.collect_list(F.struct("due_date", "due_khr")).over(before).alias("earlier"))
    held = balances.groupBy("customer_id", month_of("date").alias("month_start")).agg(
        F.map_from_entries(F.collect_list(F.struct("date", "balance_khr"))).alias("held")
    )  # one entry per day of the month
    rows = khr.join(due, same).join(held, ["customer_id", "month_start"], "left")

    def covered(day: Column) -> Column:
        still_due = F.filter("earlier", lambda e: e["due_date"] >= day)
        taken = F.aggregate(still_due, F.col("ahead"), lambda total, e: total + e["due_khr"])
        rest = F.greatest(F.coalesce(F.element_at("held", day), F.lit(0.0)) - taken, F.lit(0.0))
        return F.when(F.col("khr") > 0, F.least(F.col("n").cast("double"), rest / F.col("khr"))).otherwise(0.0)

    days = F.transform(F.sequence("from", "to"), covered)
    rows = rows.withColumn("cover", F.aggregate(days, F.lit(0.0), lambda total, c: total + c))
    known = F.count_if(F.col("khr").isNull()) == 0
    return rows.groupBy("customer_id", "window_start").agg(
        F.when(known, F.least(F.sum("cover"), F.lit(float(n_days)))).alias("advance")
    )


def payment_score(delays: DataFrame, cover: DataFrame, n_days: int = 20, highest: int = 30) -> DataFrame:
    """Final score: the delay, or minus the advance cover where there was none; within [-n_days, highest].

    Adds the truncated form that is never negative.
    """
    out = delays.withColumn("window_start", F.date_sub("due_date", n_days)).join(
        cover, ["customer_id", "window_start"], "left"
    )
    score = F.when(F.col("advance").isNotNull() & (F.col("delay") == 0), -F.col("advance")).otherwise(F.col("delay"))
    out = out.withColumn("score", clamp(score, float(-n_days), float(highest)))
    return out.withColumn("truncated_score", F.greatest(F.col("score"), F.lit(0.0))).drop("advance")
