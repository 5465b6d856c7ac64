"""Currency conversion. Rates join on currency and day; the rate table is an ordinary join side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TARGETS = ("USD", "THB")


def one_rate(rates: DataFrame) -> DataFrame:
    """One row per currency and day: of several rates the largest one.

    Both conversions use it, so a rate loaded twice neither doubles rows nor stops a job; versions are
    to be reduced before, see ``usd_rates``, and ``repeated_rates`` lists what is left.
    """
    return rates.groupBy("currency", F.col("rate_date").cast("date").alias("rate_date")).agg(F.max("rate").alias("rate"))


def repeated_rates(rates: DataFrame) -> DataFrame:
    """Currency and day pairs with more than one rate, with their number."""
    day = F.col("rate_date").cast("date").alias("rate_date")
    return rates.groupBy("currency", day).agg(F.count(F.lit(1)).alias("rates")).where("rates > 1")


def usd_rates(currency: DataFrame) -> DataFrame:
    """Rates to USD (currency, rate_date, rate) out of the newest versions of base and quote pairs."""
    return currency.where(F.col("quote") == "USD").select(F.col("base").alias("currency"), "rate_date", "rate")


def to_usd(
    df: DataFrame,
    rates: DataFrame,
    amounts: list[str],
    currency: str = "currency",
    date: str = "update_date",
    suffix: str = "_usd",
) -> DataFrame:
    """Add amounts in USD at the rate of the given day; a missing rate counts as 1.

    ``rates``: currency, rate_date, rate, reduced by ``one_rate``.
    """
    r = one_rate(rates).select(
        F.col("currency").alias("__ccy"), F.col("rate_date").cast("date").alias("__day"), F.col("rate").alias("__rate")
    )
    out = df.join(r, (F.col(currency) == F.col("__ccy")) & (F.col(date).cast("date") == F.col("__day")), "left")
    rate = F.coalesce(F.col("__rate"), F.lit(1))
    return out.withColumns({a + suffix: F.col(a) * rate for a in amounts}).drop("__ccy", "__day", "__rate")


def to_three(
    df: DataFrame,
    rates: DataFrame,
    amounts: list[str],
    currency: str = "currency",
    date: str | None = None,
    fixed_date=None,
    round_khr: bool = False,
) -> DataFrame:
    """Add amounts in KHR, USD and THB, with KHR as pivot.

    KHR = amount / rate of its currency; USD and THB are the amount itself where it already is
    in that currency, else KHR * rate of the target. Rates are those of ``date`` per row, or of
    one ``fixed_date``. No default: a missing rate gives NULL. ``round_khr`` rounds the KHR
    amount half away from zero before it is converted on.

    The rates are reduced by ``one_rate``. Those of the two targets become columns of one row per
    day by conditional maxima; a row's own rate joins on currency and day.
    """
    wanted = rates.where(F.col("rate_date") == F.lit(fixed_date).cast("date")) if fixed_date is not None else rates
    wanted = one_rate(wanted).withColumn("rate", F.col("rate").cast("double"))
    targets = wanted.groupBy(F.col("rate_date").alias("__day")).agg(
        *(F.max(F.when(F.col("currency") == code, F.col("rate"))).alias(f"__{code}") for code in TARGETS)
    )
    owns = wanted.select(F.col("currency").alias("__ccy"), F.col("rate_date").alias("__own_day"), F.col("rate").alias("__own"))
    day = F.lit(fixed_date).cast("date") if fixed_date is not None else F.col(date).cast("date")
    out = df.join(owns, (F.col(currency) == F.col("__ccy")) & (day == F.col("__own_day")), "left")
    if fixed_date is not None:
        out = out.withColumns({f"__{code}": targets.select(f"__{code}").scalar() for code in TARGETS})
    else:
        out = out.join(targets, day == F.col("__day"), "left").drop("__day")
    own = F.col("__own")
    for a in amounts:
        khr = F.col(a).cast("double") / F.when(own != 0, own)
        out = out.withColumn(a + "_khr", F.round(khr).cast("long") if round_khr else khr)
        for code in TARGETS:
            converted = F.when(F.col(currency) == code, F.col(a).cast("double")).otherwise(F.col(a + "_khr") * F.col(f"__{code}"))
            out = out.withColumn(f"{a}_{code.lower()}", converted)
    return out.drop("__ccy", "__own_day", "__own", *(f"__{code}" for code in TARGETS))


def month_rates(rates: DataFrame) -> DataFrame:
    """One rate per currency, year and month for month-wise joins: that of the month's last day with a rate.

    Several rates of that day are reduced by ``one_rate`` before, so a month never gives a row twice.
    """
    month = [F.year("rate_date").alias("year"), F.month("rate_date").alias("month")]
    return one_rate(rates).groupBy("currency", *month).agg(F.max_by("rate", "rate_date").alias("month_rate"))


def to_khr_by_month(df: DataFrame, rates: DataFrame, amount: str, date: str, out: str) -> DataFrame:
    """KHR amount at the rate of the row's month (KHR itself unchanged, missing rate NULL)."""
    m = month_rates(rates).withColumnRenamed("currency", "__ccy")
    joined = df.join(
        m, (F.col("currency") == F.col("__ccy")) & (F.year(date) == F.col("year")) & (F.month(date) == F.col("month")), "left"
    )
    value = F.when(F.col("currency") == "KHR", F.col(amount).cast("double")).otherwise(
        F.col(amount).cast("double") / F.col("month_rate")
    )
    return joined.withColumn(out, value).drop("__ccy", "year", "month", "month_rate")
