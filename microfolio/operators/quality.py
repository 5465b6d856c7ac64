"""Checks and profiles of input tables. All results are exact.

Distinct keys are counted on the distinct combinations of their columns, which are made once. Order
statistics are found by refining histograms: of each round only the bins that hold a wanted rank are looked into.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import count_if, per_million, zero_if_null
from ..session import staged
from .joins import coverage, keep_in, null_safe_join

BINS = 2048
FEW = 4096
#: All texts whose number may be 0, and few others: zeros, tiny numbers with an exponent or of very many digits. A cast fails slowly on
#: what is no number, so only these are cast.
MAYBE_ZERO = r"^[\x00-\x20]*+[+-]?+([0.]++|[0-9.]++[eE][+-]?+[0-9]++|0[xX][0-9a-fA-F.]++[pP][+-]?+[0-9]++|[0-9.]{300,}+)[fFdD]?+[\x00-\x20]*+$"


# ---- keys, references, rules --------------------------------------------------------------


def key_grain(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct combinations of the columns with their number of rows, as a stage table."""
    return staged(df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n")), "key-grain")


def _distinct_counts(df: DataFrame, keys: dict[str, list[str]], expressions: dict[str, Column]) -> DataFrame:
    """One row: ``obs`` and the number of distinct values other than NULL of each key's expression.

    The fact is exchanged once, reduced to its distinct key columns. A key whose columns all belong to a larger key
    is counted on that key's distinct combinations.
    """
    grains = {frozenset(c for cols in keys.values() for c in cols): None}
    grains = {whole: key_grain(df, sorted(whole)) for whole in grains}
    out = next(iter(grains.values())).agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("obs"))
    for name in sorted(keys, key=lambda k: -len(keys[k])):
        wanted = frozenset(keys[name])
        source = min((g for g in grains if wanted <= g), key=len)
        if wanted not in grains:
            grains[wanted] = grains[source].select(*sorted(wanted)).distinct()
        values = grains[wanted].select(expressions[name].alias("__k")).where("__k is not null").distinct()
        out = out.withColumn(name, values.select(F.count(F.lit(1))).scalar())
    return out.select("obs", *keys)


def key_report(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """Distinct values of each candidate key next to the number of rows.

    A key of several columns is their plain text concatenation; with a NULL part it is not counted.
    """
    return _distinct_counts(
        df, keys, {n: F.col(c[0]) if len(c) == 1 else F.concat(*[F.col(x).cast("string") for x in c]) for n, c in keys.items()}
    )


def uniqueness(df: DataFrame, keys: dict[str, list[str]]) -> DataFrame:
    """Distinct keys per million rows; 1,000,000 means unique. NULL parts count as values."""
    whole = {n: F.struct(*[F.coalesce(F.col(x).cast("string"), F.lit("\u0000")) for x in c]) for n, c in keys.items()}
    counts = _distinct_counts(df, keys, whole)
    return counts.select(*[per_million(n, "obs").alias(n) for n in keys])


def period_share(df: DataFrame, date: str, start, end) -> DataFrame:
    """Rows inside a period, all rows, and the share in millionths."""
    inside = F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    out = df.agg(count_if(inside).alias("inside"), F.count(F.lit(1)).alias("obs"))
    return out.withColumn("share", per_million("inside", "obs"))


def status_by_presence(df: DataFrame, status: str, column: str) -> DataFrame:
    """Rows by status and by whether a column is filled."""
    return df.groupBy(status, F.when(F.col(column).isNull(), 0).otherwise(1).alias("filled")).agg(
        F.count(F.lit(1)).alias("obs")
    )


def differing(a: DataFrame, b: DataFrame, key: str, col_a: str, col_b: str) -> DataFrame:
    """Distinct values of two tables joined on a key where they differ (NULL never differs)."""
    left = a.select(key, F.col(col_a).alias("in_first")).distinct()
    right = b.select(key, F.col(col_b).alias("in_second")).distinct()
    return left.join(right, key, "left").where(F.col("in_first") != F.col("in_second"))


def coverage_report(pairs: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Several coverage checks stacked: check name, found (1 or NULL), number of keys."""
    out = None
    for name, (a, ka, b, kb) in pairs.items():
        part = coverage(a, b, ka, kb).select(F.lit(name).alias("check"), "found", "obs")
        out = part if out is None else out.union(part)
    return out


def rule_report(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows meeting each condition: rule, matches, rows, share in millionths; one scan for all rules."""
    names = list(rules)
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"), *[count_if(rules[n]).alias(f"__r{i}") for i, n in enumerate(names)]
    )
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"__r{i}").alias("matches")) for i, n in enumerate(names)]))
    out = counts.select("__n", rows.alias("x")).select("x.rule", zero_if_null("x.matches").alias("matches"), F.col("__n").alias("obs"))
    return out.withColumn("share", per_million("matches", "obs"))


def format_report(df: DataFrame, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows whose column matches a pattern: {rule name: (column, regular expression)}."""
    return rule_report(df, {n: F.col(c).cast("string").rlike(p) for n, (c, p) in patterns.items()})


# Fixed patterns of ids, codes and amounts.
PATTERNS = {
    "contract_id": "^LD[0-9]{10}$",
    "application_id": "^ICLA[0-9]{10}$",
    "dashed_id": "^[0-9]{3}-[0-9]{7}$",
    "transaction_id": "^[0-9]{15}$",
    "customer_id": "^[0-9]{1,7}$",
    "account_id": "^[0-9]{1,8}$",
    "manager_id": "^[0-9]{1,4}$",
    "account_code": "^[0-9]{4}$",
    "product_code": "^[0-9]{5}$",
    "type_code": "^[0-9]{1,3}$",
    "department_id": "^[A-Z]{3}$",
    "purpose_code": "^[0-9]{1,6}$",
    "amount": "^[0-9]{1,12}[.][0-9]{2}$",
    "short_amount": "^[0-9]{1,8}[.][0-9]{2}$",
    "rate": "^0[.][0-9]{1,4}$",
}


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of keys that occur more than once: counted first, then joined back."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
    return null_safe_join(df, repeated, keys, "inner")


# ---- distributions --------------------------------------------------------------------------


def frequency(df: DataFrame, cols: list[str]) -> DataFrame:
    """Counts per value combination; rows with a NULL in any column are left out."""
    return df.dropna(subset=cols).groupBy(*cols).agg(F.count(F.lit(1)).alias("obs"))


def proportion(df: DataFrame, cols: list[str]) -> DataFrame:
    """Frequencies with their share of all non-NULL rows in millionths (the total is a scalar subquery)."""
    n = df.dropna(subset=cols).select(F.count(F.lit(1))).scalar()
    return frequency(df, cols).withColumn("share", per_million(F.col("obs"), n))


def cross_table(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Two-way table with one output column per listed value."""
    counted = df.dropna(subset=[row, column])
    return counted.groupBy(row).agg(*[count_if(F.col(column) == v).alias(f"n_{v}") for v in values])


def _numbers(df: DataFrame, cols: list[str]) -> tuple[DataFrame, T.DataType]:
    """The columns in one type that holds all their values exactly: decimals for whole and decimal columns, else doubles (NaN counts as missing)."""
    kinds = [df.schema[c].dataType for c in cols]
    if all(isinstance(k, (T.IntegralType, T.DecimalType)) for k in kinds):
        scale = max(k.scale if isinstance(k, T.DecimalType) else 0 for k in kinds)
        kind = T.DecimalType(38, scale)
    else:
        kind = T.DoubleType()
    values = {c: F.col(c).cast(kind) for c in cols}
    if isinstance(kind, T.DoubleType):
        values = {c: F.when(~F.isnan(v), v) for c, v in values.items()}
    return df.select(*[v.alias(c) for c, v in values.items()]), kind


def _order_statistics(df: DataFrame, ranks: dict[str, list[int]], bounds: dict[str, tuple], kind: T.DataType) -> dict[tuple[str, int], object]:
    """The values at the given ranks (0 for the smallest) of each column, exactly.

    Every interval that holds a wanted rank is cut into ``BINS`` bins of equal width by one scan of its rows; the bins that hold
    a wanted rank, narrowed to the smallest and largest value in them, are the intervals of the next scan. Intervals of few
    rows are counted value by value. What reaches the driver per scan is bounded by ``BINS`` or ``FEW`` rows per wanted rank.
    """
    found: dict[tuple[str, int], object] = {}
    # (column, smallest, largest, rank of the smallest, rows)
    active = [(c, *bounds[c], 0, None) for c in ranks if ranks[c]]
    while active:
        rows, cases = [], []
        for i, (c, low, high, _, n) in enumerate(active):
            value, lo, hi = F.col(c), F.lit(low).cast(kind), F.lit(high).cast(kind)
            width = (hi - lo).cast("double")
            share = (value - lo).cast("double") / width
            split = low < high and (n is None or n > FEW)
            number = F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int") if split else F.lit(0)
            single = value if not split else F.lit(None).cast(kind)
            rows.append(F.when(value.between(lo, hi), F.struct(F.lit(i).alias("i"), number.alias("bin"), single.alias("single"), value.alias("value"))))
            cases.append(value.between(lo, hi))
        cells = df.where(reduce(lambda a, b: a | b, cases)).select(F.explode(F.array_compact(F.array(*rows))).alias("x"))
        counts = cells.groupBy("x.i", "x.bin", "x.single").agg(
            F.count(F.lit(1)).alias("n"), F.min("x.value").alias("low"), F.max("x.value").alias("high")
        )
        bins: dict[int, list] = {}
        for r in counts.collect():
            bins.setdefault(r["i"], []).append((r["low"], r["high"], r["n"]))
        further = []
        for i, (c, smallest, largest, start, _) in enumerate(active):
            for low, high, n in sorted(bins[i], key=lambda x: x[0]):
                inside = [k for k in ranks[c] if start <= k < start + n and (c, k) not in found]
                if inside and low == high:
                    found.update({(c, k): low for k in inside})
                elif inside:  # an interval that no bin narrows (infinite ends) is counted value by value
                    further.append((c, low, high, start, 0 if (low, high) == (smallest, largest) else n))
                start += n
        active = further
    return found


def _statistics(df: DataFrame, cols: list[str], probs: list[float]) -> tuple[list[dict], T.DataType]:
    """Per column: rows, filled, minimum, maximum, mean and the quantiles; one scan for the first five."""
    numbers, kind = _numbers(df, cols)
    totals = numbers.agg(
        F.count(F.lit(1)).alias("__n"),
        *[f(c).alias(f"{c}__{k}") for c in cols for k, f in (("filled", F.count), ("low", F.min), ("high", F.max), ("mean", F.avg))],
    ).first()
    out, ranks = [], {}
    for c in cols:
        filled = totals[f"{c}__filled"]
        ranks[c] = sorted({f(Fraction(str(p)) * (filled - 1)) for p in probs for f in (math.floor, math.ceil)}) if filled else []
    values = _order_statistics(numbers, ranks, {c: (totals[f"{c}__low"], totals[f"{c}__high"]) for c in cols}, kind)
    for c in cols:
        filled = totals[f"{c}__filled"]
        row = {"column": c, "minimum": totals[f"{c}__low"], "maximum": totals[f"{c}__high"], "mean": totals[f"{c}__mean"], "missing": totals["__n"] - filled, "filled": filled}
        for p in probs:
            at = Fraction(str(p)) * (filled - 1)
            row[_named(p)] = _between(values, c, at, kind) if filled else None
        out.append(row)
    return out, kind


def _named(p: float) -> str:
    return f"q{round(p * 100)}"


def _between(values: dict, column: str, at: Fraction, kind: T.DataType):
    low, high = values[column, math.floor(at)], values[column, math.ceil(at)]
    part = at - math.floor(at)
    if isinstance(kind, T.DoubleType):
        return low + float(part) * (high - low) if part and low != high else low
    exact = Fraction(low) + part * (Fraction(high) - Fraction(low))
    with localcontext(prec=60):
        return Decimal(exact.numerator) / Decimal(exact.denominator)


def _table(spark: SparkSession, rows: list[dict], names: list[str], kind: T.DataType) -> DataFrame:
    """One row per column; exact numbers as decimals with four more places for what lies between two values."""
    exact = T.DecimalType(38, min(kind.scale + 4, 18)) if isinstance(kind, T.DecimalType) else kind
    types = {"column": T.StringType(), "missing": T.LongType()}
    schema = T.StructType([T.StructField(n, types.get(n, exact)) for n in names])

    def fitted(v):
        if not isinstance(exact, T.DecimalType) or not isinstance(v, Decimal):
            return v
        with localcontext(prec=60):
            return v.quantize(Decimal(1).scaleb(-exact.scale))

    return spark.createDataFrame([tuple(fitted(r[n]) for n in names) for r in rows], schema)


def quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics, one row per column.

    Whole and decimal columns keep their exact values, see ``_order_statistics`` for how ranks are found. A column without
    values has NULLs.
    """
    rows, kind = _statistics(df, cols, probs)
    return _table(df.sparkSession, rows, ["column", *[_named(p) for p in probs]], kind)


def summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """Minimum, quartiles, median, mean, maximum and number of NULLs per numeric column."""
    names = {"q25": "first_quartile", "q50": "median", "q75": "third_quartile"}
    rows, kind = _statistics(df, cols, [0.25, 0.5, 0.75])
    order = ["column", "minimum", *names, "mean", "maximum", "missing"]
    return _table(df.sparkSession, rows, order, kind).withColumnsRenamed(names)


def _value_counts(df: DataFrame, column: str) -> DataFrame:
    """The texts of one column with their number of rows. Types with one text for each value are counted before they become texts."""
    value = F.col(column)
    if not isinstance(df.select(column).schema[0].dataType, (T.IntegralType, T.DecimalType, T.DateType, T.BooleanType)):
        value = value.cast("string")
    counts = df.select(value.alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("value").cast("string").alias("text"), "n")


def profile(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per column: rows, NULL, blank and zero counts, distinct values, smallest and largest text.

    Each column is read by itself and counted per value once; everything else comes from those counts, summed
    without a key, so a task holds values of one column and nothing is sorted. Give stored tables, not costly results.
    """
    text = F.col("text")
    zero = F.when(text.rlike(MAYBE_ZERO), text.try_cast("double") == 0)

    def total(cond):
        return zero_if_null(F.sum(F.when(cond, F.col("n")))).cast("long")

    def report(c):
        return _value_counts(df, c).agg(
            F.sum("n").alias("obs"),
            total(text.isNull()).alias("missing"),
            total(text.isin("", "[NULL]")).alias("blank"),
            total(zero).alias("zero"),
            F.count("text").alias("distinct"),
            F.min("text").alias("smallest"),
            F.max("text").alias("largest"),
        )

    parts = [report(c).select(F.lit(c).alias("column"), "*") for c in cols or df.columns]
    return reduce(DataFrame.union, parts).where("obs > 0")  # a table without rows has no columns to report


# ---- accounts used for repayment -------------------------------------------------------------


def repayment_accounts(events: DataFrame, loans: DataFrame, balances: DataFrame, since) -> DataFrame:
    """Contracts with payments, their repayment account and whether it has balances (1 or NULL)."""
    paid = events.select("contract_id").distinct()
    target = loans.where(F.col("disbursement_date") >= F.lit(since).cast("date")).select(
        F.col("loan_id").alias("contract_id"), F.col("repayment_account_id").alias("account_id")
    )
    known = balances.select("account_id").distinct().withColumn("in_balances", F.lit(1))
    return paid.join(target, "contract_id").distinct().join(known, "account_id", "left")


def currency_agreement(events: DataFrame, loans: DataFrame, balances: DataFrame, since) -> DataFrame:
    """Contracts by payment currency and currency of the repayment account."""
    paid = events.select("contract_id", "currency").distinct()
    target = loans.where(F.col("disbursement_date") >= F.lit(since).cast("date")).select(
        F.col("loan_id").alias("contract_id"), F.col("repayment_account_id").alias("account_id")
    )
    known = balances.select("account_id", F.col("currency").alias("account_currency")).distinct()
    rows = paid.join(target, "contract_id").distinct().join(known, "account_id")
    return rows.groupBy("currency", "account_currency").agg(F.count(F.lit(1)).alias("obs"))


def balance_against_payment(events: DataFrame, loans: DataFrame, balances: DataFrame, contracts: DataFrame) -> DataFrame:
    """Account balance next to the day's payments, for payments of the listed contracts.

    Days with a balance but no payment have no contract and so drop out, as in the original
    full join followed by an inner one; only the payment side is kept and balances are looked up.
    """
    paid = events.groupBy("contract_id", "customer_id", F.col("event_date").alias("date")).agg(
        F.sum("amount").alias("amount_paid")
    )
    paid = paid.join(contracts.select("contract_id").distinct(), "contract_id", "left_semi")
    accounts = loans.select(F.col("loan_id").alias("contract_id"), F.col("repayment_account_id").alias("account_id"))
    levels = balances.select("account_id", F.col("balance_date").alias("date"), "capital_balance")
    return paid.join(accounts, "contract_id", "left").join(levels, ["account_id", "date"], "left")


def repayment_share(
    loan_balances: DataFrame, loans: DataFrame, accounts: DataFrame, latest: DataFrame, rates: DataFrame
) -> DataFrame:
    """Accounts of customers with outstanding loans: how many, and how much money, serve repayments.

    ``latest``: newest balance per account (account_id, currency, capital_balance); amounts are
    divided by the rate of their currency, KHR by 1. Result per account code and type.
    """
    borrowers = loan_balances.where(F.col("principal_outstanding") > 0).select("customer_id").distinct()
    used = (
        loans.join(
            loan_balances.where(F.col("principal_outstanding") > 0).select("loan_id").distinct(), "loan_id", "left_semi"
        )
        .select(F.col("repayment_account_id").alias("account_id"), F.col("customer_id").alias("__owner"))
        .distinct()
        .withColumn("used", F.lit(1))
    )
    rows = (
        accounts.join(borrowers, "customer_id", "left_semi")
        .join(latest.select("account_id", "capital_balance"), "account_id")
        .join(used, (accounts["account_id"] == used["account_id"]) & (F.col("customer_id") == F.col("__owner")), "left")
        .drop(used["account_id"])
        .drop("__owner")
    )
    rate = rates.select(F.col("currency").alias("__ccy"), "rate")
    rows = rows.join(rate, F.col("currency") == F.col("__ccy"), "left")
    khr = F.col("capital_balance") / F.when(F.col("currency") == "KHR", F.lit(1)).otherwise(F.col("rate"))
    repay = F.col("used") > 0
    out = rows.groupBy("account_code", "account_type").agg(
        F.count(F.lit(1)).alias("accounts"),
        F.sum("used").alias("repayment_accounts"),
        F.sum(khr).alias("balance"),
        F.sum(F.when(repay, khr).otherwise(0)).alias("repayment_balance"),
    )
    return out.withColumns(
        {
            "accounts_percent": F.try_divide(F.col("repayment_accounts") * 100, F.col("accounts")),
            "balance_percent": F.try_divide(F.col("repayment_balance") * 100, F.col("balance")),
        }
    )


# ---- applications and written-off loans -------------------------------------------------------


def disbursed_not_in_loans(applications: DataFrame, loans: DataFrame) -> DataFrame:
    """Disbursed applications with a loan id that the loan table does not have."""
    disbursed = applications.where((F.col("stage") == "Disbursed") & F.col("loan_id").isNotNull())
    return keep_in(disbursed, loans, "loan_id", negate=True)


def contracts_without_application(events: DataFrame, applications: DataFrame) -> DataFrame:
    """Contracts with events but no disbursed application."""
    disbursed = applications.where(F.col("stage") == "Disbursed").select(F.col("loan_id").alias("contract_id"))
    return keep_in(events.select("contract_id").distinct(), disbursed, "contract_id", negate=True)


def written_off_status(balances: DataFrame, written_off: DataFrame) -> DataFrame:
    """Balance rows of written-off loans by status."""
    return keep_in(balances, written_off, "loan_id").groupBy("status").agg(F.count(F.lit(1)).alias("obs"))
