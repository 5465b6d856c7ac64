"""Scalar expressions. Everything is a native Column expression; there is no Python UDF."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that results depend on -------------------------------------------------
CAPITAL_CODES = ("420", "423", "750")
INTEREST_CODES = ("434", "751")
PENALTY_CODES = ("752",)
CAPITAL_DECREASE_CODE = "423"
PAYMENT_CODES = ("420", "423", "434", "750", "751")
PAYMENT_AND_PENALTY_CODES = ("420", "423", "434", "750", "751", "752")
SAVINGS_CREDIT_CODE = "213"
STAFF_PRODUCTS = ("21056", "3900")
STAFF_PRODUCTS_FIRST = ("21056",)
GROUP_PRODUCT = "21050"
TOLERANCES = {"USD": 0.1, "THB": 1.0, "KHR": 100.0}
PAR_DAYS = (0, 7, 30, 60, 120)
# -------------------------------------------------------------------------------------------


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_if_null(c) -> Column:
    return F.coalesce(col(c), F.lit(0))


def to_long(c) -> Column:
    """Round half away from zero, then to a 64-bit integer (a plain cast would truncate)."""
    return F.round(col(c)).cast("long")


def round_half_even(c, digits: int = 0) -> Column:
    """Round with ties going to the even neighbour."""
    return F.bround(col(c), digits)


def ratio(num, den) -> Column:
    """Quotient; NULL where the divisor is 0."""
    return F.try_divide(col(num), col(den))


def per_million(num, den) -> Column:
    """A ratio of two integers as a whole number of millionths (rounded down), exact in any engine."""
    n, d = col(num).cast("decimal(38,0)"), col(den).cast("decimal(38,0)")
    return F.floor(F.try_divide(n * F.lit(1000000), F.when(d > 0, d))).cast("long")


def clamp(c, lo, hi) -> Column:
    """Limit to [lo, hi]; NULL stays NULL."""
    c = col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(lo)), F.lit(hi)))


def to_number(c) -> Column:
    """Text to double; what does not parse, and NULL, becomes 0."""
    return F.coalesce(col(c).try_cast("double"), F.lit(0.0))


def blank_to_null(c) -> Column:
    """The text null marker and the empty string become NULL."""
    c = col(c)
    return F.when(~c.isin("[NULL]", ""), c)


def core_date(c) -> Column:
    """Core-banking date text to a timestamp, decided row by row.

    8 digits are yyyyMMdd; 10 characters not starting with 9 are yyMMddHHmm of this century;
    7 digits are a year and a day of the year up to 366. Anything else is NULL.
    """
    c = col(c)
    n = F.length(c)
    return (
        F.when(n == 8, F.try_to_timestamp(c, F.lit("yyyyMMdd")))
        .when(
            (n == 10) & (F.substring(c, 1, 1) != "9"),
            F.try_to_timestamp(F.concat(F.lit("20"), c), F.lit("yyyyMMddHHmm")),
        )
        .when(
            (n == 7) & (F.substring(c, 5, 3).try_cast("int") <= 366),
            F.try_to_timestamp(c, F.lit("yyyyDDD")),
        )
    )


def slash_date(c) -> Column:
    """dd/MM/yyyy at the start of a text to a date."""
    return F.try_to_timestamp(F.substring(col(c), 1, 10), F.lit("dd/MM/yyyy")).cast("date")


def month_of(c) -> Column:
    """First day of the month as a date."""
    return F.trunc(col(c), "MM")


def months_before(d, n: int) -> Column:
    """The same day n months earlier, clamped to the month's end."""
    return F.add_months(d, -n)


def whole_days(start, end) -> Column:
    """Completed 24-hour spans between two timestamps."""
    return F.timestamp_diff("DAY", col(start), col(end))


def midnights(start, end) -> Column:
    """Calendar days between two dates or timestamps."""
    return F.datediff(col(end), col(start))


def date_spine(start, end, step: str) -> Column:
    """Array of dates from start to end; empty where the bounds descend, NULL where one is NULL."""
    s, e = col(start), col(end)
    empty = F.array().cast("array<date>")
    return F.when(s <= e, F.sequence(s, e, F.expr(f"interval {step}"))).when(s > e, empty)


def same_text(a, b) -> Column:
    return F.lower(col(a)) == F.lower(col(b))


def has_text(c, part) -> Column:
    """Case-insensitive contains; the searched part is taken literally."""
    return F.contains(F.lower(col(c)), F.lower(part if isinstance(part, Column) else F.lit(part)))


def sum_if(cond: Column, amount) -> Column:
    return F.sum(F.when(cond, col(amount)).otherwise(0))


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("long")


def largest(*cs) -> Column:
    return F.greatest(*[col(c) for c in cs])


def classify(diff, currency, tolerances=None, scale=1, codes=(-1, 0, 1)) -> Column:
    """Currency-specific three-way test of a difference.

    ``codes`` are the values for below, within and above the tolerance; a currency without
    a tolerance, and a NULL difference, count as within. ``scale`` turns the tolerance into
    the unit of the amounts (100 for cents).
    """
    below, within, above = codes
    limit = tolerance_of(currency, tolerances, scale)
    d = col(diff)
    return F.when(d > limit, F.lit(above)).when(d < -limit, F.lit(below)).otherwise(F.lit(within))


def tolerance_of(currency, tolerances=None, scale=1) -> Column:
    """The tolerance of a currency in the unit of the amounts; NULL for other currencies."""
    tolerances = tolerances or TOLERANCES
    out = None
    for code, value in tolerances.items():
        v = value * scale
        v = F.lit(int(v)) if float(v).is_integer() else F.lit(float(v))
        hit = col(currency) == code
        out = F.when(hit, v) if out is None else out.when(hit, v)
    return out
