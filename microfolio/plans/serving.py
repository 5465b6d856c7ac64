"""Parameterised reads over the published marts.

Parameters become literals of the plan, so filters reach the file scan; the caller's permission,
when there is one, is one more condition joined to the others with AND.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import has_text, same_text


def permitted(df: DataFrame, permission: Column | None, check: bool = True) -> DataFrame:
    """Row-level permission; no condition when the caller has none or the check is off."""
    return df if permission is None or not check else df.where(permission)


def by_manager_between(
    df: DataFrame, manager: str, start, end=None, date: str = "date", permission: Column | None = None
) -> DataFrame:
    """Rows of a manager in a closed range of days, newest first; the end defaults to the start."""
    start, end = F.lit(start).cast("date"), F.lit(end if end is not None else start).cast("date")
    rows = permitted(df, permission).where(same_text("portfolio_manager_id", F.lit(manager)))
    return rows.where(F.col(date).between(start, end)).orderBy(F.col(date).desc())


def by_manager_on(
    df: DataFrame, manager: str, date=None, date_col: str = "update_date", permission: Column | None = None
) -> DataFrame:
    """Rows of a manager on one day, today by default."""
    day = F.current_date() if date is None else F.lit(date).cast("date")
    return permitted(df, permission).where(same_text("portfolio_manager_id", F.lit(manager)) & (F.col(date_col) == day))


def customers(df: DataFrame, contains: str | None = None, permission: Column | None = None) -> DataFrame:
    """Ids of active current customers, optionally those containing a text."""
    rows = permitted(df, permission).where((F.col("status") == "Active") & (F.col("version") == 1))
    if contains is not None:
        rows = rows.where(has_text(F.col("customer_id").cast("string"), contains))
    return rows.select("customer_id")


def events_feed(
    df: DataFrame,
    manager: str,
    limit: int = 100,
    offset: int = 1,
    when: str = "date_time",
    tiebreak: tuple[str, ...] = (),
    permission: Column | None = None,
) -> DataFrame:
    """A page of a manager's events, newest first. The default offset of 1 skips the newest one."""
    rows = permitted(df, permission).where(same_text("portfolio_manager_id", F.lit(manager)))
    return rows.orderBy(F.col(when).desc(), *[F.col(c).desc() for c in tiebreak]).offset(offset).limit(limit)


def hierarchy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Current, active portfolio managers. Not subject to row permissions."""
    return df.where((F.col("version") == 1) & (F.col("manager_status") == "Active")).select(*columns)


def repayment_schedule(df: DataFrame, customer, permission: Column | None = None) -> DataFrame:
    """Instalments and payments of one customer."""
    return permitted(df, permission).where(F.col("customer_id") == F.lit(customer))
