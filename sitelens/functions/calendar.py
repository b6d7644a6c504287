"""Calendar periods. Weeks start on Sunday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_start(day: Column) -> Column:
    """The Sunday on or before ``day``; Spark's own week truncation is Monday-based."""
    return F.date_sub(day, F.dayofweek(day) - 1)


def period_start(day: Column, grain: str) -> Column:
    """First date of the day, week or month that ``day`` falls in."""
    if grain == "day":
        return day
    if grain == "week":
        return week_start(day)
    if grain == "month":
        return F.trunc(day, "month").cast("date")
    raise ValueError(f"unknown grain: {grain}")


def period_end(start: Column, grain: str) -> Column:
    """Last date of the period that begins at ``start``."""
    if grain == "day":
        return start
    if grain == "week":
        return F.date_add(start, 6)
    if grain == "month":
        return F.last_day(start)
    raise ValueError(f"unknown grain: {grain}")


def period_id(start: Column, grain: str) -> Column:
    """YYYYMM for months, YYYYMMDD of the first date otherwise."""
    pattern = "yyyyMM" if grain == "month" else "yyyyMMdd"
    return F.date_format(start, pattern).cast("int")
