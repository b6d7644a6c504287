"""Row filters shared by the reports."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def in_scope(
    start: date | str | None = None,
    end: date | str | None = None,
    brand: str | None = None,
    markets: Sequence[str] | None = None,
    day: str = "visit_start_date",
) -> Column:
    """Inclusive date range, brand and market list; an argument left out filters nothing.

    Plain comparisons on stored columns, so they prune partitions and reach the scan.
    """
    condition = F.lit(True)
    if start is not None:
        condition = condition & (F.col(day) >= F.lit(start).cast("date"))
    if end is not None:
        condition = condition & (F.col(day) <= F.lit(end).cast("date"))
    if brand is not None:
        condition = condition & (F.col("brand") == brand)
    if markets is not None:
        condition = condition & F.col("market_code").isin(*markets)
    return condition
