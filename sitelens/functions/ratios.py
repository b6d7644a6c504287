"""Ratios that return NULL, not an error, over an empty denominator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def percentage(part: Column, whole: Column) -> Column:
    return F.try_divide(part * F.lit(100.0), whole.cast("double"))


def minutes(seconds: Column) -> Column:
    """Seconds to minutes, two decimals."""
    return F.round(seconds / 60, 2)


def two_proportion_z(hits_a: Column, n_a: Column, hits_b: Column, n_b: Column) -> Column:
    """z statistic of rate b against rate a under the pooled rate; NULL where undefined."""
    pooled = ratio(hits_a + hits_b, n_a + n_b)
    spread = F.sqrt(
        pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), n_a.cast("double")) + F.try_divide(F.lit(1.0), n_b.cast("double")))
    )
    return F.try_divide(ratio(hits_b, n_b) - ratio(hits_a, n_a), spread)
