"""The normal distribution in column expressions: quantile and upper tail."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximation of the quantile (relative error 1.2e-9).
CENTRE_OVER = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
CENTRE_UNDER = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_OVER = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL_BELOW = 0.02425
# Chebyshev coefficients of the complementary error function (relative error 1.2e-7).
ERFC = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    """Highest power first."""
    return reduce(lambda done, c: done * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def quantile(p: Column) -> Column:
    """The value that a standard normal falls below with chance ``p``; NULL outside (0, 1)."""
    q = p - 0.5
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    centre = _polynomial(CENTRE_OVER, q * q) * q / _polynomial(CENTRE_UNDER, q * q)
    tail = _polynomial(TAIL_OVER, t) / _polynomial(TAIL_UNDER, t)
    inside = (p > 0) & (p < 1)
    return F.when(inside & (F.abs(q) <= 0.5 - TAIL_BELOW), centre).when(inside, F.when(q < 0, tail).otherwise(-tail))


def upper_tail(z: Column) -> Column:
    """The chance of a standard normal above ``z``."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    half = t * F.exp(-x * x + _polynomial(ERFC, t)) / 2
    return F.when(z >= 0, half).otherwise(1 - half)
