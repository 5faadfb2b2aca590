"""Normal quantile/CDF and correlation as plain column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients (Acklam) of the rational approximation of the
# standard normal quantile; absolute error below 5e-9 on (0, 1).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
         1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
         6.680131188771972e01, -1.328068155288572e01)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
         -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
         3.754408661907416e00)
PPF_LOW = 0.02425

# Abramowitz & Stegun 26.2.17, absolute error below 7.5e-8.
CDF_P = 0.2316419
CDF_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def _horner(coef: Sequence[float], x: Column) -> Column:
    acc = F.lit(coef[0])
    for c in coef[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    tail_lo = F.sqrt(F.lit(-2.0) * F.log(p))
    tail_hi = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    q = p - F.lit(0.5)
    r = q * q
    centre = _horner(PPF_A, r) * q / _horner((*PPF_B, 1.0), r)
    low = _horner(PPF_C, tail_lo) / _horner((*PPF_D, 1.0), tail_lo)
    high = -_horner(PPF_C, tail_hi) / _horner((*PPF_D, 1.0), tail_hi)
    return (F.when(p < F.lit(PPF_LOW), low)
            .when(p > F.lit(1.0 - PPF_LOW), high)
            .otherwise(centre))


def norm_cdf(x: Column) -> Column:
    a = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(CDF_P) * a)
    tail = (F.lit(1.0 / math.sqrt(2.0 * math.pi)) * F.exp(F.lit(-0.5) * a * a)
            * t * _horner(tuple(reversed(CDF_B)), t))
    return F.when(x >= F.lit(0.0), F.lit(1.0) - tail).otherwise(tail)


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson aggregate over rows where both are present; null when either does not vary (the
    built-in ``corr`` divides by zero there in ANSI mode)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
