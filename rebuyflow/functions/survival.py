"""Survival arithmetic on log scale."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


# Coefficients of a published rational fit of the complementary error function (relative error 1.2e-7).
ERFC_FIT = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def log_normal_tail(z: Column) -> Column:
    """log P(Z > z) for a standard normal, as plain arithmetic; the logarithm is formed before anything can underflow."""
    a = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * a)
    fit = F.lit(ERFC_FIT[-1])
    for c in reversed(ERFC_FIT[:-1]):
        fit = F.lit(c) + t * fit
    far = F.log(t) - a * a + fit
    return F.when(z >= 0, far).otherwise(F.log(2 - F.exp(far))) - math.log(2)


def aft_log_survival(margin: Column, days: Column, distribution: str, scale: float | Column) -> Column:
    """log S(days) of an accelerated-failure-time model whose log-time location is `margin`; a scale may differ by row."""
    if not isinstance(scale, Column):
        if not scale > 0:
            raise ValueError("Scale must be positive")
        scale = F.lit(float(scale))
    z = (F.log(F.nullif(days.cast("double"), F.lit(0.0))) - margin) / scale
    if distribution == "logistic":
        # -log(1 + e^z) without overflow for large z.
        value = -(F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))))
    elif distribution == "normal":
        value = log_normal_tail(z)
    elif distribution == "weibull":
        value = -F.exp(z)
    else:
        raise ValueError("Unsupported distribution")
    return F.when(days == 0, F.lit(0.0)).otherwise(value)


def conditional_probability(log_start: Column, log_end: Column) -> Column:
    """P(event by end | at risk at start) = 1 - S(end)/S(start), kept within 0..1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), -F.expm1(log_end - log_start)))
