"""The normal and F distributions, without a statistics library: columns for plans, floats for the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

_NORMAL = NormalDist()


def normal_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def normal_ppf(p: float) -> float:
    return _NORMAL.inv_cdf(p)


#: Terms of the complementary error function's rational form (relative error under 1.2e-7).
ERFC_TERMS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_cdf_sql(x: str) -> str:
    """The distribution function as SQL text, the same in every engine."""
    z = f"(abs({x}) / sqrt(2e0))"
    t = f"(1e0 / (1e0 + 0.5e0 * {z}))"
    poly = f"{ERFC_TERMS[-1]}e0"
    for c in reversed(ERFC_TERMS[:-1]):
        poly = f"({c}e0 + {t} * {poly})"
    erfc = f"({t} * exp(-{z} * {z} + {poly}))"
    return f"(CASE WHEN {x} >= 0e0 THEN 1e0 - 0.5e0 * {erfc} ELSE 0.5e0 * {erfc} END)"


def normal_cdf_column(x: Column) -> Column:
    z = F.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.5 * z)
    poly = F.lit(ERFC_TERMS[-1])
    for c in reversed(ERFC_TERMS[:-1]):
        poly = c + t * poly
    erfc = t * F.exp(-z * z + poly)
    return F.when(x >= 0, 1 - 0.5 * erfc).otherwise(0.5 * erfc)


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d, f = 1.0, 0.0, 1.0
    for k in range(400):
        m = k // 2
        if k == 0:
            term = 1.0
        elif k % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 + term * d
        d = 1 / (d if abs(d) > tiny else tiny)
        c = 1 + term / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return front * (f - 1)


def f_survival(value: float, df1: float, df2: float) -> float:
    """P(F > value)."""
    if value <= 0:
        return 1.0
    return beta_cdf(df2 / 2, df1 / 2, df2 / (df2 + df1 * value))
