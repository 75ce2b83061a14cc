"""Quantiles of Student's distribution, as Column expressions: meant for aggregated rows, a line's or a group's."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

# Beyond so many degrees of freedom the expansion around the normal quantile is exact to more than ten digits.
LARGE = 1000
DEPTH = 120
NEWTON_STEPS = 40


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series at z + 8, carried back by the recurrence."""
    w = z + 8
    series = 1 / (12 * w) - 1 / (360 * w**3) + 1 / (1260 * w**5) - 1 / (1680 * w**7) + 1 / (1188 * w**9)
    product = z
    for k in range(1, 8):
        product = product * (z + k)
    return (w - 0.5) * F.log(w) - w + F.lit(math.log(2 * math.pi) / 2) + series - F.log(product)


def _beta_fraction(x: Column, a: Column, b: Column) -> Column:
    """The incomplete beta function's continued fraction, from its tail up."""

    def level(rest: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + even / (1 + odd / rest)

    depths = F.sequence(F.lit(DEPTH), F.lit(1), F.lit(-1))
    tail = F.aggregate(depths, F.lit(1.0), lambda rest, m: level(rest, m.cast("double")))
    return 1 / (1 - (a + b) * x / (a + 1) / tail)


def beta_share(x: Column, a: Column, b: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), 0 < x < 1."""
    scale = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = scale * _beta_fraction(x, a, b) / a
    high = 1 - scale * _beta_fraction(1 - x, b, a) / b
    return F.when(x < (a + 1) / (a + b + 2), low).otherwise(high)


def student_t_quantile(p: float, freedom: Column) -> Column:
    """The value that Student's distribution on ``freedom`` degrees stays below with probability ``p``, from 0.5 to 1 without 1.

    Null below one degree. Up to LARGE degrees Newton's steps on the incomplete beta function, from the normal quantile,
    which lies to the left, where the steps rise to the root and never pass it; beyond, the expansion in 1 / freedom.
    """
    if not 0.5 <= p < 1:
        raise ValueError(f"p must be from 0.5 to 1, 1 not included, not {p}")
    z = NormalDist().inv_cdf(p)
    n = freedom.cast("double")
    terms = [
        z,
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]
    large = F.lit(0.0)
    for term in reversed(terms):
        large = large / n + term
    if z == 0:
        return F.when(n >= 1, F.lit(0.0))
    log_scale = log_gamma((n + 1) / 2) - log_gamma(n / 2) - 0.5 * F.log(n * math.pi)

    def newton(t: Column, _: Column) -> Column:
        below = 1 - 0.5 * beta_share(n / (n + t * t), n / 2, F.lit(0.5))
        density = F.exp(log_scale - (n + 1) / 2 * F.log(1 + t * t / n))
        return t + (p - below) / density

    small = F.aggregate(F.sequence(F.lit(1), F.lit(NEWTON_STEPS)), F.lit(float(z)), newton)
    return F.when(n > LARGE, large).when(n >= 1, small)
