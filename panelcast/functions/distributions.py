"""Quantile levels and the quantiles of the distributions used with them."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The 23 levels of a forecast, in thousandths (whole numbers, so that levels join exactly).
LEVELS = [10, 25, 50, 100, 150, 200, 250, 300, 350, 400, 450, 500, 550, 600, 650, 700, 750, 800, 850, 900, 950, 975, 990]

#: Standard normal quantiles at the levels.
NORMAL = {level: round(NormalDist().inv_cdf(level / 1000), 12) for level in LEVELS}


def student_t_quantile(p: float, df: int) -> float:
    """By bisection on the distribution function, from its density by Simpson's rule."""
    if p == 0.5:
        return 0.0
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    density = lambda x: c * (1 + x * x / df) ** (-(df + 1) / 2)

    def below(x: float, n: int = 2000) -> float:
        h = x / n
        return 0.5 + h / 3 * (density(0) + density(x) + sum((4 if k % 2 else 2) * density(k * h) for k in range(1, n)))

    target, lo, hi = max(p, 1 - p), 0.0, 50.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < target else (lo, mid)
    return math.copysign(lo, p - 0.5)


def student(df: int) -> dict[int, float]:
    """Student's t quantiles at the levels."""
    return {level: round(student_t_quantile(level / 1000, df), 9) for level in LEVELS}


def normal_quantile(p: Column) -> Column:
    """The inverse normal distribution function for any p in (0, 1), as a Column: a start by a simple rational formula
    and Newton steps on the distribution function (a series), so no table is needed."""
    # start: t - (2.30753 + 0.27061 t) / (1 + 0.99229 t + 0.04481 t^2), a published approximation (error < 3e-3)
    tail = F.least(p, 1 - p)
    t = F.sqrt(-2 * F.log(tail))
    start = t - (F.lit(2.30753) + 0.27061 * t) / (1 + 0.99229 * t + 0.04481 * t * t)
    # a fold binds z: written out, the steps would nest to a huge expression
    z = F.aggregate(F.sequence(F.lit(1), F.lit(3)), start, lambda z, _: z + (_upper(z) - tail) / (F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi))))
    return F.when(p == 0.5, F.lit(0.0)).when(p < 0.5, -z).otherwise(z)


def _upper(z: Column) -> Column:
    """1 - Phi(z) for z >= 0 by the midpoint rule over the angle form of the error integral."""
    n = 96
    total = F.lit(0.0)
    for k in range(n):
        s = math.sin((k + 0.5) * math.pi / 2 / n)
        total = total + F.exp(-z * z / F.lit(2 * s * s))
    return total / (2 * n)
