"""Tail probabilities for test statistics.

The column forms are finite sums inside the row; the scalar forms serve driver code and tests.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_quantile(level: float) -> float:
    """Half-width factor of a symmetric normal interval with the given coverage."""
    return NormalDist().inv_cdf(0.5 + level / 2)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the front."""
    tiny = 1e-300
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    c, value = 1.0, d
    for m in range(1, 500):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + step / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2.0, 0.5, df / (df + t * t))


def odd_chi2_upper(x: float, df: float) -> float:
    """Upper tail for odd degrees: the normal tail plus a finite sum of half-integer powers."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    terms = [
        math.exp((k - 0.5) * math.log(half) - half - math.lgamma(k + 0.5)) for k in range(1, int(df) // 2 + 1)
    ]
    return math.erfc(math.sqrt(half)) + sum(terms)


def normal_p_value(z: str | Column) -> Column:
    """Two-sided tail as a column: the series around zero, the continued fraction from three on."""
    z = F.col(z) if isinstance(z, str) else z
    x = F.abs(z.cast("double"))
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    ratio = lambda a, k: a["term"] * x * x / (2 * k + 1)
    inner = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(x.alias("term"), x.alias("total")),
        lambda a, k: F.struct(ratio(a, k).alias("term"), (a["total"] + ratio(a, k)).alias("total")),
        lambda a: 1 - 2 * density * a["total"],
    )
    outer = F.aggregate(F.sequence(F.lit(100), F.lit(1)), x, lambda a, k: x + k / a, lambda a: 2 * density / a)
    return F.when(F.isnan(x), None).when(x < 3, inner).otherwise(outer)


#: Degrees from which the Student tail is that of a corrected normal value, within about 1e-9.
MANY_DEGREES = 20_000


def t_p_value(t: str | Column, df: str | Column) -> Column:
    """Two-sided Student tail for whole degrees as a column: a finite sum of powers of a cosine.

    With theta = atan(t / sqrt(df)) the central share is sin(theta) times a sum over even powers of
    cos(theta) for even degrees, and (theta + sin(theta) times a sum over odd powers) * 2 / pi for odd ones.
    """
    t, df = (F.col(c) if isinstance(c, str) else c for c in (t, df))
    x, n = F.abs(t.cast("double")), df.cast("double")
    odd = F.pmod(n, F.lit(2.0))
    square = n / (n + x * x)
    sine = x / F.sqrt(n + x * x)
    first = F.when(odd == 1, F.sqrt(square)).otherwise(F.lit(1.0))
    last = F.floor((n - 2 - odd) / 2).cast("int")
    powers = F.when((last >= 1) & (n < MANY_DEGREES), F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    grown = lambda a, k: a["term"] * square * (2 * k - 1 + odd) / (2 * k + odd)
    total = F.aggregate(
        powers,
        F.struct(first.alias("term"), first.alias("total")),
        lambda a, k: F.struct(grown(a, k).alias("term"), (a["total"] + grown(a, k)).alias("total")),
        lambda a: a["total"],
    )
    central = (
        F.when(n == 1, F.atan(x) * 2 / math.pi)
        .when(odd == 1, (F.atan(x / F.sqrt(n)) + sine * total) * 2 / math.pi)
        .otherwise(sine * total)
    )
    far = normal_p_value(x * (1 - 1 / (4 * n)) / F.sqrt(1 + x * x / (2 * n)))
    tail = F.when(n >= MANY_DEGREES, far).otherwise(F.greatest(1 - central, F.lit(0.0)))
    return F.when((n >= 1) & ~F.isnan(x), tail)


def chi2_p_value(x: Column, df: int) -> Column:
    """Upper tail of the chi-squared distribution: a finite sum, plus a normal tail for odd degrees."""
    half = x / 2.0
    if df % 2:
        log = F.log(half)
        terms = [F.exp(log * (k - 0.5) - half - math.lgamma(k + 0.5)) for k in range(1, df // 2 + 1)]
        return F.when(x > 0, sum(terms, normal_p_value(F.sqrt(x)))).when(x <= 0, 1.0)
    terms = F.lit(1.0)
    for k in range(1, df // 2):
        terms = terms + F.pow(half, F.lit(float(k))) / float(math.factorial(k))
    return F.exp(-half) * terms
