"""Distribution functions as columns, for tests of significance within a query."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-300
SHIFT = 12


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function of x > 0, to some 13 digits: Stirling's series at x + 12, taken back by the recurrence."""
    z = x + SHIFT
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    shifted = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series
    back = F.lit(0.0)
    for i in range(SHIFT):
        back = back + F.ln(x + i)
    return shifted - back


def _fraction(x: Column, a: Column, b: Column, terms: int) -> Column:
    """The continued fraction of the incomplete beta function, by products of the ratios of its convergents (Lentz)."""
    guard = lambda v: F.when(F.abs(v) < TINY, TINY).otherwise(v)
    kind = "struct<c: double, d: double, h: double>"
    first = 1 / guard(1 - (a + b) * x / (a + 1))

    def by(s: Column, factor: Column) -> Column:
        d, c = 1 / guard(1 + factor * s["d"]), guard(1 + factor / s["c"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))
        return F.get(F.transform(F.array(by(s, even)), lambda half: by(half, odd)), F.lit(0))

    start = F.struct(F.lit(1.0), first, first).cast(kind)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), lambda m: m.cast("double")), start, step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column, terms: int = 300) -> Column:
    """The regularised incomplete beta function of 0 <= x <= 1; the fraction needs some square root of the larger parameter of terms."""
    swap = x > (a + 1) / (a + b + 2)  # where the fraction of the mirror image converges faster
    p, q, y = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b), F.when(swap, 1 - x).otherwise(x)
    front = F.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * F.ln(y) + q * F.ln(1 - y))
    part = F.when(y <= 0, 0.0).otherwise(front * _fraction(y, p, q, terms) / p)
    return F.when(swap, 1 - part).otherwise(part)


def student_p(t: Column, df: Column, terms: int = 300) -> Column:
    """Two-sided p value of a t statistic with ``df`` degrees of freedom; null without degrees of freedom."""
    df = df.cast("double")
    return F.when((df > 0) & t.isNotNull(), incomplete_beta(df / (df + t * t), df / 2, F.lit(0.5), terms))
