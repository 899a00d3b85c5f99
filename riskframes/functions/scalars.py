"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softplus(x: Column) -> Column:
    """log(1 + e**x), stable for large x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def inverse_softplus(x: Column) -> Column:
    """The argument of which softplus is x; x must be positive."""
    checked = F.when(x > 0, x).otherwise(F.raise_error(F.lit("softplus values are positive")).cast("double"))
    return checked + F.log(-F.expm1(-checked))


def xlogy(x: Column, y: Column) -> Column:
    """x * log(y), and 0 where x is 0."""
    return F.when(x == 0, F.lit(0.0)).otherwise(x * F.log(y))


def entropy(p: Column) -> Column:
    """-sum p log max(p, 1e-300) of an array of probabilities."""
    return -F.aggregate(p, F.lit(0.0), lambda a, x: a + x * F.log(F.greatest(x, F.lit(1e-300))))


def chi2_2_tail(x: Column) -> Column:
    """Upper tail of the chi-squared distribution with two degrees of freedom."""
    return F.exp(-x / 2)


def chi2_1_tail(x: Column) -> Column:
    """Upper tail with one degree: erfc(sqrt(x / 2)), by a continued fraction from 2.5 on and a series below.

    Both have a fixed number of terms, so the expression stays within the engine; the error is below 1e-12.
    """
    z = F.sqrt(F.greatest(x, F.lit(0.0)) / 2)
    begin = F.struct(z.alias("term"), z.alias("total"))

    def add(s, n):
        term = s["term"] * (-z * z) / n
        return F.struct(term.alias("term"), (s["total"] + term / (2 * n + 1)).alias("total"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), begin, add, lambda s: s["total"])
    small = F.lit(1.0) - series * 1.1283791670955126
    deep = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), z, lambda s, k: z + k / 2 / s)
    large = F.exp(-z * z) / (deep * 1.7724538509055159)
    return F.when(z < 2.5, small).otherwise(large)


def sinusoidal(t: Column, width: int) -> Column:
    """Sines and cosines of t at geometric frequencies, as an array of ``width`` numbers."""
    half = width // 2
    rate = 9.210340371976184 / max(half - 1, 1)
    at = F.sequence(F.lit(0), F.lit(half - 1))
    angle = lambda k: t * F.exp(-rate * k)
    return F.concat(F.transform(at, lambda k: F.sin(angle(k))), F.transform(at, lambda k: F.cos(angle(k))))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def checked(condition: Column, value: Column, message: str) -> Column:
    """``value``, or an error in rows where the condition doesn't hold."""
    return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)).cast("double"))


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
