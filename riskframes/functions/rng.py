"""Counter-based randomness: a number is a function of its seed and place, so it doesn't depend on partitions.

``uniform`` takes 52 bits of an MD5 digest of the seed and the counters; the SQL twin gives the same bits in another engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Coefficients of Acklam's rational approximation to the inverse normal distribution.
A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
LOW = 0.02425


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def uniform(seed: int | str, *counters) -> Column:
    """A number in [0, 1) for the seed and the counters."""
    parts = [F.lit(str(seed)), *(_col(c).cast("string") for c in counters)]
    digits = F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(4503599627370496.0)


def uniform_sql(seed: int | str, *counters: str) -> str:
    return f"(CAST(('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(counters)})), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE)"


def integer(n, seed: int | str, *counters) -> Column:
    """A number in 0 .. n - 1."""
    return F.floor(uniform(seed, *counters) * _col(n)).cast("bigint")


def _poly(x, coefficients):
    out = coefficients[0]
    for c in coefficients[1:]:
        out = out * x + c
    return out


def inverse_normal(p: Column) -> Column:
    """The standard normal quantile of p in (0, 1); p is held away from the ends by 1e-16."""
    p = F.greatest(F.least(p, F.lit(1 - 1e-16)), F.lit(1e-16))

    def middle(p):
        q = p - 0.5
        r = q * q
        return _poly(r, [F.lit(x) for x in A]) * q / (_poly(r, [F.lit(x) for x in B]) * r + 1)

    def tail(p):
        q = F.sqrt(-2 * F.log(p))
        return _poly(q, [F.lit(x) for x in C]) / (_poly(q, [F.lit(x) for x in D]) * q + 1)

    return F.when(p < LOW, tail(p)).when(p > 1 - LOW, -tail(1 - p)).otherwise(middle(p))


def inverse_normal_sql(p: str) -> str:
    def poly(x: str, cs: tuple) -> str:
        out = f"({cs[0]!r}::DOUBLE)"
        for c in cs[1:]:
            out = f"({out} * {x} + ({c!r}::DOUBLE))"
        return out

    p = f"greatest(least({p}, {1 - 1e-16!r}::DOUBLE), 1e-16::DOUBLE)"
    q, t = f"({p} - 0.5::DOUBLE)", f"sqrt(-2 * ln({p}))"
    u = f"sqrt(-2 * ln(1 - {p}))"
    r = f"({q} * {q})"
    return (
        f"(CASE WHEN {p} < {LOW} THEN {poly(t, C)} / ({poly(t, D)} * {t} + 1) WHEN {p} > {1 - LOW} THEN -({poly(u, C)} / ({poly(u, D)} * {u} + 1)) "
        f"ELSE {poly(r, A)} * {q} / ({poly(r, B)} * {r} + 1) END)"
    )


def normal(seed: int | str, *counters) -> Column:
    return inverse_normal(uniform(seed, *counters))


def normal_sql(seed: int | str, *counters: str) -> str:
    return inverse_normal_sql(uniform_sql(seed, *counters))
