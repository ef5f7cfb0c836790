"""Column expressions shared by the operators. Missing is always SQL NULL, never NaN."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

# Coefficients of Acklam's rational approximation of the normal quantile function.
PROBIT_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
            1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PROBIT_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
            6.680131188771972e01, -1.328068155288572e01)
PROBIT_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
            -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PROBIT_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
            3.754408661907416e00)
PROBIT_LOW = 0.02425


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: str | Column, lo: float, hi: float) -> Column:
    """Clip and keep NULL (``greatest``/``least`` alone would replace it)."""
    c = col(x)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def finite(x: str | Column) -> Column:
    """NaN and infinities become NULL."""
    c = col(x)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def scrub(x: str | Column, fill: float = 0.0) -> Column:
    return F.coalesce(finite(x), F.lit(fill))


def div(a: str | Column, b: str | Column) -> Column:
    """Division that is NULL at a zero denominator."""
    return F.try_divide(col(a), col(b))


def ln_pos(x: str | Column) -> Column:
    c = col(x)
    return F.when(c > 0, F.ln(c))


def zscore(x: str | Column, mean: Column, std: Column, eps: float | None) -> Column:
    """``(x - mean) / (std + eps)``; with ``eps=None`` a zero spread gives NULL."""
    if eps is None:
        return F.try_divide(col(x) - mean, F.when(std > 0, std))
    return (col(x) - mean) / (std + F.lit(eps))


def horner(coefs: Sequence[float], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefs[1:], F.lit(coefs[0]))


def probit(p: str | Column) -> Column:
    """Normal quantile function by a rational approximation (relative error about 1e-9)."""
    c = col(p)

    def tail(q: Column) -> Column:
        return horner(PROBIT_C, q) / horner(PROBIT_D + (1.0,), q)

    mid = c - F.lit(0.5)
    r = mid * mid
    centre = horner(PROBIT_A, r) * mid / horner(PROBIT_B + (1.0,), r)
    return (F.when((c <= 0) | (c >= 1), None)
            .when(c < PROBIT_LOW, tail(F.sqrt(F.lit(-2.0) * F.ln(c))))
            .when(c > 1 - PROBIT_LOW, -tail(F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - c))))
            .otherwise(centre))


def hash_uniform(seed: int | str, *keys: str | Column) -> Column:
    """Uniform number in [0, 1) that depends on the row's key and the seed only: 52 bits, so that a double holds each exactly."""
    text = F.concat_ws("|", *[col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hash_normal(seed: int | str, *keys: str | Column) -> Column:
    return probit(F.greatest(hash_uniform(seed, *keys), F.lit(1e-9)))


def adjusted_skew(n: Column, s1: Column, s2: Column, s3: Column) -> Column:
    """Bias-adjusted skewness from raw power sums; 0 on a constant frame, NULL below 3 rows."""
    m = s1 / n
    m2 = s2 / n - m * m
    m3 = s3 / n - F.lit(3.0) * m * s2 / n + F.lit(2.0) * m * m * m
    g1 = F.try_divide(m3, F.pow(m2, F.lit(1.5)))
    return (F.when(n < 3, None)
            .when(m2 <= F.lit(1e-14), F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def adjusted_kurt(n: Column, s1: Column, s2: Column, s3: Column, s4: Column) -> Column:
    """Bias-adjusted excess kurtosis from raw power sums; -3 on a constant frame."""
    m = s1 / n
    m2 = s2 / n - m * m
    m4 = (s4 / n - F.lit(4.0) * m * s3 / n + F.lit(6.0) * m * m * s2 / n
          - F.lit(3.0) * m * m * m * m)
    g2 = F.try_divide(m4, m2 * m2) - F.lit(3.0)
    return (F.when(n < 4, None)
            .when(m2 <= F.lit(1e-14), F.lit(-3.0))
            .otherwise(((n + 1) * g2 + F.lit(6.0)) * (n - 1) / ((n - 2) * (n - 3))))


def literal_array(values: Sequence[float]) -> Column:
    return F.lit([float(v) for v in values]) if len(values) else F.array().cast("array<double>")


def _passed(edges: Sequence[float], passes) -> Column:
    """Length of the prefix of sorted edges that passes; two levels keep long lists at sqrt(n) comparisons."""
    if len(edges) <= 64:
        return F.size(F.filter(literal_array(edges), passes))
    k = int(len(edges) ** 0.5)
    blocks = [list(edges[i:i + k]) for i in range(0, len(edges), k)]
    whole = F.size(F.filter(literal_array([b[-1] for b in blocks]), passes))
    part = F.get(F.array(*[literal_array(b) for b in blocks]), whole)
    inner = F.when(part.isNotNull(), F.size(F.filter(part, passes))).otherwise(0)
    return F.least(whole * k + inner, F.lit(len(edges)))  # the last block may be short


def edges_at_or_below(x: str | Column, edges: Sequence[float]) -> Column:
    """Number of (distinct, sorted) edges that are <= x: a right-sided sorted search."""
    c = col(x)
    return F.when(c.isNotNull(), _passed(edges, lambda e: e <= c).cast("long"))


def edges_below(x: str | Column, edges: Sequence[float]) -> Column:
    """Number of edges that are < x: a left-sided sorted search."""
    c = col(x)
    return F.when(c.isNotNull(), _passed(edges, lambda e: e < c).cast("long"))


def minute_of_day(t: str | Column) -> Column:
    return F.hour(col(t)) * F.lit(60) + F.minute(col(t))


def month_key(t: str | Column) -> Column:
    return F.date_format(col(t), "yyyy-MM")


def epoch_seconds(t: str | Column) -> Column:
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(t))
