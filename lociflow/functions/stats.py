"""Tail probabilities and tests: small numeric helpers and columns over them."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..sources.scratch import written
from .ranking import ranked_by, value_ranks

#: Terms of a continued fraction; one that needs more is an error.
TERMS = 2_000_000


def beta_fraction(a: float, b: float, x: float) -> float:
    """The continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, TERMS):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            return h
    raise ArithmeticError(f"the fraction of the incomplete beta function doesn't converge at a = {a}, b = {b}, x = {x}")


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's law."""
    if df <= 0 or math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a * math.log(x) + b * math.log1p(-x) if 0 < x < 1 else -math.inf)) if 0 < x < 1 else 0.0
    if x >= 1:
        return 1.0
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_fraction(b, a, 1 - x) / b


def binomial_upper(k: int, n: int, p: float) -> float:
    """P(K >= k) of n trials with chance p."""
    return 1.0 if k <= 0 else 0.0 if k > n else beta_share(k, n - k + 1, p)


def fold_test(n: int, share: float, eps: float, observed: float) -> tuple[float, float, float]:
    """(p, lo, hi) for log2((K / n + eps) / (share + eps)) with K binomial of n trials with chance share.

    p is the chance of a fold at least as far from 0 as the observed one; lo and hi are the folds at which the law first
    reaches 0.025 and 0.975. The fold grows with K, so all are single tails.
    """
    fold = lambda k: math.log2((k / n + eps) / (share + eps))
    far = abs(observed) - 1e-12
    high = max(0, math.ceil(n * ((share + eps) * 2**far - eps)) - 2)
    while high <= n and fold(high) < far:
        high += 1
    low = min(n, math.floor(n * ((share + eps) * 2**-far - eps)) + 2)
    while low >= 0 and fold(low) > -far:
        low -= 1
    p = 1.0 if low >= high else binomial_upper(high, n, share) + 1 - binomial_upper(low + 1, n, share)

    def quantile(q: float) -> float:
        a, b = 0, n  # the least k with P(K <= k) >= q
        while a < b:
            k = (a + b) // 2
            a, b = (a, k) if 1 - binomial_upper(k + 1, n, share) >= q - 1e-12 else (k + 1, b)
        return fold(a)

    return min(p, 1.0), quantile(0.025), quantile(0.975)


def kolmogorov_sf(d: float, n: int) -> float:
    """P(D >= d) of n uniform values, by the asymptotic law with Stephens's correction."""
    x = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0


@lru_cache(maxsize=1024)
def u_orders(m: int, n: int, most: int) -> int:
    """How many orders of m and n untied values have a U of `most` or less: coefficients of the Gaussian binomial, multiplied out up to there."""
    ways = [1] + [0] * most
    for i in range(1, m + 1):  # multiply by (1 - q^(n+i)) / (1 - q^i)
        for j in range(most, n + i - 1, -1):
            ways[j] -= ways[j - n - i]
        for j in range(i, most + 1):
            ways[j] += ways[j - i]
    return sum(ways)


def mann_whitney_p(u: float, m: int, n: int, ties: float) -> float:
    """Two-sided p: exact if a group has 8 values at most and none tie, else normal with tie and continuity correction.

    The exact tail counts orders up to the nearer end of U, with whole numbers, so its cost grows with that tail alone.
    """
    if not m or not n:
        return math.nan
    high = max(u, m * n - u)
    if min(m, n) <= 8 and not ties:
        low = math.floor(m * n - math.ceil(high))  # the law is symmetric: P(U >= high) = P(U <= m n - high)
        return min(1.0, 2 * u_orders(min(m, n), max(m, n), low) / math.comb(m + n, min(m, n))) if low >= 0 else 0.0
    total = m + n
    var = m * n / 12 * (total + 1 - ties / (total * (total - 1)))
    return 1.0 if var <= 0 else min(1.0, math.erfc((high - m * n / 2 - 0.5) / math.sqrt(var) / math.sqrt(2)))


@F.pandas_udf(DoubleType())
def mann_whitney_column(u: pd.Series, m: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_p(*x) for x in zip(u, m, n, ties, strict=True)], dtype="float64")


@F.pandas_udf(DoubleType())
def t_column(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(*x) for x in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(StructType([StructField(name, DoubleType()) for name in ("p", "null_lo", "null_hi")]))
def fold_test_column(n: pd.Series, share: pd.Series, eps: pd.Series, observed: pd.Series) -> pd.DataFrame:
    rows = [(None, None, None) if not x[0] or any(map(pd.isna, x)) else fold_test(int(x[0]), *x[1:]) for x in zip(n, share, eps, observed, strict=True)]
    return pd.DataFrame(rows, columns=["p", "null_lo", "null_hi"], dtype="float64")


@F.pandas_udf(DoubleType())
def kolmogorov_column(d: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([kolmogorov_sf(*x) for x in zip(d, n, strict=True)], dtype="float64")


def z_score(value: str, *keys: str) -> Column:
    """(value - mean) / population deviation within the keys; a deviation of 0 counts as 1, nulls are left out."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return (F.col(value) - F.avg(value).over(w)) / F.when(sd > 0, sd).otherwise(1.0)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row (n, rho, p): rank correlation of the rows where both are known, p from Student's law with n - 2."""
    return spearman_each(df, x, [y]).select("n", "rho", "p")


def spearman_each(df: DataFrame, x: str, ys: list[str]) -> DataFrame:
    """(target, n, rho, p): spearman's row for x with each column of ys. Columns known in the same rows share x's ranks and one pass."""
    names = [f"__y{i}" for i in range(len(ys))]
    rows = written(df.where(F.col(x).isNotNull()).select(F.col(x).alias("__x"), *(F.col(y).alias(n) for y, n in zip(ys, names, strict=True))), "pairs")
    apart = lambda a, b: F.count_if(F.col(a).isNull() != F.col(b).isNull()).alias(f"{a}{b}")
    differ = rows.agg(F.count(F.lit(1)).alias("n"), *(apart(a, b) for i, b in enumerate(names) for a in names[:i])).first()
    groups: list[list[str]] = []
    for b in names:
        same = next((g for g in groups if not differ[f"{g[0]}{b}"]), None)
        same.append(b) if same else groups.append([b])
    out = None
    for group in groups:
        both = rows.where(F.col(group[0]).isNotNull())
        ranked = both
        for c in ("__x", *group):
            ranked = ranked_by(ranked, c, f"__r{c}", value_ranks(both, c)).drop(c)
        sums = ranked.agg(F.count(F.lit(1)).alias("n"), F.array(*(F.corr("__r__x", f"__r{c}") for c in group)).alias("rhos"))
        each = F.posexplode(F.arrays_zip(F.array(*(F.lit(ys[names.index(c)]) for c in group)).alias("target"), F.col("rhos").alias("rho")))
        found = sums.select("n", each.alias("__i", "__z")).select("__z.target", "n", "__z.rho")
        out = found if out is None else out.unionByName(found)
    t = F.col("rho") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - F.col("rho") * F.col("rho")))
    p = F.when(F.abs("rho") >= 1, 0.0).otherwise(t_column(F.coalesce(t, F.lit(float("nan"))), (F.col("n") - 2).cast("double")))
    return out.withColumn("p", F.when(F.col("n") > 2, p))
