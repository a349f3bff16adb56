"""Tail probabilities and adjusted p-values.

Poisson tails are column expressions. Tails that need a gamma function run as Arrow UDFs on whole batches.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import checkpointed


def _poisson_density(k: Column, rate: Column) -> Column:
    """P(X = k) for k >= 0 and rate > 0: by the factorial up to 20, beyond it by Stirling's series, whose parts stay small near the rate."""
    y = F.greatest(k, F.lit(1.0))
    u = (rate - y) / y
    away = F.when(F.abs(u) < 0.5, y * (u - F.log1p(u))).otherwise(y * F.log(y / rate) + rate - y)
    rest = (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / (y * y)) / (y * y)) / (y * y)) / y
    few = F.exp(k * F.log(rate) - rate - F.log(F.factorial(F.least(k, F.lit(20.0)).cast("int")).cast("double")))
    return F.when(k <= 20, few).otherwise(F.exp(-away - F.log(2 * math.pi * y) / 2 - rest))


def poisson_above(x: Column, rate: Column) -> Column:
    """P(X > x) of a Poisson variable: from x + 1 upwards where that tail is the small one, else one less the sum from x downwards.

    Either sum starts at its largest term and is whole: its length grows with the root of x, so that the first term left out is less
    than exp(-45) of the largest. Null in, null out; rate 0 gives 0 for x >= 0.
    """
    x, rate = F.floor(x).cast("double"), rate.cast("double")
    k, r = F.greatest(x, F.lit(0.0)), F.when(rate > 0, rate).otherwise(1.0)

    def summed(first: Column, last: Column, ratio: Callable[[Column], Column]) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.ceil(last).cast("int")),
            F.struct(first.alias("term"), first.alias("sum")),
            lambda a, i: F.struct((a["term"] * ratio(i)).alias("term"), (a["sum"] + a["term"] * ratio(i)).alias("sum")),
            lambda a: a["sum"],
        )

    # products of j ratios are at most exp(-j * j / 2 / (k + 1 + j)) upwards and exp(-j * (j - 1) / 2 / k) downwards
    above = summed(_poisson_density(k + 1, r), 45 + F.sqrt(45 * 45 + 90 * (k + 1)), lambda i: r / (k + 1 + i))
    below = summed(_poisson_density(k, r), F.greatest(F.lit(1.0), F.least(k, 1 + F.sqrt(90 * k))), lambda i: (k + 1 - i) / r)
    tail = F.when(k + 1 > r, above).otherwise(F.greatest(F.lit(0.0), 1 - below))
    return F.when(x.isNull() | rate.isNull(), None).when(x < 0, 1.0).when(rate <= 0, 0.0).otherwise(F.least(F.lit(1.0), tail))


def poisson_above_sql(x: str, rate: str) -> str:
    return f"(CASE WHEN {rate} <= 0 THEN 0.0 ELSE 1 - list_sum([exp(-({rate}) + i * ln({rate}) - lgamma(i + 1)) for i in range(0, ({x})::BIGINT + 1)]) END)"


# ---------------------------------------------------------------- tails as Arrow UDFs


_LOG_GAMMA = np.vectorize(math.lgamma, otypes=[float])
_ERFC = np.vectorize(math.erfc, otypes=[float])
_QUANTILE = np.vectorize(NormalDist().inv_cdf, otypes=[float])


def _udf(f: Callable[..., np.ndarray]) -> Callable[..., Column]:
    @F.arrow_udf(T.DoubleType())
    def run(*columns: pa.Array) -> pa.Array:
        values = [c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns]
        ok = ~np.logical_or.reduce([np.isnan(v) for v in values])
        out = np.full(len(ok), np.nan)
        with np.errstate(all="ignore"):
            if ok.any():
                out[ok] = f(*[v[ok] for v in values])
        return pa.array(out, from_pandas=True)

    return lambda *columns: run(*[c.cast("double") for c in columns])


def _log_sum(first: np.ndarray, last: np.ndarray, log_term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """log of the sum of exp(log_term(k, rows)) for k from first to last, in blocks of bounded size."""
    total, k = np.full(len(first), -np.inf), first.copy()
    rows = np.flatnonzero(k <= last)
    while len(rows):
        steps = k[rows, None] + np.arange(64)
        terms = np.where(steps <= last[rows, None], log_term(np.minimum(steps, last[rows, None]), rows[:, None]), -np.inf)
        top = np.maximum(terms.max(1), total[rows])
        new = np.where(np.isfinite(top), top + np.log(np.exp(terms - np.where(np.isfinite(top), top, 0)[:, None]).sum(1) + np.exp(total[rows] - np.where(np.isfinite(top), top, 0))), -np.inf)
        # terms fall behind their mode; once a block adds nothing, later ones don't either
        idle = (new - total[rows] < 1e-16) & np.isfinite(total[rows])
        total[rows] = new
        k[rows] += 64
        rows = rows[(k[rows] <= last[rows]) & ~idle]
    return total


def log_binomial_from(x: np.ndarray, n: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log P(X >= x) of a binomial variable."""
    x, n, p = np.ceil(x), np.floor(n), np.clip(p, 0, 1)
    sure, never = (x <= 0) | (p >= 1) & (x <= n), (x > n) | (p <= 0) & (x > 0)
    q = np.clip(p, 1e-300, 1 - 1e-16)
    whole = _LOG_GAMMA(n + 1)

    def term(k: np.ndarray, r: np.ndarray) -> np.ndarray:
        return whole[r] - _LOG_GAMMA(k + 1) - _LOG_GAMMA(n[r] - k + 1) + k * np.log(q[r]) + (n[r] - k) * np.log1p(-q[r])

    upper = x > n * q
    out = np.empty(len(x))
    out[:] = _log_sum(np.where(upper, x, 1), np.where(upper & ~sure & ~never, n, 0), term)
    lower = _log_sum(np.where(upper, 1, 0), np.where(~upper & ~sure & ~never, x - 1, -1), term)
    out = np.where(upper, out, np.log1p(-np.exp(np.minimum(lower, 0))))
    return np.where(sure, 0.0, np.where(never, -np.inf, np.minimum(out, 0)))


def log_negative_binomial(k: np.ndarray, mean: np.ndarray, theta: np.ndarray) -> np.ndarray:
    return _LOG_GAMMA(k + theta) - _LOG_GAMMA(theta) - _LOG_GAMMA(k + 1) + theta * np.log(theta / (theta + mean)) + np.where(k > 0, k * np.log(np.maximum(mean, 1e-300) / (theta + mean)), 0)


def negative_binomial_above(x: np.ndarray, mean: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """P(X > x) of a negative binomial variable with this mean and dispersion theta."""
    x = np.floor(x)
    below = _log_sum(np.zeros(len(x)), x, lambda k, r: log_negative_binomial(k, mean[r], theta[r]))
    return np.where(x < 0, 1.0, np.clip(-np.expm1(np.minimum(below, 0)), 0, 1))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """log of the regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    flip = x > (a + 1) / (a + b + 2)
    a_, b_, x_ = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = _LOG_GAMMA(a_ + b_) - _LOG_GAMMA(a_) - _LOG_GAMMA(b_) + a_ * np.log(x_) + b_ * np.log1p(-x_) - np.log(a_)
    tiny = 1e-300
    c = np.ones(len(x))
    d = 1 - (a_ + b_) * x_ / (a_ + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for term in (m * (b_ - m) * x_ / ((a_ + 2 * m - 1) * (a_ + 2 * m)), -(a_ + m) * (a_ + b_ + m) * x_ / ((a_ + 2 * m) * (a_ + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + term / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    value = np.where(x_ <= 0, -np.inf, front + np.log(h))
    return np.where(flip, np.log1p(-np.exp(np.minimum(value, 0))), value)


def log_t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """log of the two-sided p-value of Student's t."""
    return np.where(np.isinf(t), -np.inf, np.where(t == 0, 0.0, np.minimum(0, incomplete_beta(df / 2, np.full(len(df), 0.5), df / (df + t * t)))))


def log_t_below(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """log P(T <= t) of Student's t."""
    half = log_t_two_sided(t, df) - math.log(2)
    return np.where(t <= 0, half, np.log1p(-np.exp(half)))


def poisson_quantile(u: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """The least k with P(X <= k) > u, for rates up to some hundreds."""
    term = np.exp(-np.maximum(rate, 0))
    total, out = term.copy(), np.zeros(len(u))
    rows, k = np.flatnonzero(total <= u), 0
    while len(rows) and k < 5000:
        k += 1
        term[rows] *= rate[rows] / k
        total[rows] += term[rows]
        out[rows] = k
        rows = rows[(total[rows] <= u[rows]) & (term[rows] > 0)]
    return out


poisson_quantile_udf = _udf(poisson_quantile)
log_binomial_from_udf = _udf(log_binomial_from)
binomial_above_udf = _udf(lambda x, n, p: np.exp(log_binomial_from(np.floor(x) + 1, n, p)))
negative_binomial_above_udf = _udf(negative_binomial_above)
negative_binomial_density_udf = _udf(lambda k, mean, theta: np.exp(log_negative_binomial(k, mean, theta)))
log_t_two_sided_udf = _udf(log_t_two_sided)
normal_below_udf = _udf(lambda z: _ERFC(-z / math.sqrt(2)) / 2)
normal_quantile_udf = _udf(lambda p: np.where((p > 0) & (p < 1), _QUANTILE(np.clip(p, 1e-300, 1 - 1e-16)), np.where(p <= 0, -np.inf, np.inf)))
chi_square_1_above_udf = _udf(lambda x: _ERFC(np.sqrt(np.maximum(x, 0) / 2)))


def fisher_two(p: Column, q: Column, floor: float = 0.001) -> Column:
    """Fisher's combination of two p-values floored at `floor`: the closed form of chi-square with four degrees of freedom."""
    half = -F.log(F.greatest(p, F.lit(floor))) - F.log(F.greatest(q, F.lit(floor)))
    return F.exp(-half) * (1 + half)


# ---------------------------------------------------------------- multiple testing


def adjusted(df: DataFrame, p: str, method: str, out: str, by: list[str] | None = None, log: bool = False, parts: int = 32) -> DataFrame:
    """Adds BH or Holm adjusted p-values within the groups of `by` (all rows by default); null p-values stay null and don't count.

    Equal p-values are adjusted as one: counts of distinct values, in ranges of the value that hold about as many each, give all
    ranks by a running sum within a range and over the ranges' totals. No task sees more than a range, whatever the
    number of tests. With log, p and the result are natural logarithms.
    """
    by = by or []
    counts = checkpointed(df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("__n")))
    cuts = F.array_sort(F.array_distinct(F.percentile_approx(p, [k / parts for k in range(1, parts)])))
    bounds = counts.groupBy(*by).agg(cuts.alias("__cuts"), F.sum("__n").alias("__all"))
    same = _same(by)
    ranged = counts.join(bounds.select(*[F.col(c).alias(f"__{c}") for c in by], "__cuts", "__all"), same) if by else counts.crossJoin(F.broadcast(bounds))  # one row
    ranged = ranged.withColumn("__part", F.size(F.filter("__cuts", lambda c: c < F.col(p)))).drop(*[f"__{c}" for c in by], "__cuts")
    inner = Window.partitionBy(*by, "__part").orderBy(p)
    totals = ranged.groupBy(*by, "__part").agg(F.sum("__n").alias("__in"))
    outer = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("__before", F.coalesce(F.sum("__in").over(outer), F.lit(0))).drop("__in")
    ranged = _with(ranged, totals, [*by, "__part"])
    upto = F.col("__before") + F.sum("__n").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    factor = F.col("__all") / upto if method == "bh" else F.col("__all") - (upto - F.col("__n"))
    ranged = ranged.withColumn("__value", F.col(p) + F.log(factor) if log else F.col(p) * factor)
    if method == "bh":
        inner_value, edge, over = F.min("__value").over(inner.rowsBetween(0, Window.unboundedFollowing)), F.min("__value"), (1, Window.unboundedFollowing)
        pick = F.least
    else:
        inner_value, edge, over = F.max("__value").over(inner.rowsBetween(Window.unboundedPreceding, 0)), F.max("__value"), (Window.unboundedPreceding, -1)
        pick = F.greatest
    edges = ranged.groupBy(*by, "__part").agg(edge.alias("__edge"))
    edges = edges.withColumn("__edge", (F.min if method == "bh" else F.max)("__edge").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(*over)))
    ranged = _with(ranged.withColumn("__inner", inner_value), edges, [*by, "__part"])
    ranged = ranged.select(*by, p, F.least(F.lit(0.0 if log else 1.0), pick("__inner", "__edge")).alias(out))
    return _with(df, ranged, [*by, p], "left")


def _same(by: list[str]) -> Column:
    return F.lit(True) if not by else F.expr(" AND ".join(f"`{c}` <=> `__{c}`" for c in by))


def _with(df: DataFrame, more: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null."""
    more = more.select(*[F.col(c).alias(f"__k_{c}") for c in keys], *[c for c in more.columns if c not in keys])
    return df.join(more, F.expr(" AND ".join(f"`{c}` <=> `__k_{c}`" for c in keys)), how).drop(*[f"__k_{c}" for c in keys])
