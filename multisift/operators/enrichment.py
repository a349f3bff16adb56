"""Enrichment of cluster pairs among called doublets, and clusters' propensity to form them.

Tables of pairs have a row for each two clusters; regressions on them run on the driver, which holds at most that many rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import adjusted, binomial_above_udf, chi_square_1_above_udf, log_negative_binomial, log_t_two_sided, negative_binomial_above_udf, poisson_above
from ..model import checkpointed


def dispersion(observed: np.ndarray, expected: np.ndarray) -> float | None:
    """The likeliest negative binomial dispersion for these means by a golden-section search, or None if Poisson fits as well."""

    def loss(log_theta: float) -> float:
        return -float(log_negative_binomial(observed, np.maximum(expected, 1e-9), np.full(len(observed), math.exp(log_theta))).sum())

    low, high = math.log(1e-2), math.log(1e6)
    ratio = (math.sqrt(5) - 1) / 2
    a, b = high - ratio * (high - low), low + ratio * (high - low)
    fa, fb = loss(a), loss(b)
    for _ in range(80):
        if fa < fb:
            high, b, fb = b, a, fa
            a = high - ratio * (high - low)
            fa = loss(a)
        else:
            low, a, fa = a, b, fb
            b = low + ratio * (high - low)
            fb = loss(b)
    theta = math.exp((low + high) / 2)
    return None if theta > 1e5 else theta


def pairwise_enrichment(pairs: DataFrame, test: str = "poisson", lower: bool = False, by_sample: bool = False, difficulty: bool = False) -> DataFrame:
    """(combination[, sample], log2enrich, p_value, FDR) from (combination, observed, expected[, difficulty, sample]).

    Observed and expected are summed over samples unless by_sample. With difficulty, expected is replaced by what a regression on it
    and the difficulty fits. A p-value of the wrong direction is 1. FDR holds Holm's adjusted values.
    """
    keys = ["combination", "sample"] if by_sample else ["combination"]
    d = pairs.groupBy(*keys).agg(F.sum("observed").cast("double").alias("observed"), F.sum("expected").alias("expected"), *([F.avg("difficulty").alias("difficulty")] if difficulty else []))
    if difficulty:
        d = _fitted(d)
    up = F.when(F.lit(lower), F.col("observed") <= F.col("expected")).otherwise(F.col("observed") >= F.col("expected"))
    # upper tails include what was observed
    x = F.col("observed") if lower else F.col("observed") - 1
    if test == "poisson":
        above = poisson_above(x, F.col("expected"))
    elif test == "binom":
        totals = d.agg(F.sum("observed").alias("__o"), F.sum("expected").alias("__e"))
        d = d.crossJoin(F.broadcast(totals))  # one row
        above = binomial_above_udf(x, F.col("__o"), F.try_divide("expected", "__e"))
    elif test == "nbinom":
        rows = d.select("observed", "expected").collect()
        theta = dispersion(np.array([r[0] for r in rows]), np.array([r[1] for r in rows])) if rows else None
        above = poisson_above(x, F.col("expected")) if theta is None else negative_binomial_above_udf(x, F.col("expected"), F.lit(theta))
    elif test == "chisq":
        totals = d.agg(F.sum("observed").alias("__o"), F.sum("expected").alias("__e"))
        d = d.crossJoin(F.broadcast(totals))  # one row
        share = F.try_divide("expected", "__e")
        want = share * F.col("__o")
        above = chi_square_1_above_udf((F.col("observed") - want) * (F.col("observed") - want) * (F.try_divide(F.lit(1.0), want) + F.try_divide(F.lit(1.0), F.col("__o") - want)))
    else:
        raise ValueError(f"no such test: {test}")
    tail = above if test == "chisq" or not lower else 1 - above
    d = d.select(*keys, F.log2((1 + F.col("observed")) / (1 + F.col("expected"))).alias("log2enrich"), F.when(up, F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail))).otherwise(1.0).alias("p_value"))
    return adjusted(checkpointed(d), "p_value", "holm", "FDR").orderBy("p_value", F.desc(F.abs("log2enrich")), *keys)


def _fitted(d: DataFrame) -> DataFrame:
    model = GeneralizedLinearRegression(family="poisson", link="log", labelCol="observed", featuresCol="__x", offsetCol="__off", maxIter=50)
    d = d.withColumn("__off", F.log(F.greatest("expected", F.lit(1e-6))))
    d = VectorAssembler(inputCols=["difficulty"], outputCol="__x").transform(d.withColumn("difficulty", F.coalesce("difficulty", F.lit(0.0))))
    return model.fit(d).transform(d).withColumn("expected", F.col("prediction")).drop("prediction", "__x", "__off")


def memberships(pairs: DataFrame) -> tuple[DataFrame, list[str]]:
    """pairs with a 0/1 column in_<cluster> for each cluster of "A+B", and the clusters."""
    names = sorted(r[0] for r in pairs.select(F.explode(F.split("combination", r"\+")).alias("c")).distinct().collect())
    return pairs.select("*", *[F.array_contains(F.split("combination", r"\+"), n).cast("double").alias(f"in_{n}") for n in names]), names


def stickiness(pairs: DataFrame, family: str = "quasibinomial", difficulty: bool | None = None) -> DataFrame:
    """(cluster, estimate, std_error, statistic, p_value, FDR): a cluster's tendency to form more doublets than expected.

    A regression without intercept of what was observed on the clusters' memberships, offset by what is expected. quasibinomial scales
    standard errors by the spread of its residuals and tests by t. Needs at least four clusters.
    """
    sums = pairs.groupBy("combination").agg(F.sum("observed").cast("double").alias("observed"), F.sum("expected").alias("expected"), *([F.avg("difficulty").alias("difficulty")] if "difficulty" in pairs.columns else []))
    d, names = memberships(sums)
    if len(names) < 4:
        raise ValueError("need at least four clusters")
    rows = d.orderBy("combination").toPandas()
    use_difficulty = len(rows) > 15 if difficulty is None else difficulty
    x = rows[[f"in_{n}" for n in names]].to_numpy(float)
    terms = list(names)
    if use_difficulty and "difficulty" in rows and rows["difficulty"].std() > 0:
        level = rows["difficulty"].fillna(rows["difficulty"].mean())
        x = np.column_stack([x, (level - level.mean()) / level.std()])
        terms.append("(difficulty)")
    o, e = rows["observed"].to_numpy(float), np.maximum(rows["expected"].to_numpy(float), 1e-9)
    if family in ("quasibinomial", "binomial"):
        share = e / e.sum()
        beta, cov, pearson = _binomial(x, o / o.sum(), np.log(share / (1 - share)), (o + e) / 2)
    else:
        theta = dispersion(o, e) if family == "nbinom" else None
        beta, cov, pearson = _log_linear(x, o, np.log(e), theta)
    df = max(1, len(o) - len(terms))
    scale = pearson / df if family == "quasibinomial" else 1.0
    se = np.sqrt(np.maximum(0, np.diag(cov)) * scale)
    stat = np.divide(beta, se, out=np.zeros_like(beta), where=se > 0)
    if family == "quasibinomial":
        p = np.exp(log_t_two_sided(np.abs(stat), np.full(len(stat), float(df))))
    else:
        p = np.array([math.erfc(abs(z) / math.sqrt(2)) for z in stat])
    table = [(n, float(b), float(s), float(z), float(q)) for n, b, s, z, q in zip(terms, beta, se, stat, p, strict=True)]
    out = pairs.sparkSession.createDataFrame(table, "cluster string, estimate double, std_error double, statistic double, p_value double")
    return adjusted(out, "p_value", "holm", "FDR").orderBy("p_value", F.abs("estimate") - F.col("std_error"), "cluster")


def _irls(x, z_w, steps=60):
    beta = np.zeros(x.shape[1])
    for _ in range(steps):
        z, w = z_w(x @ beta)
        inverse = np.linalg.pinv(x.T @ (x * w[:, None]))
        new = inverse @ (x.T @ (w * z))
        if np.abs(new - beta).max() < 1e-10:
            return new, inverse
        beta = new
    return beta, inverse


def _binomial(x, y, offset, weight):
    def step(eta):
        mu = np.clip(1 / (1 + np.exp(-(eta + offset))), 1e-10, 1 - 1e-10)
        v = mu * (1 - mu)
        return eta + (y - mu) / v, weight * v

    beta, cov = _irls(x, step)
    mu = np.clip(1 / (1 + np.exp(-(x @ beta + offset))), 1e-10, 1 - 1e-10)
    return beta, cov, float((weight * (y - mu) ** 2 / (mu * (1 - mu))).sum())


def _log_linear(x, y, offset, theta):
    def step(eta):
        mu = np.exp(np.clip(eta + offset, -30, 30))
        w = mu if theta is None else mu / (1 + mu / theta)
        return eta + (y - mu) / mu, w

    beta, cov = _irls(x, step)
    mu = np.exp(x @ beta + offset)
    return beta, cov, float(((y - mu) ** 2 / mu).sum())
