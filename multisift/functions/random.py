"""Randomness as a function of a seed, a purpose and the row's key, so that any engine and any recomputation agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STEPS = float(1 << 52)


def uniform(purpose: str, *keys: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1): the first 13 hex digits of an md5."""
    text = F.concat_ws("|", F.lit(str(seed)), F.lit(purpose), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / _STEPS


def uniform_sql(purpose: str, *keys: str, seed: int = 42) -> str:
    """The same in DuckDB."""
    return f"(('0x' || substr(md5(concat_ws('|', '{seed}', '{purpose}', {', '.join(f'({k})::VARCHAR' for k in keys)})), 1, 13))::BIGINT / {_STEPS:.1f})"


def poisson(u: Column, rate: Column) -> Column:
    """The Poisson quantile of u. Rates above 600 use the normal limit."""
    from .stats import poisson_quantile_udf

    large = F.greatest(F.lit(0.0), F.round(rate + F.sqrt(rate) * normal(u)))
    return F.when(rate <= 600, poisson_quantile_udf(u, F.least(rate, F.lit(600.0)))).otherwise(large).cast("long")


def normal(u: Column) -> Column:
    """A rational approximation of the normal quantile, to about 4.5e-4 (Abramowitz and Stegun 26.2.23)."""
    p = F.least(F.greatest(u, F.lit(1e-12)), F.lit(1 - 1e-12))
    t = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    x = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t * t * t)
    return F.when(p < 0.5, -x).otherwise(x)
