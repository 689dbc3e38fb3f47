"""Statistics as column expressions.

Conventions: NULL means missing (never NaN), and an undefined ratio is NULL, so a
constant series scores NULL instead of failing the job.
"""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 (error of erf below 1.5e-7).
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_nan(x) -> Column:
    """NaN to NULL."""
    x = _c(x)
    return F.when(~F.isnan(x), x)


def ratio(a, b) -> Column:
    return F.try_divide(_c(a).cast("double"), _c(b).cast("double"))


def nonneg(x) -> Column:
    """Rounding errors below 0 to 0; NULL stays NULL (unlike ``greatest``)."""
    x = _c(x)
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def pearson(x, y) -> Column:
    """Aggregate: Pearson r over the rows where both sides are present."""
    x, y = _c(x), _c(y)
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.try_divide(F.covar_pop(x, y), spread)


def pairs(x, y) -> Column:
    """Aggregate: number of rows where both sides are present."""
    return F.count(F.when(_c(x).isNotNull() & _c(y).isNotNull(), F.lit(1)))


def normal_cdf(z) -> Column:
    """Standard normal distribution function."""
    z = _c(z)
    u = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + ERF_P * u)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = 1.0 - poly * F.exp(-u * u)
    return 0.5 * (1.0 + F.signum(z) * erf)


# nodes and weights of a quadrature on (0, 1), the same for every number of pairs
_NODES = [((1 + float(x)) / 2, float(w) / 2) for x, w in zip(*np.polynomial.legendre.leggauss(64), strict=True)]


def correlation_p(r, n) -> Column:
    """Two-sided p-value of a Pearson r from ``n`` pairs (Student t, n - 2 degrees).

    With sin(a) = abs(r), p is the share of the integral of cos^(n-3) over (0, pi/2) that lies
    beyond a. Both integrals stop nine standard widths on, where the integrand is below 1e-17, so one
    quadrature serves every n.
    """
    r, df = _c(r), _c(n).cast("double") - 2.0
    angle = F.asin(F.least(F.abs(r), F.lit(1.0)))
    nodes = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(w).alias("w")) for x, w in _NODES])

    def integral(start):
        width = F.least(F.lit(math.pi / 2) - start, 9.0 / F.sqrt(df))

        def add(total, node):
            half = F.sin((start + width * node["x"]) / 2.0)
            return total + node["w"] * F.exp((df - 1.0) * F.log1p(F.greatest(-2.0 * half * half, F.lit(-1.0 + 1e-16))))

        return width * F.aggregate(nodes, F.lit(0.0), add)

    p = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(F.least(integral(angle) / integral(F.lit(0.0)), F.lit(1.0)))
    return F.when((df >= 1) & r.isNotNull(), F.greatest(p, F.lit(0.0)))


def standardise(df: DataFrame, columns, keys=(), ddof: int = 0, impute=False, fit_on: Column | None = None) -> DataFrame:
    """Replace each column by (x - mean) / std within ``keys``.

    ``ddof`` 0 or 1 picks the spread; with ``impute`` a constant column divides by 1
    and a missing value becomes the mean, that is 0. ``fit_on`` limits the rows that mean
    and spread are taken from (the training months, say).
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    std = F.stddev_samp if ddof else F.stddev_pop
    keys = list(keys)
    seen = {c: F.col(c) if fit_on is None else F.when(fit_on, F.col(c)) for c in columns}
    aggs = [f(seen[c]).alias(f"_{name}_{c}") for c in columns for name, f in (("mean", F.avg), ("std", std))]
    out = _with_stats(df, keys, aggs)
    for c in columns:
        spread = F.col(f"_std_{c}")
        if impute:
            spread = F.when(spread > 0, spread).otherwise(1.0)
        z = F.try_divide(F.col(c) - F.col(f"_mean_{c}"), spread)
        out = out.withColumn(c, F.coalesce(z, F.lit(0.0)) if impute else z)
    return out.drop(*[f"_{n}_{c}" for c in columns for n in ("mean", "std")])


def scale_max(df: DataFrame, column: str, keys=()) -> DataFrame:
    """Divide a column by its largest magnitude within ``keys``."""
    out = _with_stats(df, list(keys), [F.max(F.abs(F.col(column))).alias("_peak")])
    return out.withColumn(column, F.try_divide(F.col(column), F.col("_peak"))).drop("_peak")


def _with_stats(df: DataFrame, keys: list, aggs: list) -> DataFrame:
    """Attach grouped aggregates to every row: a join by key, or one scalar subquery."""
    if keys:
        return df.join(df.groupBy(*keys).agg(*aggs), keys)
    packed = df.agg(F.struct(*aggs).alias("_stats"))
    out = df.withColumn("_stats", packed.scalar())
    return out.select(*df.columns, "_stats.*")


def unstandardise(df: DataFrame, value: str, mean: str, std: str) -> Column:
    """Back from standardised to physical units."""
    return F.col(value) * F.col(std) + F.col(mean)


def interval_class(x, low: float, step: float, n_inner: int) -> Column:
    """Class of a value over right-closed intervals of a regular threshold grid.

    Class 0 is everything up to ``low``; class ``n_inner + 1`` everything above the last
    threshold; the classes form a complete partition of the line.
    """
    k = F.ceil((_c(x) - F.lit(low)) / F.lit(step)).cast("int")
    return F.least(F.greatest(k, F.lit(0)), F.lit(n_inner + 1))
