"""Correlations, lag correlations and regression maps.

Lag joins are equi-joins on a month number shifted on one side; all lags are keys of one
aggregate. Results carry r, the p-value and the number of pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import calendar_month
from ..functions.ranks import average_rank
from ..functions.stats import correlation_p, nonneg, pairs, pearson, ratio


def correlate(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """Pearson r, p and n per key."""
    table = df.groupBy(*keys).agg(pearson(x, y).alias("r"), pairs(x, y).alias("n"))
    return table.withColumn("p", correlation_p("r", "n"))


def lag_join(x: DataFrame, y: DataFrame, lags, keys=()) -> DataFrame:
    """Pairs x(t + lag), y(t) for every lag."""
    lags = F.array(*[F.lit(int(v)) for v in lags])
    right = y.select(*keys, F.col("m").alias("m_y"), F.col("value").alias("y"), F.explode(lags).alias("lag"))
    right = right.withColumn("m", F.col("m_y") + F.col("lag"))
    left = x.select(*keys, "m", F.col("value").alias("x"))
    return left.join(right, [*keys, "m"])


def pearson_lag(x: DataFrame, y: DataFrame, max_lags: int = 28, keys=()) -> DataFrame:
    """Lag 0..max_lags (inclusive): r and p of x(t + lag) against y(t)."""
    return correlate(lag_join(x, y, range(max_lags + 1), keys), "x", "y", [*keys, "lag"])


def spearman_lag(x: DataFrame, y: DataFrame, max_lags: int = 80, keys=()) -> DataFrame:
    """Lag 0..max_lags - 1: rank correlation with ranks taken anew at each lag."""
    joined = lag_join(x, y, range(max_lags), keys).dropna(subset=["x", "y"])
    by = [*keys, "lag"]
    ranked = joined.select(*by, average_rank(F.col("x"), by).alias("rx"), average_rank(F.col("y"), by).alias("ry"))
    return ranked.groupBy(*by).agg(pearson("rx", "ry").alias("r"))


def seasonal_autocorrelation(df: DataFrame, max_lag: int = 16, keys=()) -> DataFrame:
    """r and p by target calendar month and lag; p is 1 where r is not positive."""
    joined = lag_join(df, df, range(max_lag), keys).withColumn("month", calendar_month("m"))
    out = correlate(joined, "x", "y", [*keys, "month", "lag"])
    return out.withColumn("p", F.when(F.col("r") <= 0, 1.0).otherwise(F.col("p")))


def yearly_correlation(df: DataFrame, x: str, y: str, time: str = "time") -> DataFrame:
    """Correlation of yearly means."""
    yearly = df.groupBy(F.year(time).alias("year")).agg(F.avg(x).alias("x"), F.avg(y).alias("y"))
    return correlate(yearly, "x", "y")


def regression_map(df: DataFrame, x: str, value: str = "value", cell=("lat", "lon")) -> DataFrame:
    """One predictor with intercept per cell: slope per standard deviation of x, r and p.

    The correlation of the fit with the data is abs(r). The deviation of x (ddof 0) is
    taken over the months of the cell's rows.
    """
    x_, v = F.col(x), F.col(value)
    seen = F.when(v.isNotNull(), x_)
    table = df.groupBy(*cell).agg(
        F.regr_slope(v, x_).alias("slope"),
        F.regr_intercept(v, x_).alias("intercept"),
        F.stddev_pop(x_).alias("_sx"),
        F.stddev_pop(seen).alias("_spread"),
        F.abs(pearson(v, x_)).alias("r"),
        pairs(v, x_).alias("n"),
    )
    slope = F.when(F.col("_spread") > 0, F.col("slope"))
    return table.select(*cell, (slope * F.col("_sx")).alias("coef"), slope.alias("slope"), "intercept",
                        "r", "n").withColumn("p", correlation_p("r", "n"))


def regression_map2(df: DataFrame, x1: str, x2: str, value: str = "value", cell=("lat", "lon")) -> DataFrame:
    """Two predictors without intercept per cell from one pass of sums.

    Coefficients times the deviation (ddof 0) of their predictor, R^2, and r and p of the
    fit against the data.
    """
    a, b, y = F.col(x1), F.col(x2), F.col(value)
    rows = df.where(a.isNotNull() & b.isNotNull() & y.isNotNull())
    s = rows.groupBy(*cell).agg(
        F.sum(a * a).alias("aa"), F.sum(a * b).alias("ab"), F.sum(b * b).alias("bb"),
        F.sum(a * y).alias("ay"), F.sum(b * y).alias("by"), F.sum(y * y).alias("yy"),
        F.sum(a).alias("sa"), F.sum(b).alias("sb"), F.sum(y).alias("sy"),
        F.stddev_pop(a).alias("sd1"), F.stddev_pop(b).alias("sd2"), F.count(y).alias("n"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    s = s.withColumn("c1", ratio(F.col("ay") * F.col("bb") - F.col("by") * F.col("ab"), det))
    s = s.withColumn("c2", ratio(F.col("by") * F.col("aa") - F.col("ay") * F.col("ab"), det))
    c1, c2, n = F.col("c1"), F.col("c2"), F.col("n")
    fit_fit = c1 * c1 * F.col("aa") + 2.0 * c1 * c2 * F.col("ab") + c2 * c2 * F.col("bb")
    fit_y = c1 * F.col("ay") + c2 * F.col("by")
    fit_sum = c1 * F.col("sa") + c2 * F.col("sb")
    sse = F.col("yy") - 2.0 * fit_y + fit_fit
    sst = F.col("yy") - F.col("sy") * F.col("sy") / n
    var_fit = fit_fit - fit_sum * fit_sum / n
    cov = fit_y - fit_sum * F.col("sy") / n
    r = ratio(cov, F.nullif(F.sqrt(nonneg(var_fit * sst)), F.lit(0.0)))
    out = s.select(*cell, (c1 * F.col("sd1")).alias("coef1"), (c2 * F.col("sd2")).alias("coef2"),
                   (1.0 - ratio(sse, sst)).alias("r2"), r.alias("r"), "n")
    return out.withColumn("p", correlation_p("r", "n"))


def residual(df: DataFrame, x: str, y: str, keys=(), out: str = "residual") -> DataFrame:
    """y without the linear influence of x."""
    fit = F.struct(F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept"))
    if keys:
        rows = df.join(df.groupBy(*keys).agg(fit.alias("_fit")), list(keys))
    else:
        rows = df.withColumn("_fit", df.agg(fit.alias("f")).scalar())
    value = F.col(y) - (F.col("_fit.slope") * F.col(x) + F.col("_fit.intercept"))
    return rows.withColumn(out, value).drop("_fit")


def gridded(df: DataFrame, series: DataFrame, name: str = "x") -> DataFrame:
    """Attach a monthly series to every row of a field."""
    return df.join(series.select("m", F.col("value").alias(name)), "m")
