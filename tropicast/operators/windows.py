"""Window operators over monthly tables.

A window partition is one series or one grid cell and holds one row per month, so its
size is bounded by the calendar, not by the data volume.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_date, month_number


def rolling_mean(df: DataFrame, n: int, keys=(), value: str = "value", out: str = "value") -> DataFrame:
    """Trailing mean over n calendar months, NULL until all n are present."""
    w = Window.partitionBy(*keys).orderBy("m").rangeBetween(-(n - 1), 0)
    full = F.count(value).over(w) == n
    return df.withColumn(out, F.when(full, F.avg(value).over(w)))


def lag_embedding(df: DataFrame, columns: list, n_lags: int, step: int = 1, keys=("series",)) -> DataFrame:
    """Feature vector ``x`` of lags 0, step, ..., (n_lags - 1) step of each column.

    Ordered lag by lag, columns within a lag; the first ``n_lags * step`` rows go.
    """
    w = Window.partitionBy(*keys).orderBy("m")
    lags = range(max(n_lags, 1))
    x = F.array(*[F.lag(c, i * step).over(w) if i else F.col(c) for i in lags for c in columns])
    out = df.withColumn("_row", F.row_number().over(w)).withColumn("x", x)
    return out.where(F.col("_row") > n_lags * step).drop("_row")


def labels(df: DataFrame, leads, shift: int = 3, keys=("series",), keep_future: bool = False) -> DataFrame:
    """Label and persistence at each lead: y(t + lead + shift) and y(t).

    The label comes from an equi-join on the target month, one job for all leads.
    """
    base = df.withColumn("lead", F.explode(F.array(*[F.lit(int(v)) for v in leads])))
    base = base.withColumn("m_target", F.col("m") + F.col("lead") + F.lit(shift))
    truth = df.select(*keys, F.col("m").alias("m_target"), F.col("value").alias("y"))
    out = base.join(truth, [*keys, "m_target"], "left" if keep_future else "inner")
    return out.select(*keys, "lead", "time", "m", "m_target", month_date("m_target").alias("target_season"),
                      *[c for c in df.columns if c not in (*keys, "time", "m", "value")],
                      "y", F.col("value").alias("y_persistence"))


def gradient(df: DataFrame, keys=(), value: str = "value", out: str = "value") -> DataFrame:
    """Time derivative: central differences, one-sided at the ends of the time axis.

    A neighbour that is missing makes the derivative NULL.
    """
    ends = df.agg(F.struct(F.min("m").alias("first"), F.max("m").alias("last")).alias("e")).scalar()
    w = Window.partitionBy(*keys).orderBy("m")
    m = F.col("m")
    before = F.when(F.lag("m").over(w) == m - 1, F.lag(value).over(w))
    after = F.when(F.lead("m").over(w) == m + 1, F.lead(value).over(w))
    rows = df.withColumns({"_before": before, "_after": after, "_ends": ends})
    slope = (
        F.when(m == F.col("_ends.first"), F.col("_after") - F.col(value))
        .when(m == F.col("_ends.last"), F.col(value) - F.col("_before"))
        .otherwise((F.col("_after") - F.col("_before")) / 2.0)
    )
    return rows.withColumn(out, slope).drop("_before", "_after", "_ends")


def window_ends(m, size: int, first, last) -> Column:
    """All window-end months (stamps) whose window of ``size`` months contains ``m``."""
    m = F.col(m) if isinstance(m, str) else m
    low = F.greatest(m, first + F.lit(size - 1))
    high = F.least(m + F.lit(size - 1), last)
    return F.when(low <= high, F.sequence(low, F.greatest(low, high)))


def evolving_windows(df: DataFrame, size: int = 12) -> DataFrame:
    """Each row once per moving window it belongs to, keyed by ``window_end``.

    Windows move by one month, lie inside the time axis, and are stamped with the first
    day of their last month.
    """
    ends = df.agg(F.struct(F.min("m").alias("first"), F.max("m").alias("last")).alias("e")).scalar()
    rows = df.withColumn("_e", ends)
    rows = rows.withColumn("window_m", F.explode(window_ends("m", size, F.col("_e.first"), F.col("_e.last"))))
    return rows.withColumn("window_end", month_date("window_m")).drop("_e")


def upsample(df: DataFrame, keys=("lat", "lon")) -> DataFrame:
    """Linear interpolation of a coarse series to every month, by days."""
    w = Window.partitionBy(*keys).orderBy("time")
    rows = df.withColumns({"_t1": F.lead("time").over(w), "_v1": F.lead("value").over(w)})
    last = F.coalesce(F.add_months("_t1", -1), F.col("time"))
    rows = rows.withColumn("_t", F.explode(F.sequence("time", last, F.expr("interval 1 month"))))
    share = F.try_divide(F.date_diff("_t", "time").cast("double"), F.date_diff("_t1", "time").cast("double"))
    value = F.when(F.col("_t") == F.col("time"), F.col("value")).otherwise(
        F.col("value") + (F.col("_v1") - F.col("value")) * share
    )
    return rows.select(*keys, F.col("_t").alias("time"), month_number("_t").alias("m"), value.alias("value"))


def episodes(df: DataFrame, threshold: float = 0.5, keys=("series",), split_on_sign: bool = True,
             drop_open: bool = False) -> DataFrame:
    """Maximal runs with abs(value) >= threshold: start, end, peak, sign and intensity.

    ``split_on_sign`` ends a run where the sign flips; ``drop_open`` leaves out a run that
    reaches the end of the series.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("m")
    v = F.col("value")
    active = F.coalesce(F.abs(v) >= threshold, F.lit(False))
    rows = df.withColumn("_on", active)
    fresh = ~F.coalesce(F.lag("_on").over(w), F.lit(False))
    if split_on_sign:
        fresh = fresh | (F.signum(F.lag("value").over(w)) != F.signum(v))
    rows = rows.withColumn("_start", F.when(F.col("_on") & fresh, 1).otherwise(0))
    rows = rows.withColumn("episode", F.sum("_start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_last", F.max("m").over(Window.partitionBy(*keys)))
    rows = rows.withColumn("_top", F.max(F.abs(v)).over(Window.partitionBy(*keys)))
    runs = rows.where("_on").groupBy(*keys, "episode").agg(
        F.min("time").alias("start"),
        F.max("time").alias("end"),
        F.max(F.abs(v)).alias("peak"),
        F.signum(F.min_by("value", "m")).cast("int").alias("sign"),
        F.max("_top").alias("_top"),
        (F.max("m") == F.max("_last")).alias("_open"),
    )
    if drop_open:
        runs = runs.where(~F.col("_open"))
    intensity = F.try_divide(F.col("peak") - threshold, F.col("_top") - threshold) * 0.5
    return runs.select(*keys, F.col("episode").cast("int").alias("episode"), "start", "end", "peak", "sign",
                       intensity.alias("intensity"))
