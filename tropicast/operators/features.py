"""Feature tables ``lead, m, m_target, target_season, x, y, y_persistence``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sampling import pick, uniform
from ..functions.stats import standardise
from .folds import LEADS
from .prepare import aligned, seasonal_cycle
from .regions import regime
from .windows import lag_embedding, labels


def features(series: DataFrame, target: str, predictors: list, leads=LEADS, n_lags: int = 3, step: int = 3,
             shift: int = 3, scale: dict | None = None, cycle: bool = True, noise: int = 0,
             keep_future: bool = False, seed: int = 0, held_out: tuple | None = None) -> DataFrame:
    """Aligned predictors, standardised (ddof 0), lag-embedded and labelled for all leads.

    ``cycle`` appends the seasonal-cycle pair, ``noise`` that many normal columns;
    ``keep_future`` keeps rows whose target month has no observation yet. Scaling uses the
    whole series; with ``held_out`` (first year, end year) it leaves those years out.
    """
    names = list(dict.fromkeys([*predictors, target]))
    wide = aligned(series, names, scale).withColumn("value", F.col(target))
    columns = list(predictors)
    wide = wide.select("time", "m", "value", *[F.col(c).alias(f"x_{c}") for c in columns])
    columns = [f"x_{c}" for c in columns]
    if cycle:
        first = wide.agg(F.min("m")).scalar()
        cos, sin = seasonal_cycle("m", F.col("_first"))
        wide = wide.withColumn("_first", first).withColumns({"x_cos": cos, "x_sin": sin}).drop("_first")
        columns += ["x_cos", "x_sin"]
    for i in range(noise):
        wide = wide.withColumn(f"x_noise{i}", normal_noise("m", F.lit(i), seed=seed))
        columns.append(f"x_noise{i}")
    year = F.floor(F.col("m") / 12)
    fit_on = None if held_out is None else ~((year >= held_out[0]) & (year < held_out[1]))
    wide = standardise(wide, columns, impute=True, fit_on=fit_on)
    lagged = lag_embedding(wide.withColumn("series", F.lit(target)), columns, n_lags, step)
    lagged = lagged.select("series", "time", "m", "value", "x")
    out = labels(lagged, leads, shift, keep_future=keep_future)
    # the label is the observed index, also where its own features are not complete yet
    return out.drop("series")


def normal_noise(*identity, seed: int = 0):
    """Standard normal from two uniforms (Box-Muller)."""
    u1 = 1.0 - uniform(*identity, seed=2 * seed + 1)
    u2 = uniform(*identity, seed=2 * seed + 2)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2.0 * 3.141592653589793 * u2)


def field_features(field: DataFrame, lead, shift: int = 3, n: int = 3, cell=("lat", "lon")) -> DataFrame:
    """Field-to-field rows: a cell's rolling mean and the same cell ``lead + shift`` later.

    Long form: a time's map stays distributed over its cells. ``lead`` is one lead or a list.
    """
    from .windows import rolling_mean

    smooth = rolling_mean(field, n, cell).where(F.col("value").isNotNull()).select(*cell, "m", "value")
    leads = F.explode(F.lit([lead] if isinstance(lead, int) else list(lead)))
    later = smooth.withColumn("lead", leads).select(
        *cell, "lead", (F.col("m") - F.col("lead") - shift).alias("m"), F.col("value").alias("y"))
    return smooth.join(later, [*cell, "m"]).select(
        *cell, "lead", "m", (F.col("m") + F.col("lead") + shift).alias("m_target"), F.col("value").alias("x"), "y"
    )


def balanced_sample(df: DataFrame, n: int = 1000, seed: int = 0, keys=("lead",), year: str = "year") -> DataFrame:
    """``n`` draws with replacement from each background regime of each key.

    Draws are numbered rows joined on a random position; positions are numbered per key
    and regime, whose months are bounded by the calendar.
    """
    groups = [*keys, "regime"]
    rows = df.withColumn("regime", regime(year))
    w = Window.partitionBy(*groups)
    rows = rows.withColumns({"_r": F.row_number().over(w.orderBy("m")) - 1})
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n"))
    draws = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draws = draws.withColumn("_r", pick(F.col("_n"), *groups, "draw", seed=seed))
    return draws.drop("_n").join(rows, [*groups, "_r"]).drop("_r")
