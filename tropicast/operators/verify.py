"""Forecast verification.

One aggregate with grouping sets scores every model and lead for the whole period, each
decade and each season; the named scores are projections of it. Rows need ``model, lead,
m, y`` (observation) and the forecast columns they use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import calendar_month, season_number
from ..functions.stats import correlation_p, interval_class, nonneg, normal_cdf, pairs, pearson, ratio
from .folds import DECADES, fold_of, folds_of

# Quantiles and their standard normal scores as used in the score tables.
Z_SCORES = {0.025: -1.959964, 0.16: -0.994458, 0.5: 0.0, 0.84: 0.994458, 0.975: 1.959964}
SKILL_QUANTILES = (0.025, 0.16, 0.84, 0.975)
# Interval grid of the Gaussian class probabilities.
INTERVAL_LOW, INTERVAL_STEP, INTERVAL_COUNT = -3.0, 0.5, 12

MODEL = ("model", "lead")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# row expressions -----------------------------------------------------------------------

def nll_gaussian(y="y", mean="mean", std="std", eps: float = 0.0) -> Column:
    """Negative log-likelihood of a Gaussian without its constant; NULL for std = 0."""
    s = _c(std) + eps if eps else _c(std)
    var = F.when(s > 0, s * s)
    e = _c(y) - _c(mean)
    return 0.5 * F.log(var) + e * e / (2.0 * var)


def nll_skewed(y, location, scale, shape) -> Column:
    """Negative log-likelihood of a skewed Gaussian without its constant."""
    sigma = _c(scale) + 1e-6
    z = (_c(y) - _c(location)) / sigma
    skew = 2.0 * normal_cdf(_c(shape) * z) + 1e-8
    return 0.5 * F.log(sigma * sigma) + 0.5 * z * z - F.log(skew)


def pinball(y, forecast, q) -> Column:
    e = _c(y) - _c(forecast)
    q = F.lit(q) if isinstance(q, (int, float)) else q
    return F.greatest(q * e, (q - 1.0) * e)


def fraction(condition: Column) -> Column:
    """Aggregate: share of rows for which a condition holds, NULL rows left out."""
    return F.avg(condition.cast("double"))


def inside(y="y", mean="mean", std="std", k: float = 1.0) -> Column:
    return (_c(y) > _c(mean) - k * _c(std)) & (_c(y) < _c(mean) + k * _c(std))


def below(y="y", mean="mean", std="std", k: float = 1.0) -> Column:
    return _c(y) < _c(mean) + k * _c(std)


# joins and keys ------------------------------------------------------------------------

def match(forecast: DataFrame, obs: DataFrame, how: str = "inner") -> DataFrame:
    """Forecasts with the observation of their target month as ``y``.

    ``left`` from the observations' side keeps months without a forecast out, and a
    forecast without observation gets NULL.
    """
    return forecast.join(obs.select("m", F.col("value").alias("y")), "m", how)


def with_keys(df: DataFrame, edges=DECADES) -> DataFrame:
    """Add ``decade`` and ``season``."""
    return df.withColumns({"decade": fold_of(F.floor(F.col("m") / 12), edges), "season": season_number("m")})


# scores --------------------------------------------------------------------------------

def rmse(y="y", mean="mean") -> Column:
    e = _c(y) - _c(mean)
    return F.sqrt(F.avg(e * e))


def srmse(y="y", mean="mean") -> Column:
    """RMSE over the spread of the observations (ddof 0) on the same rows."""
    seen = F.when(_c(mean).isNotNull(), _c(y))
    return ratio(rmse(y, mean), F.nullif(F.stddev_pop(seen), F.lit(0.0)))


def score_columns(y="y", mean="mean", std="std") -> list[Column]:
    columns = [
        pearson(y, mean).alias("r"),
        pairs(y, mean).alias("n"),
        rmse(y, mean).alias("rmse"),
        srmse(y, mean).alias("srmse"),
    ]
    if std is not None:
        columns += [
            F.avg(nll_gaussian(y, mean, std)).alias("nll"),
            fraction(inside(y, mean, std, 1.0)).alias("inside1"),
        ]
    return columns


def scores(df: DataFrame, levels, columns=None) -> DataFrame:
    """All requested key levels in one aggregate, ``level`` naming the keys of a row.

    ``levels`` maps a level name to the keys that join ``model, lead``.
    """
    columns = score_columns() if columns is None else columns
    extra = sorted({k for keys in levels.values() for k in keys})
    sets = [[F.col(k) for k in (*MODEL, *keys)] for keys in levels.values()]
    table = df.groupingSets(sets, *MODEL, *extra).agg(
        *columns, *[F.grouping(k).alias(f"_g_{k}") for k in extra]
    )
    level = None
    for name, keys in levels.items():
        hit = reduce(lambda a, b: a & b, [F.col(f"_g_{k}") == (0 if k in keys else 1) for k in extra], F.lit(True))
        level = F.when(hit, name) if level is None else level.when(hit, name)
    out = table.withColumn("level", level)
    for k in extra:  # rows outside every decade have no key
        out = out.where((F.col(f"_g_{k}") == 1) | F.col(k).isNotNull())
    return out.drop(*[f"_g_{k}" for k in extra])


def correlation(df: DataFrame, keys=MODEL) -> DataFrame:
    table = df.groupBy(*keys).agg(pearson("y", "mean").alias("r"), pairs("y", "mean").alias("n"))
    return table.withColumn("p", correlation_p("r", "n"))


def seasonal_srmse(df: DataFrame, keys=MODEL) -> DataFrame:
    return df.groupBy(*keys, "season").agg(srmse().alias("srmse"))


def mean_srmse(df: DataFrame, keys=MODEL) -> DataFrame:
    """Mean of the seasonal values."""
    return seasonal_srmse(df, keys).groupBy(*keys).agg(F.avg("srmse").alias("srmse"))


def explode_decades(df: DataFrame, edges=DECADES, overlap_year: bool = False) -> DataFrame:
    return df.withColumn("decade", F.explode(folds_of("m", edges, overlap_year)))


def gaussian_nll(df: DataFrame, keys=MODEL, eps: float = 0.0) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(nll_gaussian(eps=eps)).alias("nll"))


def quantile_scores(df: DataFrame, quantiles, keys=MODEL, std: str = "std") -> DataFrame:
    """Pinball score of Gaussian quantiles mean + z std, mean and sum per q."""
    rows = df.withColumn("_q", F.explode(_quantile_array(quantiles)))
    loss = pinball("y", F.col("mean") + F.col("_q.z") * F.col(std), F.col("_q.q"))
    return rows.groupBy(*keys, F.col("_q.q").alias("q")).agg(F.avg(loss).alias("qs_mean"), F.sum(loss).alias("qs_sum"))


def _quantile_array(quantiles) -> Column:
    return F.array(*[F.struct(F.lit(q).alias("q"), F.lit(Z_SCORES[q]).alias("z")) for q in quantiles])


def quantile_skill(df: DataFrame, quantiles=SKILL_QUANTILES, keys=MODEL, ref_std: str = "std_estimate") -> DataFrame:
    """1 - QS / QS_ref against quantiles of the climatological spread, in one aggregate."""
    rows = df.withColumn("_q", F.explode(_quantile_array(quantiles)))
    q, z = F.col("_q.q"), F.col("_q.z")
    own = F.sum(pinball("y", F.col("mean") + z * F.col("std"), q))
    ref = F.sum(pinball("y", F.col("mean") + z * F.col(ref_std), q))
    return rows.groupBy(*keys, q.alias("q")).agg((1.0 - ratio(own, F.nullif(ref, F.lit(0.0)))).alias("qss"))


def reliability(df: DataFrame, quantiles=tuple(Z_SCORES), keys=MODEL) -> DataFrame:
    """Observed frequency below each nominal quantile."""
    rows = df.withColumn("_q", F.explode(_quantile_array(quantiles)))
    hit = F.col("y") < F.col("mean") + F.col("_q.z") * F.col("std")
    return rows.groupBy(*keys, F.col("_q.q").alias("q")).agg(fraction(hit).alias("frequency"))


# climatological spread -----------------------------------------------------------------

def std_estimate(matched: DataFrame, obs: DataFrame, edges=DECADES, hold_out: bool = True) -> DataFrame:
    """Monthly spread of the observations (ddof 1) times sqrt(1 - r^2) per model and lead.

    With ``hold_out`` both factors leave out the decade of the target: sums per decade are
    subtracted from the totals instead of copying rows per fold.
    """
    year = F.floor(F.col("m") / 12)
    if not hold_out:
        spread = obs.groupBy(calendar_month("m").alias("month")).agg(F.stddev_samp("value").alias("std_month"))
        skill = matched.groupBy(*MODEL).agg(pearson("y", "mean").alias("r"))
        months = skill.withColumn("month", F.explode(F.sequence(F.lit(1), F.lit(12)))).join(spread, "month")
        return months.select(*MODEL, "month", _shrunk().alias("std_estimate"))
    v = F.col("value")
    by_month = obs.groupBy(calendar_month("m").alias("month"), fold_of(year, edges).alias("decade")).agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss")
    )
    n, s, ss = F.col("n"), F.col("s"), F.col("ss")
    var = ratio(ss - ratio(s * s, n), F.nullif(n - 1, F.lit(0)))
    spread = _without_decade(by_month, ["month"], ["n", "s", "ss"], edges).select(
        "month", "decade", F.sqrt(nonneg(var)).alias("std_month"))
    x, y = F.col("mean"), F.col("y")
    full = matched.where(x.isNotNull() & y.isNotNull())
    sums = full.groupBy(*MODEL, fold_of(year, edges).alias("decade")).agg(
        F.count(x).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"),
        F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"),
    )
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    n, sx, sy, sxx, syy, sxy = map(F.col, names)
    cov, vx, vy = n * sxy - sx * sy, n * sxx - sx * sx, n * syy - sy * sy
    r = ratio(cov, F.nullif(F.sqrt(nonneg(vx)) * F.sqrt(nonneg(vy)), F.lit(0.0)))
    skill = _without_decade(sums, list(MODEL), names, edges).select(*MODEL, "decade", r.alias("r"))
    return skill.join(spread, "decade").select(*MODEL, "decade", "month", _shrunk().alias("std_estimate"))


def _without_decade(sums: DataFrame, keys: list, columns: list, edges) -> DataFrame:
    """Sums of everything but one decade, for every decade: totals minus the decade's own."""
    total = sums.groupBy(*keys).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    total = total.withColumn("decade", F.explode(F.array(*[F.lit(d) for d in edges[:-1]])))
    both = total.join(sums, [*keys, "decade"], "left")
    return both.select(*keys, "decade", *[(F.col(f"_{c}") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in columns])


def _shrunk() -> Column:
    return F.col("std_month") * F.sqrt(nonneg(1.0 - F.col("r") * F.col("r")))


def attach_std(df: DataFrame, estimate: DataFrame, edges=DECADES) -> DataFrame:
    """Hindcast with its climatological spread, looked up by model, lead, month and decade."""
    keyed = df.withColumns({"month": calendar_month("m"), "decade": fold_of(F.floor(F.col("m") / 12), edges)})
    on = [c for c in (*MODEL, "month", "decade") if c in estimate.columns]
    return keyed.join(estimate, on)


# interval probabilities ----------------------------------------------------------------

def interval_probabilities(df: DataFrame, mean="mean", std="std", low=INTERVAL_LOW, step=INTERVAL_STEP, count=INTERVAL_COUNT) -> DataFrame:
    """``class, prob`` rows: mass of the Gaussian in each interval of a complete partition."""
    classes = df.withColumn("class", F.explode(F.sequence(F.lit(0), F.lit(count))))
    edge = lambda k: F.lit(low) + F.lit(step) * k
    cdf = lambda k: normal_cdf((edge(k) - F.col(mean)) / F.nullif(F.col(std), F.lit(0.0)))
    upper = F.when(F.col("class") == count, 1.0).otherwise(cdf(F.col("class")))
    lower = F.when(F.col("class") == 0, 0.0).otherwise(cdf(F.col("class") - 1))
    return classes.withColumn("prob", upper - lower)


def observed_class(y="y", low=INTERVAL_LOW, step=INTERVAL_STEP, count=INTERVAL_COUNT) -> Column:
    return interval_class(y, low, step, count - 1)


def probability_scores(probs: DataFrame, keys=MODEL, row=("m",)) -> DataFrame:
    """Squared probability error summed over classes (Brier) and over cumulative classes (RPS).

    ``probs`` has ``class, prob, obs_class`` for every forecast row.
    """
    per_row = Window.partitionBy(*keys, *row).orderBy("class")
    hit = F.when(F.col("class") == F.col("obs_class"), 1.0).otherwise(0.0)
    reached = F.when(F.col("class") >= F.col("obs_class"), 1.0).otherwise(0.0)
    cumulative = F.sum("prob").over(per_row)
    rows = probs.withColumns({"_b": (F.col("prob") - hit) * (F.col("prob") - hit),
                              "_c": (cumulative - reached) * (cumulative - reached)})
    # sums over rows x classes divided by the number of rows
    n = F.count(F.when(F.col("class") == 0, 1))
    return rows.groupBy(*keys).agg(ratio(F.sum("_b"), n).alias("brier"), ratio(F.sum("_c"), n).alias("rps"))


def probability_skill(own: DataFrame, ref: DataFrame, keys=MODEL) -> DataFrame:
    """Skill of both scores against a reference forecast."""
    r = ref.select(*keys, F.col("brier").alias("brier_ref"), F.col("rps").alias("rps_ref"))
    return own.join(r, list(keys)).select(
        *keys, "brier", "rps", (1.0 - ratio("brier", "brier_ref")).alias("brier_skill"),
        (1.0 - ratio("rps", "rps_ref")).alias("rps_skill"),
    )


SUMMARY_LEVELS = {"median": 0.5, "stdm1": 0.16, "stdp1": 0.84, "stdm2": 0.025, "stdp2": 0.975}


def distribution_summary(probs: DataFrame, keys=("model", "lead", "target_season"), low=-5.0, step=0.25) -> DataFrame:
    """Mode, median and spread classes of class probabilities, and their values.

    A level is the class whose cumulative probability is nearest to it, ties to the lower
    class; its value is the class's lower threshold (``low + (class - 1) step``) plus half a
    step.
    """
    w = Window.partitionBy(*keys).orderBy("class")
    rows = probs.withColumn("_cdf", F.round(F.sum("prob").over(w), 12))
    picks = [F.min_by("class", F.struct(F.round(-F.col("prob"), 12), F.col("class"))).alias("mode_class")]
    picks += [
        F.min_by("class", F.struct(F.round(F.abs(F.col("_cdf") - q), 12), F.col("class"))).alias(f"{name}_class")
        for name, q in SUMMARY_LEVELS.items()
    ]
    out = rows.groupBy(*keys).agg(*picks)
    names = ("mode", *SUMMARY_LEVELS)
    return out.select(*keys, *[f"{n}_class" for n in names],
                      *[(low + (F.col(f"{n}_class") - 1) * step + step / 2.0).alias(n) for n in names])


# comparisons ---------------------------------------------------------------------------

def compare_models(obs: DataFrame, external: DataFrame, max_missing: int = 36) -> DataFrame:
    """r and mean SRMSE per external model and lead over the observed months.

    Months without a forecast count as missing; from ``max_missing`` on the score is NULL.
    The season is the calendar month of the date itself.
    """
    joined = match(external, obs).withColumn("season", calendar_month("m"))
    total = obs.agg(F.count("value")).scalar()
    table = joined.groupBy(*MODEL).agg(pearson("y", "mean").alias("r"), pairs("y", "mean").alias("n"))
    table = table.withColumn("missing", total - F.col("n"))
    both = table.join(mean_srmse(joined), list(MODEL))
    enough = F.col("missing") < max_missing
    return both.select(*MODEL, "n", "missing", F.when(enough, F.col("r")).alias("r"),
                       F.when(enough, F.col("srmse")).alias("srmse"))


def significance(p, levels=(0.01, 0.05, 0.1)) -> Column:
    """Smallest level that p stays below; NULL when none."""
    out = None
    for level in sorted(levels):
        out = F.when(_c(p) < level, level) if out is None else out.when(_c(p) < level, level)
    return out


def confusion(df: DataFrame, classes, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Row-normalised confusion matrix: recall on the diagonal."""
    counts = df.groupBy(truth).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count(F.when(F.col(pred) == c, 1)).alias(f"_c{c}") for c in classes],
    )
    return counts.select(truth, *[ratio(f"_c{c}", "_n").alias(f"pred_{c}") for c in classes])


def error_histogram(df: DataFrame, bins: int = 16, keys=MODEL) -> DataFrame:
    """Counts of forecast errors in equal bins between the smallest and largest error."""
    keys = list(keys)
    rows = df.withColumn("_e", F.col("mean") - F.col("y")).where("_e is not null")
    span = rows.groupBy(*keys).agg(F.min("_e").alias("_lo"), F.max("_e").alias("_hi"))
    place = F.floor(F.coalesce(ratio((F.col("_e") - F.col("_lo")) * bins, F.col("_hi") - F.col("_lo")), F.lit(0.0)))
    # the largest error belongs to the last bin
    binned = rows.join(span, keys).withColumn("bin", F.least(place, F.lit(bins - 1)).cast("int"))
    return binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
