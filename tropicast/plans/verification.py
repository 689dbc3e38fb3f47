"""Forecast verification (J9, R8, V10 to V38)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import calendar_month
from ..operators import ensemble, lagged, regions, verify
from ..operators.folds import fold_of
from .fields import BOX_SQL
from .registry import query, r, rounded
from .sqltext import corr, normal_cdf, p_value
from .views import EDGES, Views

NLL_SQL = "0.5e0 * ln(std * std) + (y - mean) * (y - mean) / (2e0 * std * std)"
SRMSE_SQL = "sqrt(avg((y - mean) * (y - mean))) / nullif(stddev_pop(y), 0)"
MK = "model, lead"


def corr_sql(keys: str, where: str = "TRUE", source: str = "matched") -> str:
    return f"""SELECT {keys}, n, round(r, 6) + 0e0 AS r, round({p_value('r', 'n')}, 6) + 0e0 AS p FROM (
        SELECT {keys}, count(*) AS n, {corr('y', 'mean')} AS r FROM {source} WHERE {where} GROUP BY ALL)"""


def _corr(df, *keys):
    return rounded(verify.correlation(df, keys), "r", "p").select(*keys, "n", "r", "p")


@query("v10", corr_sql(MK))
def v10(v: Views):
    return _corr(v.matched, "model", "lead")


@query("v11", corr_sql("model, lead, decade", "decade IS NOT NULL"))
def v11(v: Views):
    return _corr(v.matched.where("decade is not null"), "model", "lead", "decade")


@query("v12", corr_sql("background, model, lead, season", source="""(SELECT *, unnest(list_concat(['all'],
        CASE WHEN m // 12 - 13 BETWEEN 1982 AND 2015 THEN ['barnston_2019'] ELSE [] END,
        CASE WHEN m // 12 - 13 BETWEEN 1982 AND 2001 THEN ['el-nino-like'] ELSE ['la-nina-like'] END)) AS background FROM matched)"""))
def v12(v: Views):
    regimes = regions.regimes_of(F.floor(F.col("m") / 12) - 13)
    return _corr(v.matched.withColumn("background", F.explode(regimes)), "background", "model", "lead", "season")


@query("v13", "SELECT model, lead, round(sqrt(avg((y - mean) * (y - mean))), 6) + 0e0 AS rmse FROM matched GROUP BY 1, 2")
def v13(v: Views):
    return v.matched.groupBy("model", "lead").agg(r(verify.rmse()).alias("rmse"))


@query("v14", f"SELECT model, lead, season, round({SRMSE_SQL}, 6) + 0e0 AS srmse FROM matched GROUP BY 1, 2, 3")
def v14(v: Views):
    return rounded(verify.seasonal_srmse(v.matched), "srmse")


@query("v15", f"SELECT model, lead, round(avg(s), 6) + 0e0 AS srmse FROM (SELECT model, lead, season, {SRMSE_SQL} AS s FROM matched GROUP BY 1, 2, 3) GROUP BY 1, 2")
def v15(v: Views):
    return rounded(verify.mean_srmse(v.matched), "srmse")


DECADES_SQL = "(VALUES (1995, 1997), (1997, 1999), (1999, 2001), (2001, 2002)) d(lo, hi)"


@query("v16", f"""SELECT overlap, model, lead, decade, round(avg(s), 6) + 0e0 AS srmse FROM (
    SELECT overlap, model, lead, lo AS decade, season, {SRMSE_SQL} AS s FROM matched, {DECADES_SQL}, (VALUES (false, 0), (true, 12)) o(overlap, extra)
    WHERE m >= 12 * lo AND m < 12 * hi + extra GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4""")
def v16(v: Views):
    parts = []
    for overlap in (False, True):
        rows = verify.explode_decades(v.matched.drop("decade"), EDGES, overlap)
        parts.append(verify.mean_srmse(rows, ("model", "lead", "decade")).withColumn("overlap", F.lit(overlap)))
    return rounded(parts[0].unionByName(parts[1]), "srmse")


@query("v17", f"SELECT model, lead, round(avg({NLL_SQL}), 6) + 0e0 AS nll FROM matched GROUP BY 1, 2")
def v17(v: Views):
    return rounded(verify.gaussian_nll(v.matched), "nll")


@query("v18", f"""SELECT model, lead, level, decade, season, round(nll, 6) + 0e0 AS nll FROM (
    SELECT model, lead, 'season' AS level, NULL::INT AS decade, season, avg({NLL_SQL}) AS nll FROM matched GROUP BY ALL
    UNION ALL SELECT model, lead, 'decade', decade, NULL, avg({NLL_SQL}) FROM matched WHERE decade IS NOT NULL GROUP BY ALL
    UNION ALL SELECT model, lead, 'training', NULL, NULL, avg({NLL_SQL.replace('std', '(std + 1e-6)')}) FROM matched GROUP BY ALL)""")
def v18(v: Views):
    nll = [F.avg(verify.nll_gaussian()).alias("nll")]
    table = verify.scores(v.matched, {"season": ("season",), "decade": ("decade",)}, nll)
    training = verify.gaussian_nll(v.matched, eps=1e-6).select(
        "model", "lead", F.lit("training").alias("level"), F.lit(None).cast("int").alias("decade"),
        F.lit(None).cast("int").alias("season"), "nll")
    return rounded(table.select(*training.columns).unionByName(training), "nll")


@query("v19", f"""SELECT model, lead, round(avg(0.5e0 * ln(s * s) + 0.5e0 * z * z - ln(2e0 * {normal_cdf('(1.5e0 * z)')} + 1e-8)), 6) + 0e0 AS nll
    FROM (SELECT model, lead, std + 1e-6 AS s, (y - mean) / (std + 1e-6) AS z FROM matched) GROUP BY 1, 2""")
def v19(v: Views):
    loss = verify.nll_skewed("y", "mean", "std", F.lit(1.5))
    return v.matched.groupBy("model", "lead").agg(r(F.avg(loss)).alias("nll"))


Q_SQL = "(VALUES (0.025e0, -1.959964e0), (0.16e0, -0.994458e0), (0.5e0, 0e0), (0.84e0, 0.994458e0), (0.975e0, 1.959964e0)) k(q, z)"
PIN_SQL = "greatest(q * (y - mean - z * {0}), (q - 1e0) * (y - mean - z * {0}))"


@query("v20", f"SELECT model, lead, q, round(avg({PIN_SQL.format('std')}), 6) + 0e0 AS qs_mean, round(sum({PIN_SQL.format('std')}), 5) + 0e0 AS qs_sum FROM matched, {Q_SQL} GROUP BY 1, 2, 3")
def v20(v: Views):
    table = verify.quantile_scores(v.matched, tuple(verify.Z_SCORES))
    return table.withColumns({"qs_mean": r("qs_mean"), "qs_sum": r("qs_sum", 5)})


# leave-one-decade-out spread: rows copied per held-out decade
EST_SQL = f"""SELECT f.model, f.lead, f.decade, s.month, s.std * sqrt(greatest(1 - f.r * f.r, 0)) AS std_estimate FROM (
      SELECT model, lead, lo AS decade, {corr('y', 'mean')} AS r FROM matched, {DECADES_SQL} WHERE NOT (m >= 12 * lo AND m < 12 * hi) GROUP BY 1, 2, 3) f
    JOIN (SELECT lo AS decade, (m % 12 + 1)::INT AS month, stddev_samp(value) AS std FROM idx, {DECADES_SQL} WHERE NOT (m >= 12 * lo AND m < 12 * hi) GROUP BY 1, 2) s
      ON s.decade = f.decade"""
WITH_EST = f"WITH est AS ({EST_SQL}), h AS (SELECT a.*, e.std_estimate FROM matched a JOIN est e ON e.model = a.model AND e.lead = a.lead AND e.decade = a.decade AND e.month = a.m % 12 + 1)"


def estimated(v: Views):
    estimate = verify.std_estimate(v.matched, v.idx, EDGES)
    return verify.attach_std(v.matched.drop("decade"), estimate, EDGES)


@query("v21", WITH_EST + f""" SELECT period, model, lead, q, round(1 - sum({PIN_SQL.format('std')}) / nullif(sum({PIN_SQL.format('std_estimate')}), 0), 5) + 0e0 AS qss FROM (
    SELECT h.*, unnest(CASE WHEN m < 1999 * 12 THEN ['all', 'early'] ELSE ['all', 'late'] END) AS period FROM h), {Q_SQL.replace('(0.5e0, 0e0), ', '')} GROUP BY 1, 2, 3, 4""")
def v21(v: Views):
    part = F.when(F.col("m") < 1999 * 12, "early").otherwise("late")
    rows = estimated(v).withColumn("period", F.explode(F.array(F.lit("all"), part)))
    return rounded(verify.quantile_skill(rows, keys=("period", "model", "lead")), "qss", digits=5)


@query("v22", "SELECT model, lead, " + ", ".join(
    f"round(avg((y > mean - {k} * std AND y < mean + {k} * std)::INT), 6) + 0e0 AS inside_{n}" for n, k in (("1", "1e0"), ("196", "1.96e0"), ("2", "2e0"))
) + " FROM matched GROUP BY 1, 2")
def v22(v: Views):
    return v.matched.groupBy("model", "lead").agg(*[
        r(verify.fraction(verify.inside(k=k))).alias(f"inside_{n}") for n, k in (("1", 1.0), ("196", 1.96), ("2", 2.0))])


@query("v23", "SELECT model, lead, round(avg((y < mean + std)::INT), 6) + 0e0 AS below_1, round(avg((y < mean - 1.96e0 * std)::INT), 6) + 0e0 AS below_m196 FROM matched GROUP BY 1, 2")
def v23(v: Views):
    return v.matched.groupBy("model", "lead").agg(r(verify.fraction(verify.below(k=1.0))).alias("below_1"),
                                                  r(verify.fraction(verify.below(k=-1.96))).alias("below_m196"))


def _quantile_columns(v: Views):
    return v.matched.withColumns({"low": F.col("mean") - 0.8 * F.col("std"), "high": F.col("mean") + 1.3 * F.col("std")})


@query("v24", "SELECT model, lead, round(avg((y > mean - 0.8e0 * std AND y < mean + 1.3e0 * std)::INT), 6) + 0e0 AS inside FROM matched GROUP BY 1, 2")
def v24(v: Views):
    y = F.col("y")
    return _quantile_columns(v).groupBy("model", "lead").agg(
        r(verify.fraction((y > F.col("low")) & (y < F.col("high")))).alias("inside"))


@query("v25", "SELECT model, lead, round(avg((y < mean + 1.3e0 * std)::INT), 6) + 0e0 AS below FROM matched GROUP BY 1, 2")
def v25(v: Views):
    return _quantile_columns(v).groupBy("model", "lead").agg(r(verify.fraction(F.col("y") < F.col("high"))).alias("below"))


@query("v26", f"SELECT model, lead, q, round(avg((y < mean + z * std)::INT), 6) + 0e0 AS frequency FROM matched, {Q_SQL} GROUP BY 1, 2, 3")
def v26(v: Views):
    return rounded(verify.reliability(v.matched), "frequency")


@query("v27", f"""SELECT 'hold_out' AS variant, model, lead, decade, month, round(std_estimate, 5) + 0e0 AS std_estimate FROM ({EST_SQL})
    UNION ALL SELECT 'whole', f.model, f.lead, NULL, s.month, round(s.std * sqrt(greatest(1 - f.r * f.r, 0)), 5) + 0e0 FROM (
      SELECT model, lead, {corr('y', 'mean')} AS r FROM matched GROUP BY 1, 2) f, (SELECT (m % 12 + 1)::INT AS month, stddev_samp(value) AS std FROM idx GROUP BY 1) s""")
def v27(v: Views):
    own = verify.std_estimate(v.matched, v.idx, EDGES).withColumn("variant", F.lit("hold_out"))
    whole = verify.std_estimate(v.matched, v.idx, EDGES, hold_out=False).withColumns(
        {"variant": F.lit("whole"), "decade": F.lit(None).cast("int")})
    return rounded(own.unionByName(whole), "std_estimate", digits=5)


@query("v28", WITH_EST + " SELECT model, lead, target_season, mean, std, round(std_estimate, 5) + 0e0 AS std_estimate FROM h")
def v28(v: Views):
    return estimated(v).select("model", "lead", "target_season", "mean", "std", r("std_estimate", 5).alias("std_estimate"))


@query("j9", WITH_EST + " SELECT model, lead, m, decade, (m % 12 + 1)::INT AS month, round(std_estimate, 5) + 0e0 AS std_estimate FROM h")
def j9(v: Views):
    return estimated(v).select("model", "lead", "m", "decade", "month", r("std_estimate", 5).alias("std_estimate"))


def prob_sql(mean: str, std: str, source: str, keys: str) -> str:
    up = normal_cdf(f"((-3e0 + 0.5e0 * k - {mean}) / {std})")
    low = normal_cdf(f"((-3e0 + 0.5e0 * (k - 1) - {mean}) / {std})")
    return f"""SELECT {keys}, k AS class, (CASE WHEN k = 12 THEN 1e0 ELSE {up} END) - (CASE WHEN k = 0 THEN 0e0 ELSE {low} END) AS prob,
        greatest(least(ceil((y + 3e0) / 0.5e0), 12), 0)::INT AS obs_class FROM {source}, (SELECT unnest(range(0, 13))::INT AS k)"""


@query("v29", f"SELECT model, lead, m, class, round(prob, 7) + 0e0 AS prob FROM ({prob_sql('mean', 'std', 'matched', 'model, lead, m')})")
def v29(v: Views):
    return verify.interval_probabilities(v.matched).select("model", "lead", "m", "class", r("prob", 7).alias("prob"))


def brier_sql(probs: str, tag: str) -> str:
    return f"""SELECT model, lead, sum((prob - (class = obs_class)::INT)^2) / count(CASE WHEN class = 0 THEN 1 END) AS brier{tag},
        sum((cum - (class >= obs_class)::INT)^2) / count(CASE WHEN class = 0 THEN 1 END) AS rps{tag} FROM (
        SELECT *, sum(prob) OVER (PARTITION BY model, lead, m ORDER BY class) AS cum FROM ({probs})) GROUP BY 1, 2"""


@query("v30", WITH_EST + f""", a AS ({brier_sql(prob_sql('mean', 'std', 'h', 'model, lead, m'), '')}), b AS ({brier_sql(prob_sql('mean', 'std_estimate', 'h', 'model, lead, m'), '_ref')})
    SELECT a.model, a.lead, round(brier, 6) + 0e0 AS brier, round(rps, 6) + 0e0 AS rps, round(1 - brier / brier_ref, 5) + 0e0 AS brier_skill, round(1 - rps / rps_ref, 5) + 0e0 AS rps_skill
    FROM a JOIN b ON a.model = b.model AND a.lead = b.lead""")
def v30(v: Views):
    rows = estimated(v).withColumn("obs_class", verify.observed_class())
    own = verify.probability_scores(verify.interval_probabilities(rows))
    ref = verify.probability_scores(verify.interval_probabilities(rows, std="std_estimate"))
    out = verify.probability_skill(own, ref)
    return out.withColumns({"brier": r("brier"), "rps": r("rps"), "brier_skill": r("brier_skill", 5), "rps_skill": r("rps_skill", 5)})


@query("v31", f"""SELECT model, lead, target_season, mode_class, median_class, stdm1_class, stdp1_class, stdm2_class, stdp2_class, {', '.join(f'-3e0 + ({n}_class - 1) * 0.5e0 + 0.25e0 AS "{n}"' for n in ('mode', 'median', 'stdm1', 'stdp1', 'stdm2', 'stdp2'))} FROM (
    SELECT model, lead, target_season, min_by(class, round(-prob, 12) * 1e3 + class * 1e-8) AS mode_class, {', '.join(f'min_by(class, round(abs(cdf - {q}), 12) * 1e3 + class * 1e-8) AS {n}_class' for n, q in (('median', '0.5e0'), ('stdm1', '0.16e0'), ('stdp1', '0.84e0'), ('stdm2', '0.025e0'), ('stdp2', '0.975e0')))} FROM (
      SELECT *, round(sum(prob) OVER (PARTITION BY model, lead, target_season ORDER BY class), 12) AS cdf FROM ({prob_sql('mean', 'std', 'matched', 'model, lead, target_season')})) GROUP BY 1, 2, 3)""")
def v31(v: Views):
    return verify.distribution_summary(verify.interval_probabilities(v.matched), low=-3.0, step=0.5)


@query("v32", "SELECT model, lead, target_season, round(3.92e0 * std, 6) + 0e0 AS spread, round((mean + 1.959964e0 * std) - (mean - 1.959964e0 * std), 6) + 0e0 AS quantile_spread FROM fct")
def v32(v: Views):
    z = verify.Z_SCORES
    high, low = F.col("mean") + z[0.975] * F.col("std"), F.col("mean") + z[0.025] * F.col("std")
    return v.fct.select("model", "lead", "target_season", r(2.0 * 1.96 * F.col("std")).alias("spread"), r(high - low).alias("quantile_spread"))


@query("v33", "SELECT model, lead, target_season, " + ", ".join(f"round(mean {s} {k}e0 * std, 6) + 0e0 AS {n}" for n, s, k in (("m2", "-", 2), ("m1", "-", 1), ("p1", "+", 1), ("p2", "+", 2))) + " FROM fct")
def v33(v: Views):
    return v.fct.select("model", "lead", "target_season", *[
        r(F.col("mean") + k * F.col("std")).alias(n) for n, k in (("m2", -2.0), ("m1", -1.0), ("p1", 1.0), ("p2", 2.0))])


@query("v34", f"""WITH j AS (SELECT e.model, e.lead, (e.m % 12 + 1)::INT AS season, e.mean, o.value AS y FROM ext e JOIN idx o ON e.m = o.m),
    a AS (SELECT model, lead, count(CASE WHEN mean IS NOT NULL THEN 1 END) AS n, {corr('y', 'mean')} AS r FROM j GROUP BY 1, 2),
    b AS (SELECT model, lead, avg(s) AS srmse FROM (SELECT model, lead, season, sqrt(avg((y - mean)^2)) / nullif(stddev_pop(CASE WHEN mean IS NOT NULL THEN y END), 0) AS s FROM j GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT a.model, a.lead, n, k - n AS missing, round(CASE WHEN k - n < 36 THEN r END, 6) + 0e0 AS r, round(CASE WHEN k - n < 36 THEN srmse END, 6) + 0e0 AS srmse
    FROM a JOIN b ON a.model = b.model AND a.lead = b.lead, (SELECT count(value) AS k FROM idx)""")
def v34(v: Views):
    return rounded(verify.compare_models(v.idx, v.ext), "r", "srmse")


MODELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("v35", "SELECT f.lead, f.m, f.mean, f.std, " + ", ".join(f"max(CASE WHEN e.model = '{n}' THEN e.mean END) AS {n.lower()}" for n in MODELS)
       + " FROM fct f JOIN ext e ON e.m = f.m AND e.lead = f.lead WHERE f.model = 'trailing' GROUP BY 1, 2, 3, 4")
def v35(v: Views):
    own = v.fct.where(F.col("model") == "trailing").select("lead", "m", "mean", "std")
    wide = v.ext.groupBy("lead", "m").pivot("model").agg(F.first("mean"))
    return own.join(wide.toDF(*[n.lower() for n in wide.columns]), ["lead", "m"])


@query("v36", f"SELECT model, lead, season, CASE WHEN p < 0.01 THEN 0.01e0 WHEN p < 0.05 THEN 0.05e0 WHEN p < 0.1 THEN 0.1e0 END AS level, coalesce(p < 0.05, false) AS significant FROM (SELECT model, lead, season, {p_value('r', 'n')} AS p FROM (SELECT model, lead, season, count(*) AS n, {corr('y', 'mean')} AS r FROM matched GROUP BY 1, 2, 3))")
def v36(v: Views):
    table = verify.correlation(v.matched, ("model", "lead", "season"))
    return table.select("model", "lead", "season", verify.significance("p").alias("level"),
                        F.coalesce(F.col("p") < 0.05, F.lit(False)).alias("significant"))


@query("v37", f"""SELECT model, lead, level, decade, season, n, round(r, 6) + 0e0 AS r, round(srmse, 6) + 0e0 AS srmse FROM (
    SELECT model, lead, 'all' AS level, NULL::INT AS decade, NULL::INT AS season, count(*) AS n, {corr('y', 'mean')} AS r, {SRMSE_SQL} AS srmse FROM matched GROUP BY ALL
    UNION ALL SELECT model, lead, 'decade', decade, NULL, count(*), {corr('y', 'mean')}, {SRMSE_SQL} FROM matched WHERE decade IS NOT NULL GROUP BY ALL
    UNION ALL SELECT model, lead, 'season', NULL, season, count(*), {corr('y', 'mean')}, {SRMSE_SQL} FROM matched GROUP BY ALL)""")
def v37(v: Views):
    table = verify.scores(v.matched, {"all": (), "decade": ("decade",), "season": ("season",)})
    return rounded(table.select("model", "lead", "level", "decade", "season", "n", "r", "srmse"), "r", "srmse")


def _field_forecast(v: Views):
    """Field persistence: the map of three months earlier as forecast."""
    return v.fld.select("lat", "lon", (F.col("m") + 3).alias("m"), F.col("value").alias("value"))


@query("v38", f"""WITH o AS ({BOX_SQL.format(-5, 5, 140, 200)}),
    i AS (SELECT o.m, o.value AS y, p.value AS mean FROM o JOIN o p ON p.m = o.m - 3),
    c AS (SELECT f.lat, f.lon, count(*) AS n, {corr('f.value', 'p.value')} AS r, sqrt(avg((f.value - p.value)^2)) AS rmse FROM fld f JOIN fld p ON f.lat = p.lat AND f.lon = p.lon AND f.m = p.m + 3 GROUP BY 1, 2)
    SELECT 'index' AS part, NULL::DOUBLE AS lat, NULL::DOUBLE AS lon, count(*) AS n, round({corr('y', 'mean')}, 5) + 0e0 AS r, round(sqrt(avg((y - mean)^2)), 5) + 0e0 AS rmse FROM i
    UNION ALL SELECT 'cell', lat, lon, n, round(r, 5) + 0e0, round(rmse, 5) + 0e0 FROM c""")
def v38(v: Views):
    forecast = _field_forecast(v)
    box = ((-5, 5), (140, 200))
    obs_index = regions.box_mean(v.fld, *box, keys=("m",))
    fc_index = regions.box_mean(forecast, *box, keys=("m",)).withColumnRenamed("value", "mean")
    both = fc_index.join(obs_index.withColumnRenamed("value", "y"), "m")
    score = [F.count(F.lit(1)).alias("n"), r(verify.pearson("y", "mean"), 5).alias("r"), r(verify.rmse(), 5).alias("rmse")]
    index = both.agg(*score).select(F.lit("index").alias("part"), F.lit(None).cast("double").alias("lat"),
                                    F.lit(None).cast("double").alias("lon"), "n", "r", "rmse")
    cells = forecast.withColumnRenamed("value", "mean").join(v.fld.select("lat", "lon", "m", F.col("value").alias("y")), ["lat", "lon", "m"])
    maps = cells.groupBy("lat", "lon").agg(*score).select(F.lit("cell").alias("part"), "lat", "lon", "n", "r", "rmse")
    return index.unionByName(maps)


@query("r8", """SELECT target_season, m, round(mu, 6) + 0e0 AS mean, round(CASE WHEN k = f THEN sqrt(greatest(second - mu * mu, 0)) END, 5) + 0e0 AS std FROM (
    SELECT target_season, m, avg(mean) AS mu, avg(mean * mean + std * std) AS second, count(mean) AS k, count(std) AS f FROM ens GROUP BY 1, 2)""")
def r8(v: Views):
    out = ensemble.gaussian_mixture(v.ens, ("target_season", "m"))
    return out.withColumns({"mean": r("mean"), "std": r("std", 5)})
