"""Gridded fields: filters, joins, climatology, regions, regridding, patterns (F, J, A, G, E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.calendar import calendar_month, season_number
from ..functions.stats import pairs, pearson, ratio
from ..operators import climatology as clim
from ..operators import ensemble, eof, folds, lagged, regions, regrid, verify, windows
from .registry import query, r, rounded
from .sqltext import corr, date
from .views import EDGES, REFERENCE, Views

CLIM_SQL = f"""SELECT lat, lon, (m % 12 + 1)::INT AS k, avg(value) AS mean, stddev_pop(value) AS std FROM fld
    WHERE time BETWEEN DATE '{REFERENCE[0]}' AND DATE '{REFERENCE[1]}' GROUP BY 1, 2, 3"""
ANOM_SQL = f"""SELECT f.time, f.m, f.lat, f.lon, f.value, f.value - c.mean AS anom, (f.value - c.mean) / nullif(c.std, 0) AS normanom
    FROM fld f JOIN ({CLIM_SQL}) c ON f.lat = c.lat AND f.lon = c.lon AND f.m % 12 + 1 = c.k"""


def anomalies(v: Views):
    return clim.anomaly(v.fld, clim.climatology(v.fld, "month", REFERENCE), "month")


# filters -------------------------------------------------------------------------------


@query("f1", "SELECT series, time, m, value FROM series WHERE time BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def f1(v: Views):
    return v.series.where(F.col("time").between(F.lit("1996-01-01").cast("date"), F.lit("1999-12-31").cast("date")))


@query("f2", "SELECT time, m, lat, lon, value FROM fld WHERE lat BETWEEN -2.5 AND 5 AND lon BETWEEN 140 AND 180")
def f2(v: Views):
    return regions.box(v.fld_once, (5.0, -2.5), (140.0, 180.0))


@query("f3", "SELECT time, m, lat, lon, value FROM fld WHERE lat = 0")
def f3(v: Views):
    return regions.box(v.fld_once, (0.0, 0.0), (0.0, 360.0))


@query("f4", """SELECT background, count(*) AS n, round(avg(value), 6) + 0e0 AS mean FROM (
    SELECT unnest(list_concat(['all'],
        CASE WHEN m // 12 - 13 BETWEEN 1982 AND 2015 THEN ['barnston_2019'] ELSE [] END,
        CASE WHEN m // 12 - 13 BETWEEN 1982 AND 2001 THEN ['el-nino-like'] ELSE ['la-nina-like'] END)) AS background, value
    FROM fld) GROUP BY 1""")
def f4(v: Views):
    # the tables start in 1995; years are shifted so that both regimes occur
    year = F.floor(F.col("m") / 12) - 13
    rows = v.fld.select("value", F.explode(regions.regimes_of(year)).alias("background"))
    return rows.groupBy("background").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))


WINTER = {0: (11, 12), 1: (1, 2)}
EVENT_SQL = """SELECT DISTINCT kind, ((year + o) * 12 + k - 1)::INT AS m FROM event_years,
    (VALUES (0, 11), (0, 12), (1, 1), (1, 2)) AS w(o, k)"""


@query("f5", f"SELECT time, m, lat, lon, value FROM fld WHERE m IN (SELECT m FROM ({EVENT_SQL}) WHERE kind = 'warm')")
def f5(v: Views):
    warm = v.event_years.where(F.col("kind") == "warm")
    return regions.select_events(v.fld_once, warm, WINTER).select("time", "m", "lat", "lon", "value")


@query("f6", """SELECT part, count(*) AS n, round(avg(value), 6) + 0e0 AS mean FROM (
    SELECT CASE WHEN m // 12 >= 1997 AND m // 12 < 1999 THEN 'test' ELSE 'train' END AS part, value FROM fld) GROUP BY 1""")
def f6(v: Views):
    fold = folds.fold_of(F.floor(F.col("m") / 12), EDGES)
    part = F.when(fold == 1997, "test").otherwise("train")
    return v.fld_once.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))


@query("f7", """SELECT lat, lon, count(value) AS n FROM (SELECT lat, lon, CASE WHEN lon < 200 OR lat > 0 THEN value END AS value FROM fld)
    GROUP BY 1, 2 HAVING count(value) > 0""")
def f7(v: Views):
    land = v.fld.withColumn("value", F.when((F.col("lon") < 200) | (F.col("lat") > 0), F.col("value")))
    return regions.drop_empty_cells(land).groupBy("lat", "lon").agg(F.count("value").alias("n"))


@query("f8", f"""SELECT model, lead, n, missing, round(CASE WHEN missing < 36 THEN r END, 6) + 0e0 AS r FROM (
    SELECT e.model, e.lead, count(CASE WHEN e.mean IS NOT NULL AND o.value IS NOT NULL THEN 1 END) AS n,
      (SELECT count(value) FROM idx) - count(CASE WHEN e.mean IS NOT NULL AND o.value IS NOT NULL THEN 1 END) AS missing,
      {corr('o.value', 'e.mean')} AS r FROM ext e JOIN idx o ON e.m = o.m GROUP BY 1, 2)""")
def f8(v: Views):
    return rounded(verify.compare_models(v.idx, v.ext, 36), "r").drop("srmse")


# joins ---------------------------------------------------------------------------------


@query("j1", "SELECT a.time, a.m, [a.value, b.value, c.value] AS x FROM idx a JOIN idx2 b ON a.m = b.m JOIN idx3 c ON a.m = c.m")
def j1(v: Views):
    from ..operators.prepare import aligned

    wide = aligned(v.series, ["oni", "wwv", "iod"])
    return wide.select("time", "m", F.array("oni", "wwv", "iod").alias("x"))


@query("j2", "SELECT f.model, f.lead, f.target_season, f.m, f.mean, f.std, o.value AS y FROM fct f JOIN idx o ON f.m = o.m")
def j2(v: Views):
    return verify.match(v.fct, v.idx).select("model", "lead", "target_season", "m", "mean", "std", "y")


@query("j3", f"SELECT f.m, f.lat, f.lon, f.value, round(c.mean, 6) + 0e0 AS mean, round(c.std, 6) + 0e0 AS std FROM fld f JOIN ({CLIM_SQL}) c ON f.lat = c.lat AND f.lon = c.lon AND f.m % 12 + 1 = c.k")
def j3(v: Views):
    joined = clim.with_climatology(v.fld, clim.climatology(v.fld, "month", REFERENCE))
    return rounded(joined, "mean", "std").select("m", "lat", "lon", "value", "mean", "std")


@query("j4", "SELECT l.lag, a.m, a.value AS x, b.value AS y FROM idx a, idx2 b, (SELECT unnest(range(0, 13))::INT AS lag) l WHERE a.m = b.m + l.lag")
def j4(v: Views):
    return lagged.lag_join(v.idx, v.idx2, range(13)).select("lag", "m", "x", "y")


@query("j5", """SELECT l.lag, (a.m % 12 + 1)::INT AS month, count(*) AS n, round(avg(a.value * b.value), 5) + 0e0 AS xy
    FROM idx a, idx b, (SELECT unnest(range(0, 16))::INT AS lag) l WHERE a.m = b.m + l.lag GROUP BY 1, 2""")
def j5(v: Views):
    rows = lagged.lag_join(v.idx, v.idx, range(16))
    return rows.groupBy("lag", calendar_month("m").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), r(F.avg(F.col("x") * F.col("y")), 5).alias("xy"))


@query("j8", """SELECT target_season, m, lead, round(max(CASE WHEN o = 'low' THEN v END), 6) + 0e0 AS low,
    round(max(CASE WHEN o = 'mid' THEN v END), 6) + 0e0 AS mid, round(max(CASE WHEN o = 'high' THEN v END), 6) + 0e0 AS high FROM (
      SELECT target_season, m, lead, 'low' AS o, mean - std AS v FROM fct WHERE model = 'persistence'
      UNION ALL SELECT target_season, m, lead, 'mid', mean FROM fct WHERE model = 'persistence'
      UNION ALL SELECT target_season, m, lead, 'high', mean + std FROM fct WHERE model = 'persistence') GROUP BY 1, 2, 3""")
def j8(v: Views):
    own = v.fct.where(F.col("model") == "persistence")
    outputs = F.array(*[F.struct(F.lit(n).alias("output"), (F.col("mean") + k * F.col("std")).alias("value"))
                        for n, k in (("low", -1.0), ("mid", 0.0), ("high", 1.0))])
    long = own.select("target_season", "m", "lead", F.inline(outputs))
    return rounded(ensemble.merge_outputs(long, ["low", "mid", "high"]), "low", "mid", "high")


# climatology ---------------------------------------------------------------------------


@query("a1", """SELECT max(step)::INT AS max_step, CASE WHEN max(step) = 1 THEN 'dayofyear' WHEN max(step) BETWEEN 28 AND 31 THEN 'month' END AS period, source FROM (
    SELECT source, date_diff('day', lag(time) OVER (PARTITION BY source ORDER BY time), time) AS step FROM (
      SELECT DISTINCT 'daily' AS source, time FROM daily UNION SELECT DISTINCT 'monthly', time FROM fld)) GROUP BY source""")
def a1(v: Views):
    d = clim.period_steps(v.daily).withColumn("source", F.lit("daily"))
    return d.unionByName(clim.period_steps(v.fld).withColumn("source", F.lit("monthly")))


@query("a2", f"SELECT lat, lon, k AS period_key, round(mean, 6) + 0e0 AS mean FROM ({CLIM_SQL})")
def a2(v: Views):
    return rounded(clim.climatology(v.fld_once, "month", REFERENCE), "mean").drop("std")


@query("a3", """SELECT key, dayofyear(time)::INT AS period_key, round(avg(value), 6) + 0e0 AS mean, round(stddev_pop(value), 6) + 0e0 AS std
    FROM daily GROUP BY 1, 2 UNION ALL
    SELECT 'field', (m % 12 + 1)::INT, round(avg(value), 6) + 0e0, round(stddev_pop(value), 6) + 0e0 FROM fld GROUP BY 1, 2""")
def a3(v: Views):
    d = clim.climatology(v.daily, "dayofyear", None, ("key",))
    f = clim.climatology(v.fld.withColumn("key", F.lit("field")), "month", None, ("key",))
    return rounded(d.unionByName(f), "mean", "std")


@query("a4", f"SELECT time, m, lat, lon, round(anom, 6) + 0e0 AS value FROM ({ANOM_SQL})")
def a4(v: Views):
    return rounded(anomalies(v), "value")


@query("a5", f"SELECT time, m, lat, lon, round(normanom, 6) + 0e0 AS value FROM ({ANOM_SQL})")
def a5(v: Views):
    table = clim.climatology(v.fld, "month", REFERENCE)
    return rounded(clim.anomaly(v.fld, table, "month", normalised=True), "value")


@query("a6", f"SELECT time, m, lat, lon, value, round(anom, 6) + 0e0 AS anom, round(normanom, 6) + 0e0 AS normanom FROM ({ANOM_SQL})")
def a6(v: Views):
    return rounded(clim.postprocess(v.fld, "month", REFERENCE), "anom", "normanom")


# regions -------------------------------------------------------------------------------

BOX_SQL = """SELECT time, m, round(avg(v), 6) + 0e0 AS value FROM (
    SELECT time, m, lon, avg(value) AS v FROM fld WHERE lat BETWEEN {0} AND {1} AND lon BETWEEN {2} AND {3} GROUP BY 1, 2, 3) GROUP BY 1, 2"""


@query("a7", BOX_SQL.format(-5, 5, 120, 200))
def a7(v: Views):
    return rounded(regions.box_mean(v.fld_once, (-5, 5), (120, 200)), "value")


@query("a8", """SELECT 'means' AS variant, basin, time, m, round(avg(v), 6) + 0e0 AS value FROM (
      SELECT time, m, lon, avg(value) AS v FROM fld WHERE lat BETWEEN -2.5 AND 2.5 GROUP BY 1, 2, 3) f
      JOIN (VALUES ('west', 120, 160), ('centre', 160, 180), ('east', 180, 240)) b(basin, lo, hi) ON lon BETWEEN lo AND hi GROUP BY 1, 2, 3, 4
    UNION ALL
    SELECT 'edges', basin, time, m, round(CASE WHEN basin = 'west' THEN max(v) ELSE avg(v) END, 6) + 0e0 FROM (
      SELECT time, m, lon, avg(value) AS v FROM fld WHERE lat BETWEEN -2.5 AND 2.5 GROUP BY 1, 2, 3) f
      JOIN (VALUES ('whole', 120, 240), ('west', 120, 160), ('centre', 160, 210)) b(basin, lo, hi) ON lon BETWEEN lo AND hi GROUP BY 1, 2, 3, 4""")
def a8(v: Views):
    means = regions.basin_means(v.fld).withColumn("variant", F.lit("means"))
    edges = regions.basin_edges(v.fld).withColumn("variant", F.lit("edges"))
    return rounded(means.unionByName(edges), "value")


@query("a9", BOX_SQL.format(-5, 5, 190, 240))
def a9(v: Views):
    lat, lon = regions.ONI_BOX
    return rounded(regions.box_mean(v.fld_once, lat, lon), "value")


@query("a10", f"SELECT kind, lat, lon, round(avg(value), 6) + 0e0 AS value FROM fld JOIN ({EVENT_SQL}) e ON fld.m = e.m GROUP BY 1, 2, 3")
def a10(v: Views):
    return rounded(regions.composite(v.fld_once, v.event_years, WINTER), "value")


@query("a11", "SELECT (m % 12 + 1)::INT AS month, round(stddev_samp(value), 6) + 0e0 AS std FROM idx GROUP BY 1")
def a11(v: Views):
    return v.idx.groupBy(calendar_month("m").alias("month")).agg(r(F.stddev_samp("value")).alias("std"))


@query("a12", """SELECT model, lead, (m % 12 + 1)::INT AS month, round(stddev_pop(y), 6) + 0e0 AS std_obs, round(stddev_pop(mean), 6) + 0e0 AS std_pred,
    round(avg(std), 6) + 0e0 AS mean_std FROM matched GROUP BY 1, 2, 3""")
def a12(v: Views):
    return v.matched.groupBy("model", "lead", calendar_month("m").alias("month")).agg(
        r(F.stddev_pop("y")).alias("std_obs"), r(F.stddev_pop("mean")).alias("std_pred"), r(F.avg("std")).alias("mean_std"))


@query("a13", f"""SELECT round({corr('x', 'y')}, 6) + 0e0 AS r, count(*) AS n FROM (
    SELECT m // 12 AS year, avg(mean) AS x, avg(y) AS y FROM matched WHERE model = 'trailing' AND lead = 0 GROUP BY 1)""")
def a13(v: Views):
    rows = v.matched.where((F.col("model") == "trailing") & (F.col("lead") == 0))
    return rounded(lagged.yearly_correlation(rows, "mean", "y", "target_season"), "r").select("r", "n")


CLASS_SQL = "CASE WHEN {0} > 0.5 THEN 2 WHEN {0} < -0.5 THEN 0 WHEN {0} IS NOT NULL THEN 1 END"


@query("a14", f"SELECT truth, round(avg((pred = 0)::INT), 6) + 0e0 AS pred_0, round(avg((pred = 1)::INT), 6) + 0e0 AS pred_1, round(avg((pred = 2)::INT), 6) + 0e0 AS pred_2 FROM (SELECT ({CLASS_SQL.format('y')})::INT AS truth, {CLASS_SQL.format('mean')} AS pred FROM matched) GROUP BY 1")
def a14(v: Views):
    from ..functions.ranks import threshold_category

    rows = v.matched.select(threshold_category("y", 0.5).alias("truth"), threshold_category("mean", 0.5).alias("pred"))
    return rounded(verify.confusion(rows, (0, 1, 2)), "pred_0", "pred_1", "pred_2")


@query("a15", """SELECT model, lead, bin, count(*) AS n FROM (
    SELECT model, lead, least(floor(coalesce((e - lo) * 16 / nullif(hi - lo, 0), 0)), 15)::INT AS bin FROM (
      SELECT model, lead, mean - y AS e, min(mean - y) OVER w AS lo, max(mean - y) OVER w AS hi FROM matched
      WINDOW w AS (PARTITION BY model, lead))) GROUP BY 1, 2, 3""")
def a15(v: Views):
    return verify.error_histogram(v.matched)


# regridding ----------------------------------------------------------------------------


@query("g1", """WITH tlat AS (SELECT -90e0 + 2.5e0 * i AS t FROM (SELECT unnest(range(0, 73)) AS i)),
    tlon AS (SELECT 2.5e0 * i AS t FROM (SELECT unnest(range(0, 144)) AS i)),
    slat AS (SELECT DISTINCT lat AS s FROM fld), slon AS (SELECT DISTINCT lon AS s FROM fld),
    blat AS (SELECT t, max(CASE WHEN s <= t THEN s END) AS lo, min(CASE WHEN s >= t THEN s END) AS hi FROM tlat, slat GROUP BY 1),
    blon AS (SELECT t, max(CASE WHEN s <= t THEN s END) AS lo, min(CASE WHEN s >= t THEN s END) AS hi FROM tlon, slon GROUP BY 1),
    wlat AS (SELECT t, s, w, count(*) OVER (PARTITION BY t) AS n FROM (
      SELECT t, lo AS s, CASE WHEN hi > lo THEN (hi - t) / (hi - lo) ELSE 1e0 END AS w FROM blat WHERE lo IS NOT NULL AND hi IS NOT NULL
      UNION ALL SELECT t, hi, (t - lo) / (hi - lo) FROM blat WHERE hi > lo) WHERE w > 0),
    wlon AS (SELECT t, s, w, count(*) OVER (PARTITION BY t) AS n FROM (
      SELECT t, lo AS s, CASE WHEN hi > lo THEN (hi - t) / (hi - lo) ELSE 1e0 END AS w FROM blon WHERE lo IS NOT NULL AND hi IS NOT NULL
      UNION ALL SELECT t, hi, (t - lo) / (hi - lo) FROM blon WHERE hi > lo) WHERE w > 0)
    SELECT time, m, wlat.t AS lat, wlon.t AS lon,
      round(CASE WHEN count(value) = max(wlat.n * wlon.n) THEN sum(value * wlat.w * wlon.w) END, 5) + 0e0 AS value
    FROM fld JOIN wlat ON fld.lat = wlat.s JOIN wlon ON fld.lon = wlon.s GROUP BY 1, 2, 3, 4""")
def g1(v: Views):
    return rounded(regrid.regrid(v.fld), "value", digits=5)


# patterns ------------------------------------------------------------------------------

DETREND_SQL = """SELECT lat, lon, m, v - (intercept + slope * t) AS value FROM (
    SELECT lat, lon, m, t, v, regr_slope(v, t) OVER w AS slope, regr_intercept(v, t) OVER w AS intercept FROM (
      SELECT c.lat, c.lon, a.m, (a.m - (SELECT min(m) FROM {0}))::DOUBLE AS t, coalesce(f.value, 0e0) AS v
      FROM (SELECT DISTINCT lat, lon FROM {0}) c CROSS JOIN (SELECT unnest(range((SELECT min(m) FROM {0}), (SELECT max(m) + 1 FROM {0})))::INT AS m) a
      LEFT JOIN {0} f ON f.lat = c.lat AND f.lon = c.lon AND f.m = a.m)
    WINDOW w AS (PARTITION BY lat, lon))"""


def pattern_input(v: Views):
    return anomalies(v).select("lat", "lon", "m", "value")


@query("e1", f"SELECT lat, lon, m, round(value, 5) + 0e0 AS value FROM ({DETREND_SQL.format('fld')})")
def e1(v: Views):
    return rounded(eof.detrended(v.fld), "value", digits=5)


def patterns_sql(detrended: str, k: int) -> str:
    """CTEs ``x`` (detrended), ``basis`` (mode, v, value) and ``patterns`` (lat, lon, mode, loading).

    The projector on the leading pattern is the limit of repeated squaring of the products between cells; what it explains is taken off
    before the next.
    """
    square = "list_transform(b, lambda p: list_transform(b, lambda q: list_dot_product(p, q)))"
    trace = "list_sum(list_transform({0}, lambda p, n: p[n]))"
    scaled = f"list_transform(s, lambda p: list_transform(p, lambda y: CASE WHEN {trace.format('s')} > 0 THEN y / {trace.format('s')} ELSE 0e0 END))"
    steps = []
    for j in range(1, k + 1):
        rest = "SELECT g FROM gram" if j == 1 else f"""SELECT list_transform(g, lambda p, n: list_transform(p, lambda y, o: y - value * v[n] * v[o])) AS g FROM rest{j - 1}, top{j - 1}"""
        steps.append(f"""rest{j} AS MATERIALIZED ({rest}),
    power{j}(i, b) AS (SELECT 0, {scaled} FROM (SELECT g AS s FROM rest{j}) UNION ALL SELECT i + 1, {scaled} FROM (SELECT i, {square} AS s FROM power{j} WHERE i < 45)),
    top{j} AS MATERIALIZED (SELECT v, list_dot_product(v, list_transform(g, lambda p: list_dot_product(p, v))) AS value FROM (
        SELECT g, list_transform(u, lambda y: y * CASE WHEN list_max(u) >= -list_min(u) THEN 1e0 ELSE -1e0 END / greatest(sqrt(list_dot_product(u, u)), 1e-300)) AS v FROM (
            SELECT g, b[list_position(list_transform(b, lambda p, n: p[n]), list_max(list_transform(b, lambda p, n: p[n])))] AS u FROM power{j}, rest{j} WHERE i = 45)))""")
    union = " UNION ALL ".join(f"SELECT {j} AS mode, v, value FROM top{j}" for j in range(1, k + 1))
    return f"""WITH RECURSIVE x AS MATERIALIZED ({detrended}),
    cells AS MATERIALIZED (SELECT lat, lon, row_number() OVER (ORDER BY lat, lon) AS n, avg(value) AS mean FROM x GROUP BY 1, 2),
    z AS MATERIALIZED (SELECT m, n, value - mean AS value FROM x JOIN cells ON cells.lat = x.lat AND cells.lon = x.lon),
    gram AS MATERIALIZED (SELECT list(p ORDER BY n) AS g FROM (SELECT a.n, list(s ORDER BY b) AS p FROM (SELECT a.n, b.n AS b, sum(a.value * b.value) AS s FROM z a JOIN z b ON a.m = b.m GROUP BY 1, 2) a GROUP BY 1)),
    {", ".join(steps)}, basis AS ({union}),
    patterns AS (SELECT lat, lon, mode::INT AS mode, v[n] AS loading, value FROM cells, basis)"""


# anomalies against the reference months, detrended
ANOM_SQL = "(SELECT f.lat, f.lon, f.m, f.value - c.mean AS value FROM fld f JOIN (SELECT lat, lon, m % 12 AS month, avg(value) AS mean FROM fld WHERE time BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' GROUP BY 1, 2, 3) c ON c.lat = f.lat AND c.lon = f.lon AND c.month = f.m % 12)"
SMOOTH_SQL = f"(SELECT lat, lon, m, CASE WHEN count(value) OVER w = 60 THEN avg(value) OVER w END AS value FROM {ANOM_SQL} WINDOW w AS (PARTITION BY lat, lon ORDER BY m RANGE BETWEEN 59 PRECEDING AND CURRENT ROW))"
PCS_SQL = """ SELECT m, round(pca1, 5) + 0e0 AS pca1, round(pca2, 5) + 0e0 AS pca2, round(pca3, 5) + 0e0 AS pca3 FROM (
    SELECT m, sum(value * loading) FILTER (WHERE mode = 1) AS pca1, sum(value * loading) FILTER (WHERE mode = 2) AS pca2, sum(value * loading) FILTER (WHERE mode = 3) AS pca3
    FROM (SELECT m, x.value, loading, mode FROM x JOIN patterns p ON p.lat = x.lat AND p.lon = x.lon) GROUP BY 1)"""


@query("e2", patterns_sql(DETREND_SQL.format(ANOM_SQL), 3) + " SELECT lat, lon, mode, round(loading, 6) + 0e0 AS loading FROM patterns")
def e2(v: Views):
    return rounded(eof.fit(pattern_input(v), 3, detrend=True).patterns, "loading")


@query("e3", patterns_sql(DETREND_SQL.format(ANOM_SQL), 3) + PCS_SQL)
def e3(v: Views):
    pcs = eof.wide_projection(eof.fit(pattern_input(v), 3, detrend=True).project())
    return rounded(pcs, "pca1", "pca2", "pca3", digits=5)


@query("e4", patterns_sql(DETREND_SQL.format(ANOM_SQL), 1) + f""" SELECT p.lat, p.lon, CASE WHEN l.m IS NOT NULL THEN round(loading, 6) + 0e0 END AS loading
    FROM patterns p LEFT JOIN (SELECT lat, lon, m FROM {ANOM_SQL} WHERE value IS NOT NULL AND m = (SELECT max(m) FROM fld)) l ON l.lat = p.lat AND l.lon = p.lon""")
def e4(v: Views):
    field = pattern_input(v)
    return rounded(eof.pattern_map(eof.fit(field, 3, detrend=True), field, 1), "loading")


@query("e5", patterns_sql(DETREND_SQL.format(ANOM_SQL), 5) + " SELECT mode::INT AS mode, round(value / (SELECT sum(value * value) FROM z), 6) + 0e0 AS ratio FROM basis")
def e5(v: Views):
    return rounded(eof.fit(pattern_input(v), 5, detrend=True).explained_variance(), "ratio")


@query("e6", patterns_sql(DETREND_SQL.format(SMOOTH_SQL), 3) + PCS_SQL)
def e6(v: Views):
    smooth = windows.rolling_mean(pattern_input(v), 60, ("lat", "lon"))
    pcs = eof.wide_projection(eof.fit(smooth, 3, detrend=True).project())
    return rounded(pcs, "pca1", "pca2", "pca3", digits=5)


@query("e7", "WITH b AS (SELECT * FROM fld WHERE time BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND lat BETWEEN -2.5 AND 2.5 AND lon BETWEEN 120 AND 200) "
       + f"SELECT lat, lon, m, round(value, 5) + 0e0 AS value FROM ({DETREND_SQL.format('b')})")
def e7(v: Views):
    from ..session import scratch_path
    from ..sources.store import Store

    store = Store(v.spark, scratch_path(v.spark, "store"), start="1996-01", end="2000-12", lat=(-2.5, 2.5), lon=(120, 200))
    store.write_field(v.fld, "sst", "ERSSTv5")
    return rounded(eof.detrended(store.read_field("sst", "ERSSTv5")), "value", digits=5)
