"""Index series: windows, sorts, scalar functions, correlation and regression (W, L, X, C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ranks, stats
from ..functions.calendar import calendar_month
from ..operators import features, lagged, learners, prepare, verify, windows
from ..operators import climatology as clim
from ..session import cut
from .fields import ANOM_SQL, anomalies
from .registry import query, r, rounded
from .sqltext import corr, date, normal_cdf, p_value
from .views import REFERENCE, Views

# windows -------------------------------------------------------------------------------


@query("w1", """SELECT lat, lon, m, round(CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END, 6) + 0e0 AS value
    FROM fld WINDOW w AS (PARTITION BY lat, lon ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def w1(v: Views):
    return rounded(windows.rolling_mean(v.fld_once, 3, ("lat", "lon")), "value").select("lat", "lon", "m", "value")


@query("w2", """SELECT series, m, [value, l3, l6] AS x FROM (SELECT series, m, value, lag(value, 3) OVER w AS l3, lag(value, 6) OVER w AS l6,
    row_number() OVER w AS n FROM series WINDOW w AS (PARTITION BY series ORDER BY m)) WHERE n > 9""")
def w2(v: Views):
    return windows.lag_embedding(v.series, ["value"], 3, 3).select("series", "m", "x")


@query("w3", """SELECT a.series, l.lead, a.m, a.m + l.lead + 3 AS m_target, b.value AS y, a.value AS y_persistence
    FROM series a, (SELECT unnest([0,3,6,9,12,15,18,21])::INT AS lead) l, series b WHERE b.series = a.series AND b.m = a.m + l.lead + 3""")
def w3(v: Views):
    out = windows.labels(v.series, (0, 3, 6, 9, 12, 15, 18, 21))
    return out.select("series", "lead", "m", "m_target", "y", "y_persistence")


@query("w4", """SELECT m, round(avg(g), 6) + 0e0 AS value FROM (SELECT m, lon,
    CASE WHEN m = (SELECT min(m) FROM fld) THEN nx - value WHEN m = (SELECT max(m) FROM fld) THEN value - pv ELSE (nx - pv) / 2e0 END AS g FROM (
      SELECT m, lon, value, CASE WHEN lead(m) OVER w = m + 1 THEN lead(value) OVER w END AS nx, CASE WHEN lag(m) OVER w = m - 1 THEN lag(value) OVER w END AS pv
      FROM fld WHERE lat = 0 WINDOW w AS (PARTITION BY lat, lon ORDER BY m))) GROUP BY 1""")
def w4(v: Views):
    slope = windows.gradient(v.fld, ("lat", "lon"))
    return slope.where("lat = 0").groupBy("m").agg(r(F.avg("value")).alias("value"))


@query("w5", f"""SELECT {date('e')} AS window_end, count(*) AS n, round(avg(value), 6) + 0e0 AS mean FROM (
    SELECT unnest(range(greatest(m, (SELECT min(m) + 11 FROM fld)), least(m + 11, (SELECT max(m) FROM fld)) + 1)) AS e, value FROM fld) GROUP BY 1""")
def w5(v: Views):
    rows = windows.evolving_windows(v.fld, 12)
    return rows.groupBy("window_end").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))


@query("w6", """SELECT series, t AS time, (year(t) * 12 + month(t) - 1)::INT AS m,
    round(CASE WHEN t = time THEN value ELSE value + (v1 - value) * date_diff('day', time, t) / date_diff('day', time, t1) END, 6) + 0e0 AS value FROM (
      SELECT series, time, value, t1, v1, unnest(generate_series(time, coalesce(t1 - INTERVAL 1 MONTH, time)::DATE, INTERVAL 1 MONTH))::DATE AS t FROM (
        SELECT series, time, value, lead(time) OVER w AS t1, lead(value) OVER w AS v1 FROM (
          SELECT series, make_date(m // 3 * 3 // 12, m // 3 * 3 % 12 + 1, 1) AS time, round(avg(value), 6) + 0e0 AS value FROM series GROUP BY 1, 2)
        WINDOW w AS (PARTITION BY series ORDER BY time)))""")
def w6(v: Views):
    from ..functions.calendar import month_date

    start = (F.floor(F.col("m") / 3) * 3).cast("int")
    quarterly = v.series.groupBy("series", month_date(start).alias("time")).agg(r(F.avg("value")).alias("value"))
    return rounded(windows.upsample(quarterly, ("series",)), "value")


EPISODE_SQL = """WITH f AS (SELECT series, time, m, value, coalesce(abs(value) >= 0.5, false) AS on_ FROM idx),
    s AS (SELECT *, CASE WHEN on_ AND (NOT coalesce(lag(on_) OVER w, false) OR coalesce(sign(lag(value) OVER w) <> sign(value), false)) THEN 1 ELSE 0 END AS st
      FROM f WINDOW w AS (PARTITION BY series ORDER BY m)),
    e AS (SELECT *, sum(st) OVER (PARTITION BY series ORDER BY m)::INT AS episode FROM s)
    SELECT series, episode, min(time) AS "start", max(time) AS "end", max(abs(value)) AS peak, sign(min_by(value, m))::INT AS sign,
      round((max(abs(value)) - 0.5e0) / nullif((SELECT max(abs(value)) FROM idx) - 0.5e0, 0) * 0.5e0, 6) + 0e0 AS intensity
    FROM e WHERE on_ GROUP BY 1, 2"""


@query("w7", EPISODE_SQL)
def w7(v: Views):
    return rounded(windows.episodes(v.idx, 0.5), "intensity")


@query("w8", """SELECT series, 'largest' AS kind, position, m, value FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value DESC, m)::INT AS position FROM series) WHERE position <= 5
    UNION ALL SELECT series, 'lowest', position, m, value FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY value, m)::INT AS position FROM series) WHERE position <= 5""")
def w8(v: Views):
    top = ranks.top_k(v.series, 5, [F.desc("value"), F.asc("m")], ("series",)).withColumn("kind", F.lit("largest"))
    low = ranks.top_k(v.series, 5, [F.asc("value"), F.asc("m")], ("series",)).withColumn("kind", F.lit("lowest"))
    return top.unionByName(low).select("series", "kind", "position", "m", "value")


@query("w9", """WITH p AS (SELECT o_orderkey, o_totalprice AS x FROM orders),
    s AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () // 5 AS k FROM p),
    c AS (SELECT list(x) AS cuts FROM s WHERE i IN (k, 2 * k, 3 * k, 4 * k))
    SELECT o_orderkey, x, len(list_filter(cuts, lambda q: q < x))::INT AS category, CASE WHEN x > 250000 THEN 2 WHEN x < -250000 THEN 0 ELSE 1 END AS threshold FROM p, c""")
def w9(v: Views):
    rows = v.table("orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    cats = ranks.quantile_categories(rows, "x", 5)
    return cats.select("o_orderkey", "x", "category", ranks.threshold_category("x", 250000.0).alias("threshold"))


# sorts, limits, set operations ----------------------------------------------------------


@query("l1", "SELECT time, m, lat, lon, value FROM fld ORDER BY lat DESC, lon, m")
def l1(v: Views):
    return v.fld_once.orderBy(F.desc("lat"), "lon", "m")


@query("l2", f"""SELECT position, src, dst, round(r, 6) + 0e0 AS r FROM (SELECT *, row_number() OVER (ORDER BY r DESC, src, dst)::INT AS position FROM (
    SELECT a.node AS src, b.node AS dst, corr(a.value, b.value) AS r FROM emb a JOIN emb b ON a.m = b.m AND a.node < b.node GROUP BY 1, 2)) WHERE position <= 20""")
def l2(v: Views):
    from ..operators import network

    links = network.top_links(cut(network.window_runs(v.emb, 64, run=1)), 64, 20, run=1)
    best = ranks.top_k(links, 20, [F.desc("r"), F.asc("src"), F.asc("dst")])
    return rounded(best.select("position", "src", "dst", "r"), "r")


@query("l3", "SELECT series, time, m, value FROM idx UNION ALL SELECT series, time, m, value FROM idx2")
def l3(v: Views):
    return v.idx.unionByName(v.idx2)


@query("l4", "SELECT series, time, m, value FROM series WHERE NOT (time BETWEEN DATE '1997-01-01' AND DATE '1998-12-31')")
def l4(v: Views):
    test = F.col("time").between(F.lit("1997-01-01").cast("date"), F.lit("1998-12-31").cast("date"))
    return v.series.where(~test)


# scalar functions ----------------------------------------------------------------------


@query("x1", """SELECT series, m, round((value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0), 6) + 0e0 AS value,
    round((value - avg(value) OVER w) / nullif(stddev_pop(value) OVER w, 0), 6) + 0e0 AS value0 FROM series WINDOW w AS (PARTITION BY series)""")
def x1(v: Views):
    rows = v.series.select("series", "m", "value", F.col("value").alias("value0"))
    out = stats.standardise(rows, "value", ["series"], ddof=1)
    return rounded(stats.standardise(out, "value0", ["series"], ddof=0), "value", "value0").select("series", "m", "value", "value0")


@query("x2", "SELECT series, m, round(value / max(abs(value)) OVER (PARTITION BY series), 6) + 0e0 AS value FROM series")
def x2(v: Views):
    return rounded(stats.scale_max(v.series, "value", ["series"]), "value").select("series", "m", "value")


@query("x3", """SELECT o_orderkey, round(coalesce((x - avg(x) OVER ()) / nullif(stddev_pop(x) OVER (), 0), 0), 6) + 0e0 AS x, round(coalesce((y - avg(y) OVER ()) / nullif(stddev_pop(y) OVER (), 0), 0), 6) + 0e0 AS y
    FROM (SELECT o_orderkey, o_totalprice AS x, CASE WHEN o_orderstatus <> 'F' THEN o_totalprice END AS y FROM orders)""")
def x3(v: Views):
    rows = v.table("orders").select("o_orderkey", F.col("o_totalprice").alias("x"),
                                    F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice")).alias("y"))
    return rounded(stats.standardise(rows, ["x", "y"], impute=True), "x", "y")


@query("x4", "SELECT lat, lon, m, value FROM (SELECT lat, lon, m, round(value, 4) + 0e0 AS value, stddev_pop(value) OVER (PARTITION BY lat, lon) AS s FROM fld) WHERE s > 0")
def x4(v: Views):
    table = v.fld.groupBy("lat", "lon").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    scaled = stats.standardise(v.fld, "value", ["lat", "lon"], ddof=0)
    back = stats.unstandardise(scaled, "value", "mean", "std")
    return scaled.join(table, ["lat", "lon"]).where("std > 0").select("lat", "lon", "m", r(back, 4).alias("value"))


@query("x6", f"SELECT series, m, round({normal_cdf('((value - 30e0) / 8e0)')}, 9) + 0e0 AS cdf FROM series")
def x6(v: Views):
    return v.series.select("series", "m", r(stats.normal_cdf((F.col("value") - 30.0) / 8.0), 9).alias("cdf"))


@query("x7", f"SELECT m, n, round(r, 6) + 0e0 AS r, round({p_value('r', 'n')}, 6) + 0e0 AS p FROM (SELECT m, count(*)::INT AS n, {corr('lat', 'value')} AS r FROM fld GROUP BY 1)")
def x7(v: Views):
    table = v.fld_once.groupBy("m").agg(F.count(F.lit(1)).cast("int").alias("n"), stats.pearson("lat", "value").alias("r"))
    return rounded(table.withColumn("p", stats.correlation_p("r", "n")), "r", "p")


@query("x8", "SELECT o_orderkey, greatest(least(ceil((o_totalprice / 1e5 - 1e0) / 0.25e0), 17), 0)::INT AS class FROM orders")
def x8(v: Views):
    x = F.col("o_totalprice") / 1e5
    return v.table("orders").select("o_orderkey", stats.interval_class(x, 1.0, 0.25, 16).alias("class"))


# correlation and regression ------------------------------------------------------------


@query("c1", f"SELECT n, round(r, 6) + 0e0 AS r, round({p_value('r', 'n')}, 6) + 0e0 AS p FROM (SELECT count(*) AS n, {corr('a.value', 'b.value')} AS r FROM idx a JOIN idx2 b ON a.m = b.m)")
def c1(v: Views):
    both = v.idx.select("m", F.col("value").alias("x")).join(v.idx2.select("m", F.col("value").alias("y")), "m")
    return rounded(lagged.correlate(both, "x", "y"), "r", "p").select("n", "r", "p")


def lag_sql(x: str, y: str, n: int, groups: str = "lag") -> str:
    return f"""SELECT {groups}, n, round(r, 6) + 0e0 AS r, round({p_value('r', 'n')}, 6) + 0e0 AS p FROM (
        SELECT l.lag, count(*) AS n, {corr('a.value', 'b.value')} AS r FROM {x} a, {y} b, (SELECT unnest(range(0, {n}))::INT AS lag) l
        WHERE a.m = b.m + l.lag GROUP BY 1)"""


@query("c2", lag_sql("idx", "idx2", 29))
def c2(v: Views):
    return rounded(lagged.pearson_lag(v.idx, v.idx2, 28), "r", "p").select("lag", "n", "r", "p")


@query("c3", f"""SELECT lag, round({corr('rx', 'ry')}, 6) + 0e0 AS r FROM (
    SELECT lag, rank() OVER (PARTITION BY lag ORDER BY x) + (count(*) OVER (PARTITION BY lag, x) - 1) / 2e0 AS rx,
      rank() OVER (PARTITION BY lag ORDER BY y) + (count(*) OVER (PARTITION BY lag, y) - 1) / 2e0 AS ry FROM (
        SELECT l.lag, a.value AS x, b.value AS y FROM idx a, idx2 b, (SELECT unnest(range(0, 80))::INT AS lag) l WHERE a.m = b.m + l.lag)) GROUP BY 1""")
def c3(v: Views):
    return rounded(lagged.spearman_lag(v.idx, v.idx2, 80), "r")


@query("c4", f"""SELECT month, lag, n, round(r, 6) + 0e0 AS r, round(CASE WHEN r <= 0 THEN 1e0 ELSE {p_value('r', 'n')} END, 6) + 0e0 AS p FROM (
    SELECT (a.m % 12 + 1)::INT AS month, l.lag, count(*) AS n, {corr('a.value', 'b.value')} AS r FROM idx a, idx b, (SELECT unnest(range(0, 16))::INT AS lag) l
    WHERE a.m = b.m + l.lag GROUP BY 1, 2)""")
def c4(v: Views):
    return rounded(lagged.seasonal_autocorrelation(v.idx, 16), "r", "p").select("month", "lag", "n", "r", "p")


@query("c5", f"""SELECT lat, lon, n, round(r, 6) + 0e0 AS r, round({p_value('r', 'n')}, 6) + 0e0 AS p FROM (
    SELECT lat, lon, count(*) AS n, {corr('x', 'value')} AS r FROM (SELECT lat, lon, value, lag(value) OVER (PARTITION BY lat, lon ORDER BY m) AS x FROM fld) WHERE x IS NOT NULL GROUP BY 1, 2)""")
def c5(v: Views):
    from pyspark.sql import Window

    pairs = v.fld_once.withColumn("x", F.lag("value").over(Window.partitionBy("lat", "lon").orderBy("m"))).where("x is not null")
    return rounded(lagged.correlate(pairs, "x", "value", ["lat", "lon"]), "r", "p").select("lat", "lon", "n", "r", "p")


@query("c6", f"""SELECT lat, lon, round(slope * sx, 5) + 0e0 AS coef, round(intercept, 5) + 0e0 AS intercept, round(r, 6) + 0e0 AS r, n, round({p_value('r', 'n')}, 6) + 0e0 AS p FROM (
    SELECT f.lat, f.lon, regr_slope(f.value, x.value) AS slope, regr_intercept(f.value, x.value) AS intercept, stddev_pop(x.value) AS sx, abs({corr('x.value', 'f.value')}) AS r, count(*) AS n
    FROM fld f JOIN idx x ON f.m = x.m GROUP BY 1, 2)""")
def c6(v: Views):
    table = lagged.regression_map(lagged.gridded(v.fld_once, v.idx), "x")
    out = table.withColumns({"coef": r("coef", 5), "intercept": r("intercept", 5), "r": r("r"), "p": r("p")})
    return out.select("lat", "lon", "coef", "intercept", "r", "n", "p")


@query("c7", f"""WITH j AS (SELECT f.lat, f.lon, f.anom AS y, a.value AS a, b.value - 36e0 AS b FROM ({ANOM_SQL}) f JOIN idx a ON f.m = a.m JOIN idx2 b ON f.m = b.m),
    s AS (SELECT lat, lon, (sum(a*y)*sum(b*b) - sum(b*y)*sum(a*b)) / nullif(sum(a*a)*sum(b*b) - sum(a*b)*sum(a*b), 0) AS c1,
      (sum(b*y)*sum(a*a) - sum(a*y)*sum(a*b)) / nullif(sum(a*a)*sum(b*b) - sum(a*b)*sum(a*b), 0) AS c2, avg(y) AS my FROM j GROUP BY 1, 2)
    SELECT lat, lon, coef1, coef2, r2, n, round(r, 5) + 0e0 AS r, round({p_value('r', 'n')}, 5) + 0e0 AS p FROM (
      SELECT j.lat, j.lon, round(max(c1) * stddev_pop(a), 5) + 0e0 AS coef1, round(max(c2) * stddev_pop(b), 5) + 0e0 AS coef2,
        round(1 - sum((y - c1*a - c2*b)^2) / sum((y - my)^2), 5) + 0e0 AS r2, count(*) AS n, corr(y, c1*a + c2*b) AS r
      FROM j JOIN s ON j.lat = s.lat AND j.lon = s.lon GROUP BY 1, 2)""")
def c7(v: Views):
    rows = lagged.gridded(lagged.gridded(anomalies(v), v.idx, "a"), v.idx2.withColumn("value", F.col("value") - 36.0), "b")
    out = lagged.regression_map2(rows, "a", "b")
    return rounded(out, "coef1", "coef2", "r2", "r", "p", digits=5)


RESID_SQL = """SELECT a.m, b.value - (regr_slope(b.value, a.value) OVER () * a.value + regr_intercept(b.value, a.value) OVER ()) AS residual FROM idx a JOIN idx2 b ON a.m = b.m"""


@query("c8", f"SELECT m, round(residual, 6) + 0e0 AS residual FROM ({RESID_SQL})")
def c8(v: Views):
    both = v.idx.select("m", F.col("value").alias("x")).join(v.idx2.select("m", F.col("value").alias("y")), "m")
    return rounded(lagged.residual(both, "x", "y").select("m", "residual"), "residual")


@query("c9", "WITH zx AS (SELECT m, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS value FROM idx), zy AS (SELECT m, (value - avg(value) OVER ()) / stddev_samp(value) OVER () AS value FROM idx2) "
       + lag_sql("zx", "zy", 81))
def c9(v: Views):
    x = stats.standardise(v.idx, "value", ["series"], ddof=1)
    y = stats.standardise(v.idx2, "value", ["series"], ddof=1)
    return rounded(lagged.pearson_lag(x, y, 80), "r", "p").select("lag", "n", "r", "p")


@query("c10")
def c10(v: Views):
    """In-sample against held-out skill of a regression on noise columns (daily order means)."""
    daily = v.table("orders").groupBy(F.to_date("o_orderdate").alias("time")).agg(F.avg("o_totalprice").alias("v"))
    rows = daily.withColumn("y", (F.col("v") - 250000.0) / 1e5).withColumn(
        "x", F.array(*[features.normal_noise("time", F.lit(i), seed=7) for i in range(40)])
    )
    train = F.col("time") < F.lit("1998-07-01").cast("date")
    model = learners.LinearForecast(ridge=0.0).fit(rows.where(train))
    scored = model.transform(rows).withColumn("part", F.when(train, "train").otherwise("test"))
    return rounded(lagged.correlate(scored, "mean", "y", ["part"]), "r", "p")


@query("c11")
def c11(v: Views):
    """Random-forest regression of a search history, squared correlation on the held-out part."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    from ..functions.sampling import uniform
    from .training import damped_history

    history = damped_history(v, 60)
    table = VectorAssembler(inputCols=["damping", "shrink"], outputCol="f").transform(history)
    table = table.withColumn("_u", uniform("lead", "candidate", seed=11))
    model = RandomForestRegressor(featuresCol="f", labelCol="loss", numTrees=5, seed=1).fit(table.where("_u < 0.8"))
    scored = model.transform(table.where("_u >= 0.8"))
    return rounded(scored.agg((stats.pearson("prediction", "loss") * stats.pearson("prediction", "loss")).alias("r2"),
                              F.count(F.lit(1)).alias("n")), "r2")
