"""Sources, sinks and preparation of series (S, K, P)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.calendar import SEASON_LAST_MONTH, calendar_month, month_date
from ..operators import climatology, prepare, regions, verify
from ..session import scratch_path
from ..sources import fields, text
from ..sources.store import Store
from .registry import query, r, rounded
from .sqltext import date
from .views import EDGES, LEADS, REFERENCE, Views

# text renderings of the views ----------------------------------------------------------


def _lines(rows, value):
    """Lines table with one split per year of ``m``."""
    return rows.select(F.lit("view").alias("file"), F.floor(F.col("m") / 12).cast("long").alias("split"),
                       F.col("m").cast("long").alias("pos"), value.alias("value"))


def _with_text(lines, *extra):
    """Header and footer lines around a rendered table."""
    head = lines.sparkSession.createDataFrame([("view", -1, i, t) for i, t in enumerate(extra)],
                                              "file string, split long, pos long, value string")
    return lines.unionByName(head)


def season_lines(v: Views):
    label = F.create_map(*[F.lit(x) for n, m in SEASON_LAST_MONTH.items() for x in (m, n)])
    year = F.floor(F.col("m") / 12) - F.when(calendar_month("m") == 1, 1).otherwise(0)
    row = F.concat_ws("  ", label[calendar_month("m")], year.cast("string"),
                      F.round(F.col("value") + 27.0, 2).cast("string"), F.round("value", 2).cast("string"))
    return _with_text(_lines(v.idx, row), "SEAS   YR  TOTAL  ANOM")


def monthly_lines(v: Views):
    cells = [F.round(F.col("value") * (i + 1) + d, 3).cast("string") for i in range(4) for d in (20, 0)]
    row = F.concat_ws(" ", F.floor(F.col("m") / 12).cast("string"), calendar_month("m").cast("string"), *cells)
    return _with_text(_lines(v.idx, row), "YR MON NINO1+2 ANOM NINO3 ANOM NINO4 ANOM NINO3.4 ANOM")


def volume_lines(v: Views):
    row = F.concat_ws("   ", F.date_format("time", "yyyyMM"), F.round(F.col("value") * 1e3, 2).cast("string"),
                      F.round(F.col("value") - 36.0, 4).cast("string"))
    return _with_text(_lines(v.idx2, row), "Warm water volume", "free text 2000", "", "units m3", "date Volume Anomaly")


def year_lines(v: Views):
    months = v.idx.withColumns({"y": F.floor(F.col("m") / 12).cast("int"), "mon": calendar_month("m")})
    wide = months.groupBy("y").pivot("mon", list(range(1, 13))).agg(F.first(F.round("value", 3)))
    row = F.concat_ws("  ", F.col("y").cast("string"),
                      *[F.coalesce(F.col(str(i)), F.lit(-999.0)).cast("string") for i in range(1, 13)])
    lines = wide.select(F.lit("view").alias("file"), F.col("y").cast("long").alias("split"),
                        F.lit(0).cast("long").alias("pos"), row.alias("value"))
    return _with_text(lines, " 1870 2018", "-999", "dipole mode index", "1870 only")


def report_lines(v: Views):
    """One issue block per month: header, one row per model, end."""
    slots = v.ext.groupBy("model", "issue_m").agg(
        F.array_sort(F.collect_list(F.struct("lead", "raw"))).alias("s")
    )
    text_row = F.concat(
        F.array_join(F.transform("s", lambda s: F.lpad(s["raw"].cast("string"), 4, " ")), ""),
        F.repeat(F.lit(" "), 4), F.rpad(F.col("model"), 12, " "), F.lit("  "),
    )
    body = slots.select("issue_m", F.dense_rank().over(_by_issue()).cast("long").alias("pos"), text_row.alias("value"))
    marks = v.ens.select(F.col("m").alias("issue_m")).distinct()
    head = marks.select("issue_m", F.lit(0).cast("long").alias("pos"),
                        F.concat(F.lit("Forecast issued "), F.date_format(month_date("issue_m"), "MMM yyyy")).alias("value"))
    tail = marks.select("issue_m", F.lit(99).cast("long").alias("pos"), F.lit("end").alias("value"))
    rows = body.unionByName(head).unionByName(tail)
    return rows.select(F.lit("report").alias("file"), F.col("issue_m").cast("long").alias("split"), "pos", "value")


def _by_issue():
    from pyspark.sql import Window

    return Window.partitionBy("issue_m").orderBy("model")


# sources -------------------------------------------------------------------------------

SEASON_SQL = ("CASE m % 12 + 1 WHEN 1 THEN 'NDJ' WHEN 2 THEN 'DJF' WHEN 3 THEN 'JFM' WHEN 4 THEN 'FMA' WHEN 5 THEN 'MAM' "
              "WHEN 6 THEN 'AMJ' WHEN 7 THEN 'MJJ' WHEN 8 THEN 'JJA' WHEN 9 THEN 'JAS' WHEN 10 THEN 'ASO' "
              "WHEN 11 THEN 'SON' ELSE 'OND' END")


@query("s1", f"""SELECT {SEASON_SQL} AS seas, (m // 12 - CASE WHEN m % 12 = 0 THEN 1 ELSE 0 END)::INT AS yr,
    round(value + 27e0, 2) AS total, round(value, 2) AS anom FROM idx""")
def s1(v: Views):
    return text.index_source(season_lines(v), "3.4", "S", False)


@query("s2", """SELECT (m // 12 * 100 + m % 12 + 1)::INT AS date, round(value * 1e3, 2) AS volume,
    round(value - 36e0, 4) AS anomaly FROM idx2""")
def s2(v: Views):
    return text.volume_table(volume_lines(v))


@query("s3", """SELECT (m // 12)::INT AS year, """ + ", ".join(
    f"coalesce(max(CASE WHEN m % 12 + 1 = {i} THEN round(value, 3) END), -999e0) AS m{i}" for i in range(1, 13)
) + " FROM idx GROUP BY 1")
def s3(v: Views):
    return text.year_table(year_lines(v))


@query("s4", """SELECT kind, count(*) AS n FROM (
    SELECT 'row' AS kind FROM ext WHERE lead = 0 UNION ALL
    SELECT unnest(['head', 'end']) FROM (SELECT DISTINCT m FROM ens)) GROUP BY 1""")
def s4(v: Views):
    path = scratch_path(v.spark, "report")
    report_lines(v).repartitionByRange(4, "split").sortWithinPartitions("split", "pos").select("value").write.text(path)
    lines = text.read_lines(v.spark, path)
    kind = F.when(F.col("value").startswith("Forecast"), "head").when(F.substring("value", 1, 3) == "end", "end")
    return lines.groupBy(F.coalesce(kind, F.lit("row")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _store(v: Views, **box) -> Store:
    return Store(v.spark, scratch_path(v.spark, "store"), **box)


BOX_SQL = "time BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND lat BETWEEN -2.5 AND 2.5 AND lon BETWEEN 120 AND 180"


@query("s5", f"SELECT time, m, lat, lon, value FROM fld WHERE {BOX_SQL}")
def s5(v: Views):
    store = _store(v, start="1996-01", end="2000-12", lat=(2.5, -2.5)[::-1], lon=(120, 180))
    store.write_field(v.fld_once, "sst", "ERSSTv5")
    return store.read_field("sst", "ERSSTv5").select("time", "m", "lat", "lon", "value")


@query("s6", "SELECT time, m, lat AS nav_lat, lon AS nav_lon, value FROM fld WHERE lat > -5 AND lat < 5 AND lon > 120 AND lon < 200")
def s6(v: Views):
    curved = v.fld_once.withColumnsRenamed({"lat": "nav_lat", "lon": "nav_lon"})
    return fields.curvilinear_box(curved, (-5.0, 5.0), (120.0, 200.0))


@query("s7", """SELECT n_regionkey AS level, (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS m,
    round(avg(o_totalprice) + 1e-7, 4) + 0e0 AS value
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    WHERE n_regionkey = 3 GROUP BY 1, 2""")
def s7(v: Views):
    who = v.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    where = v.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("level"))
    levels = fields.select_level(v._customer_months.join(who, "o_custkey").join(where, "c_nationkey"), 3)
    return levels.groupBy("level", "m").agg(r(1000.0 * F.sum("s") / F.sum("n") + 1e-7, 4).alias("value"))


@query("s8", "SELECT (m // 12)::INT AS year, count(*) AS n, round(avg(value), 6) + 0e0 AS value FROM fld GROUP BY 1")
def s8(v: Views):
    """Yearly files written one folder per year, read together."""
    path = scratch_path(v.spark, "yearly")
    v.fld_once.withColumn("year", F.floor(F.col("m") / 12).cast("int")).drop("m").write.partitionBy("year").parquet(path)
    rows = fields.read_field_files(v.spark, path)
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("value"))


@query("s9", f"""SELECT {date('20400 + 3 * k')} AS time, (20400 + 3 * k)::INT AS m, key, value FROM (
    SELECT (dense_rank() OVER (ORDER BY time) - 1)::INT AS k, key, value FROM daily)""")
def s9(v: Views):
    return text.rewrite_time_axis(v.daily, 1700 * 12, 3).select("time", "m", "key", "value")


@query("s10", """SELECT variable, dataset, count(*) AS n, round(sum(value), 4) + 0e0 AS total FROM (
    SELECT 'sst' AS variable, 'ERSSTv5' AS dataset, value FROM fld UNION ALL
    SELECT 'olr', 'NCAR', -value FROM fld) GROUP BY 1, 2""")
def s10(v: Views):
    a, b = scratch_path(v.spark, "sst"), scratch_path(v.spark, "olr")
    v.fld.write.parquet(a)
    prepare.negate(v.fld).write.parquet(b)
    both = fields.source(v.spark, "sst_ersst", a).unionByName(fields.source(v.spark, "olr", b))
    return both.groupBy("variable", "dataset").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value"), 4).alias("total"))


@query("s11", "SELECT time, m, value, series FROM idx WHERE time BETWEEN DATE '1996-03-01' AND DATE '1999-06-30'")
def s11(v: Views):
    store = _store(v, start="1996-03", end="1999-06")
    store.write_series(v.idx, "oni")
    store.write_series(v.idx2, "wwv")
    return store.read_series("oni")


STAT_SQL = "SELECT make_date((m // 12)::INT, 1, 1) AS time, count(*) AS n, round(avg(value), 6) + 0e0 AS mean FROM idx GROUP BY 1"


def _yearly_statistic(v: Views):
    year = F.make_date(F.floor(F.col("m") / 12).cast("int"), F.lit(1), F.lit(1))
    return v.idx.groupBy(year.alias("time")).agg(F.count(F.lit(1)).alias("n"), r(F.avg("value")).alias("mean"))


@query("s12", f"SELECT * FROM ({STAT_SQL}) WHERE time >= DATE '1997-01-01'")
def s12(v: Views):
    store = _store(v, start="1997")
    store.write_statistic(_yearly_statistic(v), "yearly")
    return store.read_statistic("yearly").select("time", "n", "mean")


@query("s13", """SELECT target_season, m, lead, mean, std, model FROM fct WHERE model = 'persistence' AND lead = 6
    AND target_season BETWEEN DATE '1997-01-01' AND DATE '2000-12-31'""")
def s13(v: Views):
    store = _store(v, start="1997-01", end="2000-12")
    for model in ("persistence", "trailing"):
        store.write_forecast(v.fct.where(F.col("model") == model), model)
    return store.read_forecasts("persistence", 6)


@query("s14", "SELECT target_season, m, lead, mean, model FROM ext WHERE model = 'BUILDING' AND lead = 3 AND target_season >= DATE '1996-01-01'")
def s14(v: Views):
    store = _store(v, start="1996-01")
    store.write_other_forecasts(v.ext.select("target_season", "m", "lead", "mean", "model"))
    return store.read_other_forecasts("BUILDING", 3)


@query("s15", "SELECT min(time) AS first, last_day(max(time)) AS last FROM idx")
def s15(v: Views):
    store = Store(v.spark, scratch_path(v.spark, "none"), start="1996-01", end="2000-12")
    rows = store.check_bounds(v.idx)
    for late in ("1890-01", "2100-01"):
        wrong = Store(v.spark, store.root, start=late if late < "1900" else None, end=late if late > "1900" else None)
        try:
            wrong.check_bounds(v.idx)
        except ValueError:
            continue
        raise AssertionError("bounds were not checked")
    return rows.agg(F.min("time").alias("first"), F.last_day(F.max("time")).alias("last"))


# sinks ---------------------------------------------------------------------------------


@query("k1", "SELECT time, m, value FROM idx")
def k1(v: Views):
    store = _store(v)
    store.write_series_csv(v.idx.select("time", "m", "value"), "oni")
    return store.read_series_csv("oni", "time date, m int, value double")


@query("k2", f"""SELECT processed, count(*) AS n, round(sum(value * value), 1) + 0e0 AS energy FROM (
    SELECT 'base' AS processed, value FROM fld UNION ALL
    SELECT 'anom', f.value - c.mean FROM fld f JOIN (SELECT lat, lon, m % 12 AS k, avg(value) AS mean FROM fld
      WHERE time BETWEEN DATE '{REFERENCE[0]}' AND DATE '{REFERENCE[1]}' GROUP BY 1, 2, 3) c
      ON f.lat = c.lat AND f.lon = c.lon AND f.m % 12 = c.k) GROUP BY 1""")
def k2(v: Views):
    store = _store(v, lat=(-90, 90), lon=(0, 360))
    climatology.store_postprocess(store, v.fld, "sst", "ERSSTv5", REFERENCE)
    if climatology.store_postprocess(store, v.fld, "sst", "ERSSTv5", REFERENCE):
        raise AssertionError("fields were written twice")
    both = store.read_field("sst", "ERSSTv5", "base").unionByName(store.read_field("sst", "ERSSTv5", "anom"))
    return both.groupBy("processed").agg(F.count(F.lit(1)).alias("n"), r(F.sum(F.col("value") * F.col("value")), 1).alias("energy"))


@query("k3", f"""SELECT lat, lon, (m % 12 + 1)::INT AS period_key, round(avg(value), 6) + 0e0 AS mean, round(stddev_pop(value), 6) + 0e0 AS std
    FROM fld WHERE time BETWEEN DATE '{REFERENCE[0]}' AND DATE '{REFERENCE[1]}' GROUP BY 1, 2, 3""")
def k3(v: Views):
    store = _store(v)

    def compute(rows, reference):
        return climatology.climatology(rows, "month", reference)

    store.climatology(v.fld, "sst", "ERSSTv5", compute, None)
    table = store.climatology(v.fld, "sst", "ERSSTv5", compute, REFERENCE)
    return rounded(table, "mean", "std").select("lat", "lon", "period_key", "mean", "std")


@query("k5", "SELECT model, lead, count(*) AS n, round(sum(mean), 5) + 0e0 AS total FROM fct GROUP BY 1, 2")
def k5(v: Views):
    store = _store(v)
    for model in ("persistence", "trailing"):
        store.write_forecast(v.fct.where(F.col("model") == model), model)
    rows = v.spark.read.parquet(store.path("forecast"))
    return rows.groupBy("model", "lead").agg(F.count(F.lit(1)).alias("n"), r(F.sum("mean"), 5).alias("total"))


# preparation ---------------------------------------------------------------------------


@query("p1", f"SELECT {SEASON_SQL} AS seas, (m // 12 - CASE WHEN m % 12 = 0 THEN 1 ELSE 0 END)::INT AS yr, (m % 12 + 1)::INT AS month, time FROM idx")
def p1(v: Views):
    from ..functions.calendar import season_date, season_month

    table = text.season_index(season_lines(v))
    return table.select("seas", "yr", season_month("seas").alias("month"), season_date("seas", "yr").alias("time"))


@query("p2", "SELECT time, m, round(value, 2) AS value FROM idx")
def p2(v: Views):
    return prepare.prep_season_index(text.season_index(season_lines(v)))


@query("p3", """SELECT name AS series, time, m, round(value * (i + 1), 3) AS value FROM idx,
    (SELECT unnest(['1+2', '3', '4', '3.4']) AS name, unnest([0, 1, 2, 3]) AS i)""")
def p3(v: Views):
    return prepare.prep_monthly_index(text.index_source(monthly_lines(v), "4", "M", False))


@query("p4", "SELECT time, m, round(value * 1e3, 2) AS volume, round(value - 36e0, 4) AS value FROM idx2")
def p4(v: Views):
    return prepare.prep_volume(text.volume_table(volume_lines(v)))


@query("p5", f"SELECT {date('23460 + k')} AS time, (23460 + k)::INT AS m, value FROM (SELECT (row_number() OVER (ORDER BY m) - 1)::INT AS k, round(value, 4) AS value FROM idx)")
def p5(v: Views):
    lines = _lines(v.idx, F.round("value", 4).cast("string"))
    return prepare.prep_ordinal(text.ordinal_values(lines))


@query("p6", "SELECT time, m, round(value * 10e12, 0) + 0e0 AS value FROM idx WHERE m < 23976 UNION ALL SELECT time, m, round(value, 0) + 0e0 FROM idx2 WHERE m >= 23976")
def p6(v: Views):
    return rounded(prepare.splice(v.idx, v.idx2, at_m=1998 * 12), "value", digits=0)


@query("p7", f"""SELECT {date('m')} AS time, m, value FROM (
    SELECT y * 12 + k AS m, round(value, 3) AS value FROM (SELECT DISTINCT (m // 12)::INT AS y FROM idx) CROSS JOIN
    (SELECT unnest(range(0, 12))::INT AS k) LEFT JOIN idx ON idx.m = y * 12 + k)""")
def p7(v: Views):
    return prepare.prep_year_table(text.year_table(year_lines(v)))


@query("p8", "SELECT model, target_season, m, lead, raw / 100e0 AS mean FROM (SELECT model, target_season, m, lead, nullif(raw, -999) AS raw FROM ext)")
def p8(v: Views):
    return prepare.prep_report(report_lines(v), start_m=1995 * 12)


@query("p9", """SELECT time, m, CASE WHEN max(v) > 28 THEN max(CASE WHEN v > 28 THEN i END) END::INT AS cell,
    round(max_by(((v - 28e0) * (v - west) + i) * 2.5e0 * 111.321e0, CASE WHEN v > 28 THEN i END), 4) + 0e0 AS value FROM (
      SELECT time, m, v, (row_number() OVER w - 1)::INT AS i, lag(v) OVER w AS west FROM (
        SELECT time, m, lon, 28e0 + (value - 250e0) / 50e0 AS v FROM fld WHERE lat = 0)
      WINDOW w AS (PARTITION BY m ORDER BY lon)) GROUP BY 1, 2""")
def p9(v: Views):
    warm = v.fld_once.withColumn("value", 28.0 + (F.col("value") - 250.0) / 50.0)
    edge = prepare.warm_pool_edge(warm)
    return edge.select("time", "m", "cell", r("value", 4).alias("value"))


@query("p10", """SELECT time, m, lat, lon, round(s, 5) + 0e0 AS wspd, round(u * s, 4) + 0e0 AS taux, round(w * s, 4) + 0e0 AS tauy FROM (
    SELECT time, m, lat, lon, u, w, sqrt(u * u + w * w) AS s FROM (
      SELECT time, m, lat, lon, value - 250e0 AS u, (value - 240e0) / 2e0 AS w FROM fld))""")
def p10(v: Views):
    u = v.fld.withColumn("value", F.col("value") - 250.0)
    w = v.fld.withColumn("value", (F.col("value") - 240.0) / 2.0)
    out = prepare.wind_stress(u, w)
    return out.withColumns({"wspd": r("wspd", 5), "taux": r("taux", 4), "tauy": r("tauy", 4)})


@query("p11", "SELECT time, m, lat, lon, -value AS value FROM fld")
def p11(v: Views):
    return prepare.negate(v.fld_once)


@query("p12", """SELECT time, m, (m % 12 + 1)::INT AS month, round(cos((m - f) / 12e0 * 2 * pi()), 6) + 0e0 AS cos,
    round(sin((m - f) / 12e0 * 2 * pi()), 6) + 0e0 AS sin FROM idx, (SELECT min(m) AS f FROM idx)""")
def p12(v: Views):
    cos, sin = prepare.seasonal_cycle("m", F.col("first"))
    rows = v.idx.withColumn("first", v.idx.agg(F.min("m")).scalar())
    return rows.select("time", "m", calendar_month("m").alias("month"), r(cos).alias("cos"), r(sin).alias("sin"))


@query("p13", """SELECT a.time, a.m, a.value AS oni, round(b.value / 10e0, 6) + 0e0 AS wwv, c.value AS iod
    FROM idx a JOIN idx2 b ON a.m = b.m JOIN idx3 c ON a.m = c.m""")
def p13(v: Views):
    return rounded(prepare.aligned(v.series, ["oni", "wwv", "iod"], {"wwv": 10.0}), "wwv")
