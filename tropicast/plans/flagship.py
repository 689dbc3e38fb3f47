"""The flagship query: field climatology to a lag correlation with an index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import climatology, lagged, regions, windows
from .registry import query, rounded
from .sqltext import corr, p_value
from .views import REFERENCE, Views

SQL = f"""WITH clim AS (SELECT lat, lon, m % 12 AS k, avg(value) AS mean FROM fld WHERE time BETWEEN DATE '{REFERENCE[0]}' AND DATE '{REFERENCE[1]}' GROUP BY 1, 2, 3),
    anom AS (SELECT f.m, f.lat, f.lon, f.value - c.mean AS value FROM fld f JOIN clim c ON f.lat = c.lat AND f.lon = c.lon AND f.m % 12 = c.k),
    box AS (SELECT m, avg(v) AS value FROM (SELECT m, lon, avg(value) AS v FROM anom WHERE lat BETWEEN -5 AND 5 AND lon BETWEEN 140 AND 200 GROUP BY 1, 2) GROUP BY 1),
    smooth AS (SELECT m, CASE WHEN count(value) OVER w = 3 THEN avg(value) OVER w END AS value FROM box WINDOW w AS (ORDER BY m RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))
    SELECT lag, n, round(r, 6) + 0e0 AS r, round({p_value('r', 'n')}, 6) + 0e0 AS p FROM (
      SELECT l.lag, count(CASE WHEN a.value IS NOT NULL THEN 1 END) AS n, {corr('a.value', 'b.value')} AS r FROM smooth a, idx b, (SELECT unnest(range(0, 29))::INT AS lag) l WHERE a.m = b.m + l.lag GROUP BY 1)"""


def _flagship(v: Views) -> DataFrame:
    table = climatology.climatology(v.fld, "month", REFERENCE)
    anom = climatology.anomaly(v.fld, table, "month")
    box = regions.box_mean(anom, (-5, 5), (140, 200))
    smooth = windows.rolling_mean(box.withColumn("series", F.lit("box")), 3, ("series",))
    return rounded(lagged.pearson_lag(smooth, v.idx, 28), "r", "p").select("lag", "n", "r", "p")


query("flagship", SQL)(_flagship)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flagship(Views(spark, sf_dir))
