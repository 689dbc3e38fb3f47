"""Climate-shaped views over the driver tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_date, month_number
from ..functions.stats import nonneg
from ..session import cut

EDGES = (1995, 1997, 1999, 2001, 2002)
REFERENCE = ("1996-01-01", "1999-12-31")
# prices are whole cents, so means can end in an exact half; this moves them off it
TIE = 1e-9
LEADS = (0, 3, 6, 9, 12, 15, 18, 21)


class Views:
    """Lazily built views of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _months(self, table: str, time: str, **values) -> DataFrame:
        """Monthly means of a raw table: one scan with partial means inside the tasks.

        The result (a row per month) is kept as a table, so that operators which read a
        series several times do not scan the raw table again.
        """
        means = [value.alias(name) for name, value in values.items()]
        rows = self.table(table).groupBy(month_number(time).alias("m")).agg(*means)
        return cut(rows.select(month_date("m").alias("time"), "m", *values))

    @staticmethod
    def _series(months: DataFrame, column: str, name: str) -> DataFrame:
        return months.select(F.lit(name).alias("series"), "time", "m", F.col(column).alias("value"))

    @cached_property
    def idx(self) -> DataFrame:
        value = F.round((F.avg("o_totalprice") / 1000.0 - 250.0) / 10.0 + TIE, 6)
        return self._series(self._months("orders", "o_orderdate", value=value), "value", "oni")

    @cached_property
    def _shipments(self) -> DataFrame:
        return self._months("lineitem", "l_shipdate", price=F.round(F.avg("l_extendedprice") / 1000.0 + TIE, 6),
                            quantity=F.round(F.avg("l_quantity") + TIE, 6))

    @cached_property
    def idx2(self) -> DataFrame:
        return self._series(self._shipments, "price", "wwv")

    @cached_property
    def idx3(self) -> DataFrame:
        return self._series(self._shipments, "quantity", "iod")

    @cached_property
    def series(self) -> DataFrame:
        return self.idx.unionByName(self.idx2).unionByName(self.idx3)

    @cached_property
    def _customer_months(self) -> DataFrame:
        """Orders reduced to one row per customer and month, so a customer with very many
        orders is small before it meets the customer table."""
        v = F.col("o_totalprice") / 1000.0
        return self.table("orders").groupBy("o_custkey", month_number("o_orderdate").alias("m")).agg(
            F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.count(F.lit(1)).alias("n")
        )

    @cached_property
    def fld(self) -> DataFrame:
        """The field as a table, for operators that read it several times."""
        return cut(self.fld_once)

    @cached_property
    def fld_once(self) -> DataFrame:
        """The field as a plan, for operators that read it once."""
        nation = self.table("nation")  # 25 fixed rows
        spot = nation.select(
            F.col("n_nationkey").alias("c_nationkey"),
            (-5.0 + 2.5 * F.col("n_regionkey")).alias("lat"),
            (120.0 + 20.0 * (F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1)).alias("lon"),
        )
        who = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
        rows = self._customer_months.join(who, "o_custkey").join(spot, "c_nationkey")
        cells = rows.groupBy("m", "lat", "lon").agg(F.round(F.sum("s") / F.sum("n") + TIE, 6).alias("value"))
        return cells.select(month_date("m").alias("time"), "m", "lat", "lon", "value")

    @cached_property
    def daily(self) -> DataFrame:
        return self.table("events").groupBy(F.to_date("ts").alias("time"), F.col("event_type").alias("key")).agg(
            F.round(F.avg("value") + TIE, 6).alias("value")
        )

    @cached_property
    def base(self) -> DataFrame:
        """Index with the mean and spread of its trailing twelve months."""
        w = Window.partitionBy("series").orderBy("m").rangeBetween(-11, 0)
        rows = self.idx.withColumns({"mean12": F.avg("value").over(w), "std12": F.stddev_samp("value").over(w),
                                     "_n": F.count("value").over(w)})
        return rows.where("_n = 12").select("m", "value", F.round("mean12", 6).alias("mean12"), F.round("std12", 6).alias("std12"))

    @cached_property
    def fct(self) -> DataFrame:
        models = F.array(F.struct(F.lit("persistence").alias("model"), F.col("value").alias("mean")),
                         F.struct(F.lit("trailing").alias("model"), F.col("mean12").alias("mean")))
        rows = self.base.select("m", "std12", F.explode(models).alias("_f"))
        rows = rows.withColumn("lead", F.explode(F.array(*[F.lit(v) for v in LEADS])))
        m = F.col("m") + F.col("lead") + 3
        return rows.select("_f.model", month_date(m).alias("target_season"), m.alias("m"), "lead", "_f.mean",
                           F.col("std12").alias("std"))

    @cached_property
    def ens(self) -> DataFrame:
        who = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("member"))
        rows = self._customer_months.join(who, "o_custkey")
        n, s = F.sum("n"), F.sum("s")
        var = F.try_divide(F.sum("ss") - F.try_divide(s * s, n), F.nullif(n - 1, F.lit(0)))
        out = rows.groupBy("m", "member").agg(F.round(s / n + TIE, 6).alias("mean"),
                                              F.round(F.sqrt(nonneg(var)), 6).alias("std"))
        return out.select(month_date("m").alias("target_season"), "m", "member", "mean", "std")

    @cached_property
    def ext(self) -> DataFrame:
        """Forecasts of one external model per market segment, leads 0 to 8, some missing."""
        rows = self.ens.withColumn("lead", F.explode(F.sequence(F.lit(0), F.lit(8))))
        m = F.col("m") + F.col("lead")
        raw = F.round((F.col("mean") - 250.0) * 10.0).cast("int")
        raw = F.greatest(F.least(raw - 3 * F.col("lead"), F.lit(9999)), F.lit(-998))
        raw = F.when(m % 11 == 0, -999).otherwise(raw)
        return rows.select(F.col("member").alias("model"), F.col("m").alias("issue_m"), month_date(m).alias("target_season"),
                           m.alias("m"), "lead", raw.alias("raw"),
                           (F.nullif(raw, F.lit(-999)) / 100.0).alias("mean"))

    @cached_property
    def emb(self) -> DataFrame:
        return self.table("embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).select(
            F.col("vec_id").alias("node"), F.col("pos").alias("m"), F.col("x").cast("double").alias("value")
        )

    @cached_property
    def matched(self) -> DataFrame:
        from ..operators import verify

        return verify.with_keys(verify.match(self.fct, self.idx), EDGES)

    @cached_property
    def event_years(self) -> DataFrame:
        """Years whose mean index is above or below the mean of all years."""
        yearly = self.idx.groupBy(F.floor(F.col("m") / 12).cast("int").alias("year")).agg(F.avg("value").alias("v"))
        centre = yearly.agg(F.avg("v")).scalar()
        return yearly.withColumn("_c", centre).select(
            F.when(F.col("v") > F.col("_c"), "warm").otherwise("cold").alias("kind"), "year"
        )


_LEAD_SQL = "SELECT unnest([0,3,6,9,12,15,18,21])::INT AS lead"

SQL_VIEWS = {
    "idx": """SELECT 'oni' AS series, make_date(m // 12, m % 12 + 1, 1) AS time, m, value FROM (
        SELECT (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS m,
               round((avg(o_totalprice) / 1000.0 - 250.0) / 10.0 + 1e-9, 6) AS value FROM orders GROUP BY 1)""",
    "idx2": """SELECT 'wwv' AS series, make_date(m // 12, m % 12 + 1, 1) AS time, m, value FROM (
        SELECT (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INT AS m,
               round(avg(l_extendedprice) / 1000.0 + 1e-9, 6) AS value FROM lineitem GROUP BY 1)""",
    "idx3": """SELECT 'iod' AS series, make_date(m // 12, m % 12 + 1, 1) AS time, m, value FROM (
        SELECT (year(l_shipdate) * 12 + month(l_shipdate) - 1)::INT AS m,
               round(avg(l_quantity) + 1e-9, 6) AS value FROM lineitem GROUP BY 1)""",
    "series": "SELECT * FROM idx UNION ALL SELECT * FROM idx2 UNION ALL SELECT * FROM idx3",
    "fld": """SELECT make_date(m // 12, m % 12 + 1, 1) AS time, m, lat, lon, value FROM (
        SELECT (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS m, lat, lon,
               round(avg(o_totalprice) / 1000.0 + 1e-9, 6) AS value
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN (
            SELECT n_nationkey, -5e0 + 2.5e0 * n_regionkey AS lat,
                   120e0 + 20e0 * (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS lon
            FROM nation) ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)""",
    "daily": """SELECT ts::DATE AS time, event_type AS key, round(avg(value) + 1e-9, 6) AS value FROM events GROUP BY 1, 2""",
    "base": """SELECT m, value, round(mean12, 6) AS mean12, round(std12, 6) AS std12 FROM (
        SELECT m, value, avg(value) OVER w AS mean12, stddev_samp(value) OVER w AS std12, count(value) OVER w AS n
        FROM idx WINDOW w AS (ORDER BY m RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)) WHERE n = 12""",
    "fct": f"""SELECT model, make_date((m + lead + 3) // 12, (m + lead + 3) % 12 + 1, 1) AS target_season,
        (m + lead + 3)::INT AS m, lead, mean, std12 AS std FROM (
            SELECT 'persistence' AS model, m, value AS mean, std12 FROM base
            UNION ALL SELECT 'trailing', m, mean12, std12 FROM base) CROSS JOIN ({_LEAD_SQL})""",
    "ens": """SELECT make_date(m // 12, m % 12 + 1, 1) AS target_season, m, member, mean, std FROM (
        SELECT (year(o_orderdate) * 12 + month(o_orderdate) - 1)::INT AS m, c_mktsegment AS member,
               round(avg(o_totalprice / 1000.0) + 1e-9, 6) AS mean, round(stddev_samp(o_totalprice / 1000.0), 6) AS std
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)""",
    "ext": """SELECT model, issue_m, make_date(m // 12, m % 12 + 1, 1) AS target_season, m, lead, raw,
        nullif(raw, -999) / 100e0 AS mean FROM (
            SELECT member AS model, m AS issue_m, (m + lead)::INT AS m, lead,
                   (CASE WHEN (m + lead) % 11 = 0 THEN -999
                    ELSE greatest(least(round((mean - 250e0) * 10e0)::INT - 3 * lead, 9999), -998) END)::INT AS raw
            FROM ens CROSS JOIN (SELECT unnest(range(0, 9))::INT AS lead))""",
    "emb": """SELECT vec_id AS node, pos AS m, x AS value FROM (
        SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INT AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings)""",
    "matched": """SELECT f.*, o.value AS y, CASE WHEN f.m // 12 >= 1995 AND f.m // 12 < 1997 THEN 1995
            WHEN f.m // 12 >= 1997 AND f.m // 12 < 1999 THEN 1997 WHEN f.m // 12 >= 1999 AND f.m // 12 < 2001 THEN 1999
            WHEN f.m // 12 >= 2001 AND f.m // 12 < 2002 THEN 2001 END AS decade, ((f.m - 1) % 12 + 1)::INT AS season
        FROM fct f JOIN idx o ON f.m = o.m""",
    "event_years": """SELECT CASE WHEN v > (avg(v) OVER ()) THEN 'warm' ELSE 'cold' END AS kind, year
        FROM (SELECT (m // 12)::INT AS year, avg(value) AS v FROM idx GROUP BY 1)""",
}


def with_views(body: str) -> str:
    """Prefix a query with the views it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in SQL_VIEWS:
            if re.search(rf"\b(FROM|JOIN)\s*\(?\s*{name}\b|,\s*{name}\b(?=\s+\w)", text, flags=re.I) and name not in needed:
                visit(SQL_VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ", ".join(f"{n} AS ({SQL_VIEWS[n]})" for n in needed)
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"
