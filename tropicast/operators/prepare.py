"""Preparation of index series, reports and derived fields."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_date, month_number, season_date
from ..sources.text import MONTHLY_INDICES, number_lines

K_INDEX_START = 1955 * 12  # 1955-01
SPLICE_M = 1980 * 12  # volume record starts 1980-01
K_INDEX_FACTOR = 10e12
REPORT_START = 2002 * 12 + 3  # first issue 2002-04
REPORT_SLOTS = 9
MISSING = -999


def prep_season_index(table: DataFrame) -> DataFrame:
    """Season table to ``time, m, value``: a season is dated by its last month."""
    out = table.select(season_date("seas", "yr").alias("time"), F.col("anom").alias("value"))
    return out.select("time", month_number("time").alias("m"), "value")


def prep_monthly_index(table: DataFrame, index: str | None = None) -> DataFrame:
    """Monthly index table to long form; one index by name, or all of them."""
    names = {f"anom_{i}": n for i, n in enumerate(MONTHLY_INDICES)}
    if index is not None and index not in MONTHLY_INDICES:
        raise ValueError(f"unknown index {index!r}")
    long = table.unpivot(["yr", "mon"], list(names), "_column", "value")
    label = F.create_map(*[F.lit(x) for item in names.items() for x in item])
    out = long.select(
        label[F.col("_column")].alias("series"),
        F.make_date("yr", "mon", F.lit(1)).alias("time"),
        (F.col("yr") * 12 + F.col("mon") - 1).alias("m"),
        "value",
    )
    return out if index is None else out.where(F.col("series") == index)


def prep_detrended_index(table: DataFrame) -> DataFrame:
    return table.select(
        F.make_date("yr", "mon", F.lit(1)).alias("time"),
        (F.col("yr") * 12 + F.col("mon") - 1).alias("m"),
        F.col("anom").alias("value"),
    )


def prep_volume(table: DataFrame) -> DataFrame:
    """``YYYYMM`` integers to dates."""
    time = F.to_date(F.col("date").cast("string"), "yyyyMM")
    return table.select(time.alias("time"), month_number(time).alias("m"),
                        "volume", F.col("anomaly").alias("value"))


def prep_ordinal(values: DataFrame, start_m: int = K_INDEX_START) -> DataFrame:
    """Ordinal values on a monthly axis from ``start_m``."""
    m = (F.lit(start_m) + F.col("n")).cast("int")
    return values.select(month_date(m).alias("time"), m.alias("m"), "value")


def splice(old: DataFrame, new: DataFrame, at_m: int = SPLICE_M, factor: float = K_INDEX_FACTOR) -> DataFrame:
    """Proxy before a month (scaled), the record itself from that month on."""
    before = old.where(F.col("m") < at_m).select("time", "m", (F.col("value") * factor).alias("value"))
    return before.unionByName(new.where(F.col("m") >= at_m).select("time", "m", "value"))


def prep_year_table(table: DataFrame, missing: float = MISSING) -> DataFrame:
    """Year x 12 months to long form; the sentinel becomes NULL."""
    months = [f"m{i}" for i in range(1, 13)]
    long = table.unpivot(["year"], months, "_month", "value")
    month = F.substring("_month", 2, 2).cast("int")
    return long.select(
        F.make_date("year", month, F.lit(1)).alias("time"),
        (F.col("year") * 12 + month - 1).cast("int").alias("m"),
        F.nullif(F.col("value"), F.lit(float(missing))).alias("value"),
    )


def prep_report(lines: DataFrame, start_m: int = REPORT_START) -> DataFrame:
    """Fixed-width forecast report to ``model, target_season, m, lead, mean``.

    A line starting with ``end`` closes an issue block. A row carries nine 4-wide integers
    and a model name at columns 40..51; slot k of block j targets month ``start + j + k``.
    The first field that is no integer ends the row, the slots before it stay. Rows
    without a name are skipped; a later row for the same target and lead wins.
    """
    is_end = F.substring("value", 1, 3) == "end"
    rows = number_lines(lines, is_end, "block").where(~is_end)
    slots = F.array(*[
        F.trim(F.substring("value", 4 * k + 1, 4)).try_cast("int") for k in range(REPORT_SLOTS)
    ])
    good = F.array_position(F.transform("slots", lambda s: s.isNull()), True)
    kept = F.when(good == 0, F.col("slots")).otherwise(F.slice("slots", F.lit(1), (good - 1).cast("int")))
    name = F.translate(F.trim(F.substring("value", 41, 12)), "/", " ")
    read = (
        rows.withColumn("slots", slots)
        .select("block", "split", "pos", name.alias("model"), kept.alias("slots"))
        .where((F.col("model") != "") & (F.size("slots") > 0))
        .select("block", "split", "pos", "model", F.posexplode("slots").alias("lead", "raw"))
    )
    m = (F.lit(start_m) + F.col("block") + F.col("lead")).cast("int")
    value = F.nullif(F.col("raw"), F.lit(MISSING)) / 100.0
    last = F.max_by(F.struct(value.alias("mean")), F.struct("split", "pos"))
    return (
        read.groupBy("model", m.alias("m"), "lead").agg(last.alias("_last"))
        .select("model", month_date("m").alias("target_season"), "m", "lead", "_last.mean")
    )


def report_axis_end(lines: DataFrame) -> DataFrame:
    """Last month of the report axis: ten months after the last issue date."""
    issue = F.try_to_timestamp(F.substring("value", 17, 8), F.lit("MMM yyyy")).cast("date")
    heads = lines.where(F.col("value").startswith("Forecast"))
    return heads.agg(F.add_months(F.max_by(issue, F.struct("split", "pos")), 10).alias("axis_end"))


def warm_pool_edge(field: DataFrame, warm: float = 28.0, interpolate: str = "slope") -> DataFrame:
    """Easternmost warm cell on the equator, as a distance in km, per time.

    ``slope`` keeps the published index definition, ((v - warm) (v - v_west) + i) cells;
    ``linear`` interpolates where the value falls through ``warm``. No warm cell: NULL.
    """
    w = Window.partitionBy("m").orderBy("lon")
    row = (
        field.where(F.col("lat") == 0)
        .withColumn("i", F.row_number().over(w) - 1)
        .withColumn("_west", F.lag("value").over(w))
        .withColumn("_east", F.lead("value").over(w))
    )
    v = F.col("value")
    if interpolate == "linear":
        offset = F.coalesce(F.try_divide(v - warm, v - F.col("_east")), F.lit(0.0))
    else:
        offset = (v - warm) * (v - F.col("_west"))
    edge = (offset + F.col("i")) * 2.5 * 111.321
    hit = F.when(v > warm, F.struct("i", edge.alias("edge")))
    best = row.groupBy("time", "m").agg(F.max_by(hit, F.when(v > warm, F.col("i"))).alias("_b"))
    return best.select("time", "m", F.col("_b.i").alias("cell"), F.col("_b.edge").alias("value"))


def wind_stress(u: DataFrame, v: DataFrame) -> DataFrame:
    """Wind speed and pseudo stress from the two components on one grid."""
    both = u.withColumnRenamed("value", "u").join(
        v.select("m", "lat", "lon", F.col("value").alias("v")), ["m", "lat", "lon"]
    )
    speed = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    return both.select("time", "m", "lat", "lon", speed.alias("wspd"),
                       (F.col("u") * speed).alias("taux"), (F.col("v") * speed).alias("tauy"))


def negate(field: DataFrame) -> DataFrame:
    return field.withColumn("value", -F.col("value"))


def seasonal_cycle(m, first_m) -> tuple[Column, Column]:
    """Cosine and sine of the annual phase counted from the first month."""
    m = F.col(m) if isinstance(m, str) else m
    phase = (m - first_m) * (2.0 * math.pi / 12.0)
    return F.cos(phase), F.sin(phase)


def aligned(series: DataFrame, names: list, scale: dict | None = None) -> DataFrame:
    """Wide table of several series, keeping the months that all of them have."""
    scale = scale or {}
    wide = series.where(F.col("series").isin(*names)).groupBy("time", "m").pivot("series", names).agg(F.first("value"))
    wide = wide.dropna(subset=names)
    return wide.select("time", "m", *[(F.col(n) / scale.get(n, 1.0)).alias(n) for n in names])
