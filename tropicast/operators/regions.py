"""Boxes, basins, composites and event filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Equatorial Pacific basins (west and east longitude in degrees east).
BASINS = {"west": (120.0, 160.0), "centre": (160.0, 180.0), "east": (180.0, 240.0)}
EDGE_BASINS = {"whole": (120.0, 240.0), "west": (120.0, 160.0), "centre": (160.0, 210.0)}
ONI_BOX = ((-5.0, 5.0), (190.0, 240.0))


def box(df: DataFrame, lat: tuple, lon: tuple) -> DataFrame:
    """Inclusive box; the order of latitudes does not matter."""
    la, lo = sorted(map(float, lat)), sorted(map(float, lon))
    return df.where(F.col("lat").between(*la) & F.col("lon").between(*lo))


def box_mean(df: DataFrame, lat: tuple, lon: tuple, keys=("time", "m"), value: str = "value") -> DataFrame:
    """Mean over latitude first, then over longitude (a mean of means when cells are missing)."""
    keys = list(keys)
    columns = box(df, lat, lon).groupBy(*keys, "lon").agg(F.avg(value).alias("_lat_mean"))
    return columns.groupBy(*keys).agg(F.avg("_lat_mean").alias(value))


def _basin_column(basins: dict) -> Column:
    """Array of all basins a longitude lies in; basins share their edges."""
    lon = F.col("lon")
    hits = F.array(*[F.when(lon.between(*edges), F.lit(name)) for name, edges in basins.items()])
    return F.filter(hits, lambda b: b.isNotNull())


def basin_means(df: DataFrame, lat1: float = 2.5, lat2: float = -2.5, basins=None, keys=("time", "m")) -> DataFrame:
    """Mean of means per basin."""
    basins = BASINS if basins is None else basins
    south, north = sorted((lat1, lat2))
    rows = df.where(F.col("lat").between(south, north)).groupBy(*keys, "lon").agg(F.avg("value").alias("_lat_mean"))
    tagged = rows.withColumn("basin", F.explode(_basin_column(basins)))
    return tagged.groupBy(*keys, "basin").agg(F.avg("_lat_mean").alias("value"))


def basin_edges(df: DataFrame, lat1: float = 2.5, lat2: float = -2.5, keys=("time", "m")) -> DataFrame:
    """Variant: whole basin, west as the largest latitude mean, wide centre."""
    south, north = sorted((lat1, lat2))
    rows = df.where(F.col("lat").between(south, north)).groupBy(*keys, "lon").agg(F.avg("value").alias("_lat_mean"))
    tagged = rows.withColumn("basin", F.explode(_basin_column(EDGE_BASINS)))
    value = F.when(F.first("basin") == "west", F.max("_lat_mean")).otherwise(F.avg("_lat_mean"))
    return tagged.groupBy(*keys, "basin").agg(value.alias("value"))


def regime(year) -> Column:
    """Background regime of a year: el-nino-like 1982-2001, la-nina-like otherwise."""
    year = F.col(year) if isinstance(year, str) else year
    return F.when(year.between(1982, 2001), "elnino-like").otherwise("lanina-like")


def regime_filter(df: DataFrame, background: str, year: Column) -> DataFrame:
    """Rows of a background regime: all, el-nino-like, la-nina-like or barnston_2019."""
    if background == "all":
        return df
    if background == "barnston_2019":
        return df.where(year.between(1982, 2015))
    if background in ("el-nino-like", "la-nina-like"):
        return df.where(regime(year) == background.replace("el-nino", "elnino").replace("la-nina", "lanina"))
    raise ValueError(f"unknown background {background!r}")


def regimes_of(year: Column) -> Column:
    """Names of all backgrounds of ``regime_filter`` that hold a year, as an array."""
    named = F.when(regime(year) == "elnino-like", "el-nino-like").otherwise("la-nina-like")
    barnston = F.when(year.between(1982, 2015), F.array(F.lit("barnston_2019"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit("all"), named), barnston)


def event_months(events: DataFrame, months: dict) -> DataFrame:
    """Months that belong to events: ``(kind, year)`` rows to ``(kind, m)`` rows.

    ``months`` maps a year offset to the calendar months taken from that year, so a
    winter spans the year boundary.
    """
    offsets = F.array(*[
        F.struct(F.lit(offset).alias("offset"), F.lit(month).alias("month"))
        for offset, wanted in months.items() for month in wanted
    ])
    rows = events.withColumn("_o", F.explode(offsets))
    m = (F.col("year") + F.col("_o.offset")) * 12 + F.col("_o.month") - 1
    return rows.select("kind", m.cast("int").alias("m")).distinct()


def select_events(df: DataFrame, events: DataFrame, months: dict) -> DataFrame:
    """Rows whose month belongs to any event (semi join)."""
    return df.join(event_months(events, months).select("m"), "m", "left_semi")


def composite(df: DataFrame, events: DataFrame, months: dict, cell=("lat", "lon")) -> DataFrame:
    """Mean map per event kind, all kinds in one pass."""
    return df.join(event_months(events, months), "m").groupBy("kind", *cell).agg(F.avg("value").alias("value"))


def drop_empty_cells(df: DataFrame, cell=("lat", "lon")) -> DataFrame:
    """Remove cells without a single value."""
    alive = df.groupBy(*cell).agg(F.count("value").alias("_n")).where("_n > 0").select(*cell)
    return df.join(alive, list(cell), "left_semi")
