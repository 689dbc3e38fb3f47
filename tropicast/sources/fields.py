"""Gridded field sources as long tables ``time, m, lat, lon, value``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import month_number
from ..functions.stats import no_nan

# Published fields (name -> variable, dataset).
CATALOGUE = {
    "sst_ersst": ("sst", "ERSSTv5"),
    "sst_hadisst": ("sst", "HadISST"),
    "ustr": ("upstr", "ICOADS"),
    "uwind": ("uwnd", "NCEP"),
    "vwind": ("vwnd", "NCEP"),
    "sat": ("air", "NCEP"),
    "sat_daily": ("air_daily", "NCEP"),
    "olr": ("olr", "NCAR"),
    "ssh_orap5": ("sossheig", "ORAP5"),
    "godas": ("sshg", "GODAS"),
    "ssh_oras4": ("ssh", "ORAS4"),
    "sat_gfdl": ("tas", "GFDL-CM3"),
    "ssh_gfdl": ("zos", "GFDL-CM3"),
    "sst_gfdl": ("tos", "GFDL-CM3"),
    "heat_content": ("hca", "NODC"),
}


def read_field_files(spark: SparkSession, paths, missing: float | None = None) -> DataFrame:
    """One or many Parquet files or folders of a field, united by column name."""
    rows = spark.read.option("mergeSchema", True).parquet(*([paths] if isinstance(paths, str) else paths))
    value = no_nan("value")
    if missing is not None:
        value = F.nullif(value, F.lit(missing))
    return rows.withColumn("value", value).withColumn("m", month_number("time"))


def source(spark: SparkSession, name: str, path) -> DataFrame:
    """A catalogue field with its ``variable`` and ``dataset`` tags."""
    if name not in CATALOGUE:
        raise ValueError(f"unknown field source {name!r}")
    variable, dataset = CATALOGUE[name]
    return read_field_files(spark, path).withColumns(
        {"variable": F.lit(variable), "dataset": F.lit(dataset)}
    )


def curvilinear_box(df: DataFrame, lat: tuple, lon: tuple) -> DataFrame:
    """Cells strictly inside a box on two-dimensional coordinates."""
    y, x = F.col("nav_lat"), F.col("nav_lon")
    return df.where((y > lat[0]) & (y < lat[1]) & (x > lon[0]) & (x < lon[1]))


def select_level(df: DataFrame, level: int = 5) -> DataFrame:
    """One level of a four-dimensional field; fields without levels pass unchanged."""
    if "level" not in df.columns:
        return df
    return df.where((F.col("level") == level) | F.col("level").isNull())
