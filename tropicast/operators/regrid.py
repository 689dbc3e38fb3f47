"""Bilinear regridding of rectilinear fields.

Bilinear weights separate into a latitude and a longitude factor, so the weight tables
hold at most two rows per target coordinate and join on the source coordinates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def axis_weights(df: DataFrame, axis: str, start: float, stop: float, step: float, period: float | None = None) -> DataFrame:
    """``target, source, weight`` for one axis; targets outside the source range drop out.

    With ``period`` the axis is cyclic: the last source coordinate is followed by the first
    one shifted by the period.
    """
    count = int(round((stop - start) / step)) + 1
    # distinct coordinates of one grid axis
    points = df.select(axis).distinct().select(F.col(axis).alias("source"))
    rows = points.select(F.col("source").alias("at"), "source")
    if period is not None:
        ends = points.agg(F.struct(F.min("source").alias("lo"), F.max("source").alias("hi")).alias("e"))
        shifted = rows.withColumn("_e", ends.scalar())
        before = shifted.where("source = _e.hi").select((F.col("at") - period).alias("at"), "source")
        after = shifted.where("source = _e.lo").select((F.col("at") + period).alias("at"), "source")
        rows = rows.unionByName(before).unionByName(after)
    known = rows.agg(F.array_sort(F.collect_list(F.struct("at", "source"))).alias("_k"))
    steps = known.select("_k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"))
    targets = steps.select("_k", (F.lit(float(start)) + F.col("i") * F.lit(float(step))).alias("target"))
    low = F.element_at(F.filter("_k", lambda s: s["at"] <= F.col("target")), -1)
    high = F.element_at(F.filter("_k", lambda s: s["at"] >= F.col("target")), 1)
    inside = F.exists("_k", lambda s: s["at"] <= F.col("target")) & F.exists("_k", lambda s: s["at"] >= F.col("target"))
    pair = targets.where(inside).select("target", low.alias("lo"), high.alias("hi"))
    share = F.coalesce(F.try_divide(F.col("target") - F.col("lo.at"), F.col("hi.at") - F.col("lo.at")), F.lit(0.0))
    both = pair.select("target", F.explode(F.array(
        F.struct(F.col("lo.source").alias("source"), (1.0 - share).alias("weight")),
        F.struct(F.col("hi.source").alias("source"), share.alias("weight")),
    )).alias("w"))
    return both.select("target", "w.source", "w.weight").where("weight > 0")


def regrid(df: DataFrame, lat=(-90.0, 90.0, 2.5), lon=(0.0, 357.5, 2.5), keys=("time", "m"), periodic: bool = False) -> DataFrame:
    """Field on a regular target grid; NULL where a contributing source cell is missing."""
    lat_w = axis_weights(df, "lat", *lat)
    lon_w = axis_weights(df, "lon", *lon, period=360.0 if periodic else None)
    lat_w = _with_count(lat_w).select(F.col("source").alias("lat"), F.col("target").alias("_tlat"),
                                      F.col("weight").alias("_wlat"), F.col("needed").alias("_nlat"))
    lon_w = _with_count(lon_w).select(F.col("source").alias("lon"), F.col("target").alias("_tlon"),
                                      F.col("weight").alias("_wlon"), F.col("needed").alias("_nlon"))
    rows = df.join(lat_w, "lat").join(lon_w, "lon")
    out = rows.groupBy(*keys, "_tlat", "_tlon").agg(
        F.sum(F.col("value") * F.col("_wlat") * F.col("_wlon")).alias("_sum"),
        F.count("value").alias("_seen"),
        F.max(F.col("_nlat") * F.col("_nlon")).alias("_needed"),
    )
    value = F.when(F.col("_seen") == F.col("_needed"), F.col("_sum"))
    return out.select(*keys, F.col("_tlat").alias("lat"), F.col("_tlon").alias("lon"), value.alias("value"))


def _with_count(weights: DataFrame) -> DataFrame:
    return weights.join(weights.groupBy("target").agg(F.count(F.lit(1)).alias("needed")), "target")
