"""Climatologies and anomalies of gridded fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import calendar_month
from ..functions.stats import ratio
from ..session import cut

CELL = ("lat", "lon")
REFERENCE = ("1981-01-01", "2010-12-31")


def period_steps(df: DataFrame, time: str = "time") -> DataFrame:
    """Largest step in days between consecutive distinct times.

    Steps inside a calendar year come from a window per year, steps across years from
    the first and last day of each year.
    """
    days = df.select(F.col(time).cast("date").alias("t")).distinct().withColumn("_y", F.year("t"))
    gap = F.date_diff("t", F.lag("t").over(Window.partitionBy("_y").orderBy("t")))
    per_year = days.withColumn("_gap", gap).groupBy("_y").agg(
        F.max("_gap").alias("inside"), F.min("t").alias("first"), F.max("t").alias("last")
    )
    # one row per calendar year
    across = F.date_diff("first", F.lag("last").over(Window.orderBy("_y")))
    steps = per_year.select(F.greatest("inside", across).alias("step"))
    longest = F.max("step")
    kind = F.when(longest == 1, "dayofyear").when(longest.between(28, 31), "month")
    return steps.agg(longest.cast("int").alias("max_step"), kind.alias("period"))


def detect_period(df: DataFrame, time: str = "time") -> str:
    """``dayofyear`` or ``month``; any other spacing raises."""
    row = period_steps(df, time).first()
    if row.period is None:
        raise ValueError(f"time step of up to {row.max_step} days is neither daily nor monthly")
    return row.period


def period_key(period: str, time: str = "time") -> Column:
    if period == "month":
        return F.month(time)
    if period == "dayofyear":
        return F.dayofyear(time)
    raise ValueError(f"unknown period {period!r}")


def climatology(df: DataFrame, period: str = "month", reference=REFERENCE, cell=CELL, time: str = "time") -> DataFrame:
    """Mean and spread (ddof 0) per cell and period key, in one aggregate.

    ``reference`` is an inclusive date range or None for the whole series.
    """
    rows = df
    if reference is not None:
        rows = rows.where(F.col(time).between(F.to_date(F.lit(reference[0])), F.to_date(F.lit(reference[1]))))
    return rows.groupBy(*cell, period_key(period, time).alias("period_key")).agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def with_climatology(df: DataFrame, clim: DataFrame, period: str = "month", cell=CELL, time: str = "time") -> DataFrame:
    """Field joined with its climatology on cell and period key.

    The climatology is written first, so that the join knows its size and not the field's.
    """
    clim = cut(clim)
    return df.withColumn("period_key", period_key(period, time)).join(clim, [*cell, "period_key"])


def anomaly(df: DataFrame, clim: DataFrame, period: str = "month", cell=CELL, normalised=False, time: str = "time") -> DataFrame:
    """Departure from the mean climatology, optionally divided by its spread."""
    departure = F.col("value") - F.col("mean")
    value = ratio(departure, "std") if normalised else departure
    return with_climatology(df, clim, period, cell, time).withColumn("value", value).select(*df.columns)


def postprocess(df: DataFrame, period: str = "month", reference=REFERENCE, cell=CELL, time: str = "time") -> DataFrame:
    """Base field with its anomaly and normalised anomaly side by side."""
    joined = with_climatology(df, climatology(df, period, reference, cell, time), period, cell, time)
    departure = F.col("value") - F.col("mean")
    return joined.select(*df.columns, departure.alias("anom"), ratio(departure, "std").alias("normanom"))


def store_postprocess(store, df: DataFrame, variable: str, dataset: str, reference=REFERENCE, new: bool = False) -> list:
    """Write a field and its derived fields to a store; returns the parts written.

    The climatology is materialised once per reference period and reused.
    """
    period = detect_period(df)
    written = []
    if store.write_field(df, variable, dataset, "base", new):
        written.append("base")

    def compute(rows, reference):
        return climatology(rows, period, reference)

    clim = store.climatology(df, variable, dataset, compute, reference, new)
    for name, normalised in (("anom", False), ("normanom", True)):
        if new or not store.exists("field", variable=variable, dataset=dataset, processed=name):
            store.write_field(anomaly(df, clim, period, normalised=normalised), variable, dataset, name, new)
            written.append(name)
    return written
