"""The processed store: partitioned Parquet tables read with pruned, pushed-down slices.

Layout below one root::

    series/series=<name>/...                         time, m, value
    statistic/name=<name>/...                        time, <metrics>
    field/variable=/dataset=/processed=/...          time, m, lat, lon, value
    climatology/variable=/dataset=/reference=/...    period_key, lat, lon, mean, std
    forecast/model=<name>/...                        target_season, lead, <outputs>
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_KEYS = ("variable", "dataset", "processed")

_D = T.DoubleType()
SERIES_SCHEMA = T.StructType(
    [T.StructField("time", T.DateType()), T.StructField("m", T.IntegerType()),
     T.StructField("value", _D), T.StructField("series", T.StringType())]
)
FIELD_SCHEMA = T.StructType(
    [T.StructField("time", T.DateType()), T.StructField("m", T.IntegerType()),
     T.StructField("lat", _D), T.StructField("lon", _D), T.StructField("value", _D)]
    + [T.StructField(k, T.StringType()) for k in FIELD_KEYS]
)


class Store:
    """Reader and writer over one root; slices are inclusive at both ends."""

    def __init__(self, spark: SparkSession, root: str, start: str | None = None, end: str | None = None,
                 lat: tuple = (-30.0, 30.0), lon: tuple = (120.0, 280.0)):
        self.spark, self.root = spark, root.rstrip("/")
        self.start, self.end, self.lat, self.lon = start, end, lat, lon

    def path(self, *parts: str) -> str:
        return "/".join((self.root, *parts))

    # slices -------------------------------------------------------------------------

    def time_slice(self, df: DataFrame, column: str = "time") -> DataFrame:
        """Inclusive slice; the end is moved to the end of its month."""
        t = F.col(column)
        if self.start is not None:
            df = df.where(t >= F.to_date(F.lit(_first_day(self.start))))
        if self.end is not None:
            df = df.where(t <= F.last_day(F.to_date(F.lit(_first_day(self.end)))))
        return df

    def check_bounds(self, df: DataFrame, column: str = "time") -> DataFrame:
        """Raise ``ValueError`` unless the requested range lies inside the data."""
        want_lo = F.lit(_first_day(self.start) if self.start else None).cast("date")
        want_hi = F.last_day(F.lit(_first_day(self.end) if self.end else None).cast("date"))
        seen = df.agg(F.min(column).alias("lo"), F.last_day(F.max(column)).alias("hi"))
        row = seen.select(
            "lo", "hi",
            F.coalesce(want_lo < F.col("lo"), F.lit(False)).alias("early"),
            F.coalesce(want_hi > F.col("hi"), F.lit(False)).alias("late"),
        ).first()
        if row.early:
            raise ValueError(f"the requested start {self.start} is before the first time {row.lo}")
        if row.late:
            raise ValueError(f"the requested end {self.end} is after the last time {row.hi}")
        return df

    # existence ----------------------------------------------------------------------

    def exists(self, table: str, **partition: str) -> bool:
        """Whether a partition has been written."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self._partition(table, **partition))
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return False
        return not self.spark.read.parquet(place.toString()).isEmpty()

    def _partition(self, table: str, **partition: str) -> str:
        """Folder of one partition; Spark escapes some characters of its values."""
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return self.path(table, *[f"{k}={escape(v)}" for k, v in partition.items()])

    def _checked(self, rows: DataFrame, check: bool, column: str = "time") -> DataFrame:
        return self.time_slice(self.check_bounds(rows, column) if check else rows, column)

    def _write(self, df: DataFrame, table: str, keys) -> None:
        (
            df.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*keys)
            .parquet(self.path(table))
        )

    # series and statistics ------------------------------------------------------------

    def write_series(self, df: DataFrame, series: str) -> None:
        self._write(df.select("time", "m", "value", F.lit(series).alias("series")), "series", ["series"])

    def write_series_csv(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").option("header", True).csv(self.path("csv", name))

    def read_series_csv(self, name: str, schema: str) -> DataFrame:
        rows = self.spark.read.schema(schema).option("header", True).csv(self.path("csv", name))
        return self.time_slice(rows)

    def read_series(self, *names: str, check: bool = True) -> DataFrame:
        """Series inside the requested range; raises where that leaves the data, unless ``check`` is off."""
        rows = self.spark.read.schema(SERIES_SCHEMA).parquet(self.path("series"))
        return self._checked(rows.where(F.col("series").isin(*names)), check)

    def write_statistic(self, df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(self.path("statistic", f"name={name}"))

    def read_statistic(self, name: str, check: bool = True) -> DataFrame:
        return self._checked(self.spark.read.parquet(self.path("statistic", f"name={name}")), check)

    # fields ---------------------------------------------------------------------------

    def write_field(self, df: DataFrame, variable: str, dataset: str, processed: str = "base", new: bool = False) -> bool:
        """Write a field unless it is there already; ``new`` overwrites. True if written."""
        keys = dict(zip(FIELD_KEYS, (variable, dataset, processed)))
        if not new and self.exists("field", **keys):
            return False
        tagged = df.select("time", "m", "lat", "lon", "value", *[F.lit(v).alias(k) for k, v in keys.items()])
        # files sorted by time and place keep the row-group statistics selective
        ordered = tagged.repartitionByRange("time", "lat", "lon").sortWithinPartitions("time", "lat", "lon")
        self._write(ordered, "field", FIELD_KEYS)
        return True

    def read_field(self, variable: str, dataset: str, processed: str = "base", check: bool = True) -> DataFrame:
        """Partition-pruned field inside the time, latitude and longitude box (bounds in any order)."""
        rows = self.spark.read.schema(FIELD_SCHEMA).parquet(self.path("field"))
        for k, v in zip(FIELD_KEYS, (variable, dataset, processed)):
            rows = rows.where(F.col(k) == v)
        lat, lon = sorted(map(float, self.lat)), sorted(map(float, self.lon))
        return self._checked(rows.where(F.col("lat").between(*lat) & F.col("lon").between(*lon)), check)

    # climatology ----------------------------------------------------------------------

    def climatology(self, df: DataFrame, variable: str, dataset: str, compute, reference=None, new: bool = False) -> DataFrame:
        """Compute a climatology once and reuse it; the reference period is part of its key."""
        ref = "whole" if reference is None else f"{reference[0]}_{reference[1]}"
        keys = {"variable": variable, "dataset": dataset, "reference": ref}
        if new or not self.exists("climatology", **keys):
            table = compute(df, reference=reference)
            tagged = table.select("*", *[F.lit(v).alias(k) for k, v in keys.items()])
            self._write(tagged, "climatology", list(keys))
        return self.spark.read.parquet(self._partition("climatology", **keys))

    # forecasts ------------------------------------------------------------------------

    def write_forecast(self, df: DataFrame, model: str) -> None:
        self._write(df.drop("model").withColumn("model", F.lit(model)), "forecast", ["model"])

    def read_forecasts(self, model: str, lead: int, check: bool = True) -> DataFrame:
        """Target-season slice of one model at exactly one lead, with all outputs of that model."""
        rows = self._of_model("forecast", model).where(F.col("lead") == lead)
        return self._checked(rows, check, "target_season")

    def _of_model(self, table: str, model: str) -> DataFrame:
        """A model's own partition: its columns need not be those of the other models."""
        return self.spark.read.option("basePath", self.path(table)).parquet(self._partition(table, model=model))

    def write_other_forecasts(self, df: DataFrame) -> None:
        self._write(df, "other_forecast", ["model"])

    def read_other_forecasts(self, model: str, lead: int, check: bool = True) -> DataFrame:
        rows = self._of_model("other_forecast", model).where(F.col("lead") == lead)
        return self._checked(rows, check, "target_season")


def _first_day(text: str) -> str:
    """``YYYY``, ``YYYY-MM`` or ``YYYY-MM-DD`` to a full date string."""
    return text + ("-01-01", "-01", "")[text.count("-")]
