"""Text sources.

All readers take a *lines* table ``(file, split, pos, value)``. ``split`` is the byte
offset of the input split and ``pos`` the position inside it, so file order is known
although files are read in parallel and large files stay splittable.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_date
from ..session import cut

NUMBER = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of text files (plain or compressed) with their place in the file."""
    return (
        spark.read.text(path)
        .select("value", F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("split"))
        .withColumn("pos", F.monotonically_increasing_id())
        .select("file", "split", "pos", "value")
    )


def whitespace_table(lines: DataFrame, columns: dict, row_pattern: str) -> DataFrame:
    """Whitespace-delimited rows that match ``row_pattern``; columns by position.

    Header and footer lines fall to the pattern, so no line numbers are needed, and
    repeated header names do no harm. Fields that do not parse become NULL.
    """
    parts = F.split(F.trim("value"), r"\s+")
    out = lines.where(F.col("value").rlike(row_pattern)).withColumn("_f", parts)
    return out.select(
        *[F.try_element_at("_f", F.lit(i + 1)).try_cast(t).alias(n) for i, (n, t) in enumerate(columns.items())]
    )


def season_index(lines: DataFrame) -> DataFrame:
    """``SEAS YR TOTAL ANOM`` table."""
    return whitespace_table(
        lines,
        {"seas": "string", "yr": "int", "total": "double", "anom": "double"},
        r"^\s*[A-Z]{3}\s+\d{4}\s",
    )


MONTHLY_INDICES = ("1+2", "3", "4", "3.4")  # order of the value/anomaly column pairs


def monthly_indices(lines: DataFrame) -> DataFrame:
    """``YR MON`` followed by four (value, anomaly) pairs."""
    columns = {"yr": "int", "mon": "int"}
    for i in range(len(MONTHLY_INDICES)):
        columns[f"total_{i}"] = "double"
        columns[f"anom_{i}"] = "double"
    return whitespace_table(lines, columns, r"^\s*\d{4}\s+\d{1,2}\s")


def detrended_index(lines: DataFrame) -> DataFrame:
    """``YR MON TOTAL CLIM ANOM`` table of the detrended index."""
    return whitespace_table(
        lines,
        {"yr": "int", "mon": "int", "total": "double", "clim": "double", "anom": "double"},
        r"^\s*\d{4}\s+\d{1,2}\s",
    )


def index_source(lines: DataFrame, index: str = "3.4", period: str = "S", detrend: bool = False) -> DataFrame:
    """Pick the reader for an index; combinations that are not published raise."""
    if period == "S" and index == "3.4" and not detrend:
        return season_index(lines)
    if period == "M" and detrend and index == "3.4":
        return detrended_index(lines)
    if period == "M" and not detrend and index in MONTHLY_INDICES:
        return monthly_indices(lines)
    raise ValueError(f"index {index!r} with period {period!r}, detrend={detrend} is not available")


def volume_table(lines: DataFrame) -> DataFrame:
    """``YYYYMM volume anomaly`` rows below a free-text header."""
    return whitespace_table(
        lines, {"date": "int", "volume": "double", "anomaly": "double"}, r"^\s*\d{6}\s+" + NUMBER
    )


def year_table(lines: DataFrame) -> DataFrame:
    """One row per year with twelve monthly values; header and footer are skipped."""
    columns = {"year": "int", **{f"m{i}": "double" for i in range(1, 13)}}
    return whitespace_table(lines, columns, r"^\s*\d{4}(\s+" + NUMBER + r"){12}\s*$")


def ordinal_values(lines: DataFrame) -> DataFrame:
    """One number per line; ``n`` counts the numbers of a file from 0 in file order."""
    rows = lines.where(F.col("value").rlike(r"^\s*" + NUMBER + r"\s*$"))
    return number_lines(rows).select("file", "n", F.trim("value").cast("double").alias("value"))


def number_lines(lines: DataFrame, flag=None, name: str = "n") -> DataFrame:
    """Running number of the preceding lines per file, or of those that satisfy ``flag``.

    Counted within each input split and offset by the totals of the splits before it, so
    no task sees a whole file unless the file is a single split.
    """
    hit = F.lit(1) if flag is None else F.when(flag, 1).otherwise(0)
    marked = lines.withColumn("_hit", hit)
    totals = marked.groupBy("file", "split").agg(F.sum("_hit").alias("_size"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("file", "split", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("file", "split").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum("_hit").over(inside), F.lit(0))
    return (
        marked.withColumn(name, local)
        .join(offsets, ["file", "split"])
        .withColumn(name, F.col(name) + F.col("_offset"))
        .drop("_hit", "_offset")
    )


def rewrite_time_axis(df: DataFrame, start_m: int, step: int = 1, time: str = "time") -> DataFrame:
    """Replace a broken time axis by a regular monthly one, keeping the order of times.

    The k-th distinct time becomes ``start + k * step`` months. Times are first reduced to
    the distinct ones; they are numbered per calendar year with yearly offsets.
    """
    times = df.select(time).distinct().withColumn("_y", F.year(time))
    per_year = times.groupBy("_y").agg(F.count(F.lit(1)).alias("_size"))
    # one row per calendar year
    earlier = Window.orderBy("_y").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_year.select("_y", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    k = F.row_number().over(Window.partitionBy("_y").orderBy(time)) - 1
    axis = times.withColumn("_k", k).join(offsets, "_y").select(
        time, (F.lit(start_m) + F.lit(step) * (F.col("_k") + F.col("_offset"))).cast("int").alias("m_new")
    )
    # written first, so that the join knows how small it is and need not put each month into one task
    axis = cut(axis)
    return (
        df.join(axis, time)
        .drop(time, "m")
        .withColumn("m", F.col("m_new"))
        .withColumn(time, month_date("m"))
        .drop("m_new")
    )
