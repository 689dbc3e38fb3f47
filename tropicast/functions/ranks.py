"""Exact ranks and order statistics without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def value_ranges(df: DataFrame, value: str, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Distinct ``value`` with its count ``n`` and range ``_bucket``, and the rows ``_size`` of each range with those ``_offset`` before it.

    Repeated values collapse before the shuffle, so a value that fills a third of the
    table is one row. The rest is dealt to the shuffle's sorted ranges, whose number follows the
    table's size unless ``ranges`` fixes it, and written once, so all readers see the same ranges.
    """
    counts = cut(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n")))
    dealt = counts.repartitionByRange(value) if ranges is None else counts.repartitionByRange(ranges, value)
    placed = cut(dealt.withColumn("_bucket", F.spark_partition_id()))
    totals = placed.groupBy("_bucket").agg(F.sum("n").alias("_size"))
    # one row per range
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return placed, totals.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0).cast("long")))


def _below(value: str) -> Column:
    """Rows below each value: those before its range, and a running count inside."""
    local = Window.partitionBy("_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return F.col("_offset") + F.coalesce(F.sum("n").over(local), F.lit(0))


def cumulative_counts(df: DataFrame, value: str, buckets: int | None = None) -> DataFrame:
    """Distinct ``value`` with its count ``n`` and ``below``, the rows strictly below it."""
    placed, totals = value_ranges(df, value, buckets)
    return placed.join(totals, "_bucket").select(value, "n", _below(value).alias("below"))


def average_rank(value, keys) -> Column:
    """Rank with ties averaged, inside groups of bounded size (months of one series)."""
    order = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def top_k(df: DataFrame, k: int, order: list, keys=()) -> DataFrame:
    """First ``k`` rows of each key in the given order, with ``position`` from 1.

    Spark limits each group inside every task before the shuffle (window group limit),
    so a large group never meets in one task as a whole.
    """
    if not keys:
        best = df.orderBy(*order).limit(k)
        return best.withColumn("position", F.row_number().over(Window.orderBy(*order)))
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= k)


def quantile_categories(df: DataFrame, value: str, categories: int) -> DataFrame:
    """Add ``category`` 0..c-1 from cut points at sorted positions ``i * (n div c)``.

    Bins are right-closed; the cut points are exact order statistics.
    """
    placed, totals = value_ranges(df, value)
    step = F.floor(totals.agg(F.sum("_size")).scalar() / categories)
    positions = F.transform(F.sequence(F.lit(1), F.lit(categories - 1)), lambda i: i * F.col("_step")) if categories > 1 else F.array().cast("array<long>")

    def held(first, size):
        return F.size(F.filter(positions, lambda p: (p >= first) & (p < first + size)))

    # only ranges that hold a position are put in order
    wanted = totals.withColumn("_step", step).where(held(F.col("_offset"), F.col("_size")) > 0)
    inside = placed.join(wanted, "_bucket").withColumn("below", _below(value))
    hits = inside.withColumn("_hits", held(F.col("below"), F.col("n"))).where("_hits > 0")
    # at most ``categories`` values
    cuts = hits.agg(F.flatten(F.collect_list(F.array_repeat(F.col(value), F.col("_hits")))).alias("c"))
    return df.withColumn("_cuts", cuts.scalar()).withColumn(
        "category", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")


def threshold_category(x, threshold: float) -> Column:
    """0 below -threshold, 2 above +threshold, 1 between (NULL stays NULL)."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x > threshold, 2).when(x < -threshold, 0).when(x.isNotNull(), 1)
