"""Decades, folds, ensemble segments and task tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio

# First years of the evaluation decades (the last is the end) and lead times.
DECADES = (1963, 1972, 1982, 1992, 2002, 2012, 2018)
LEADS = (0, 3, 6, 9, 12, 15, 18, 21)


def fold_of(year, edges=DECADES) -> Column:
    """First year of the decade a year lies in, half-open; NULL outside."""
    year = F.col(year) if isinstance(year, str) else year
    out = None
    for lo, hi in zip(edges[:-1], edges[1:]):
        hit = (year >= lo) & (year < hi)
        out = F.when(hit, lo) if out is None else out.when(hit, lo)
    return out


def folds_of(m, edges=DECADES, overlap_year: bool = False) -> Column:
    """Array of decades a month number lies in.

    ``overlap_year`` lets a decade run to the end of the next decade's first year.
    """
    m = F.col(m) if isinstance(m, str) else m
    extra = 12 if overlap_year else 0
    hits = [F.when((m >= 12 * lo) & (m < 12 * hi + extra), F.lit(lo)) for lo, hi in zip(edges[:-1], edges[1:])]
    return F.filter(F.array(*hits), lambda d: d.isNotNull())


def train_folds(fold, edges=DECADES) -> Column:
    """Array of the decades whose training set a row of ``fold`` belongs to."""
    fold = F.col(fold) if isinstance(fold, str) else fold
    return F.filter(F.array(*[F.lit(d) for d in edges[:-1]]), lambda d: fold.isNull() | (d != fold))


def fold_sizes(features: DataFrame, edges=DECADES, year="year") -> DataFrame:
    """``lead, fold, n_test, n_train``: train is everything outside the decade.

    Training counts come from totals minus the fold, without copying rows per fold.
    """
    rows = features.withColumn("fold", fold_of(year, edges)).groupBy("lead", "fold").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy("lead"))
    return rows.withColumn("n_train", total - F.col("n")).where("fold is not null").select(
        "lead", "fold", F.col("n").alias("n_test"), "n_train"
    )


def segments(df: DataFrame, n_segments: int, keys=("lead", "fold"), order: str = "m") -> DataFrame:
    """Add ``segment``: contiguous blocks of n div n_segments rows, NULL for the remainder.

    A key holds the months of one lead and fold, a size bounded by the calendar.
    """
    w = Window.partitionBy(*keys)
    rows = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(order)) - 1})
    length = F.floor(F.col("_n") / n_segments)
    seg = F.floor(ratio("_r", length)).cast("int")
    return rows.withColumn("segment", F.when(seg < n_segments, seg)).drop("_n", "_r")


def member_sizes(df: DataFrame, n_segments: int, n_members: int, keys=("lead", "fold"), order: str = "m") -> DataFrame:
    """``segment, member, n_train, n_val`` per key: every segment is held out once per member."""
    keys = list(keys)
    counts = segments(df, n_segments, keys, order).groupBy(*keys, "segment").agg(F.count(F.lit(1)).alias("n_val"))
    total = F.sum("n_val").over(Window.partitionBy(*keys))
    rows = counts.withColumn("n_train", total - F.col("n_val")).where("segment is not null")
    members = F.sequence(F.lit(0), F.lit(n_members - 1))
    return rows.select(*keys, "segment", F.explode(members).alias("member"), "n_train", "n_val")


def open_tasks(tasks: DataFrame, registry: DataFrame, keys=("lead", "fold")) -> DataFrame:
    """Tasks that have no trained model yet (left-anti join)."""
    return tasks.join(registry.select(*keys).distinct(), list(keys), "left_anti")
