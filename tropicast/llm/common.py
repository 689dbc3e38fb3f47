"""What several of the training-data operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, drop

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def remainder(column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo ``modulus``; NULL for a NULL id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus


def tasks(df: DataFrame, rows_per_task: int, rows: int) -> int:
    """Tasks so that each gets about ``rows_per_task`` of ``rows``, as many as there are cores at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v longs) as (node, root), root the smallest node.

    Alternating stars: every node's larger neighbours move to its smallest neighbour, then
    every node with its smaller neighbours, until the edges are stars. A round is two
    aggregations and two joins on the shuffled edges; each round is a written table, and the
    one before it is deleted. A node with very many neighbours is a skewed key of a
    plain join, which adaptive execution splits.
    """
    edges = cut(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    stamp = None
    while True:
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == stamp:
            break
        stamp = tuple(row)
        before, edges = edges, cut(_small_star(_large_star(edges)))
        drop(before)
    stars = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    roots = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return stars.unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")),
                   F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    both = edges.select(F.explode(ends).alias("e")).select("e.a", "e.b")
    low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    moved = both.where("b > a").join(low, "a")
    return moved.select(F.col("low").alias("u"), F.col("b").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("v").agg(F.min("u").alias("low"))
    moved = edges.join(low, "v").where("u <> low").select(F.col("low").alias("u"), F.col("u").alias("v"))
    return moved.unionByName(low.select(F.col("low").alias("u"), "v")).distinct()
