"""Combination of ensemble members and of separately run outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import nonneg


def gaussian_mixture(members: DataFrame, keys=("target_season", "lead")) -> DataFrame:
    """Mean of means; variance mean(mu^2 + sigma^2) - mean^2, NULL if a member has no sigma."""
    mu, sd = F.col("mean"), F.col("std")
    table = members.groupBy(*keys).agg(
        F.avg(mu).alias("mean"), F.avg(mu * mu + sd * sd).alias("_second"), (F.count(mu) == F.count(mu * sd)).alias("_full")
    )
    var = nonneg(F.col("_second") - F.col("mean") * F.col("mean"))
    return table.select(*keys, "mean", F.when(F.col("_full"), F.sqrt(var)).alias("std"))


def plain_mean(members: DataFrame, outputs: list, keys=("target_season", "lead")) -> DataFrame:
    """Mean of each output (quantile and class-probability ensembles)."""
    return members.groupBy(*keys).agg(*[F.avg(o).alias(o) for o in outputs])


def merge_outputs(long: DataFrame, outputs: list, keys=("target_season", "m", "lead")) -> DataFrame:
    """Separately run outputs (long form) as one cube with a column per output."""
    return long.groupBy(*keys).pivot("output", outputs).agg(F.first("value"))
