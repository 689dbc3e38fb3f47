"""Reproducible random numbers.

A number is a hash of the row's own identity, so a recomputed task after a lost executor
draws the same values, whatever the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*identity, seed: int = 0) -> Column:
    """Uniform in [0, 1) from the identity columns and a seed."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in identity]
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 12)
    return F.conv(digest, 16, 10).cast("double") / float(16 ** 12)


def pick(n, *identity, seed: int = 0) -> Column:
    """Uniform integer 0..n-1."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(uniform(*identity, seed=seed) * n).cast("int")
