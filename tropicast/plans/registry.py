"""Registry of queries: one per operator ID, with its SQL counterpart where there is one."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


# Means of a few short decimals often end in an exact half, where engines round apart;
# both sides add this many units of the last digit before rounding.
OFF_TIE = 1.3e-3


def _off_ties(sql: str) -> str:
    """Add the offset inside every ``round(expr, digits) + 0e0`` of an oracle query."""
    out, at = [], 0
    for hit in re.finditer(r"round\(", sql):
        depth, i, comma = 1, hit.end(), None
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[i], 0)
            if sql[i] == "," and depth == 1:
                comma = i
            i += 1
        if comma is not None and sql[i:].startswith(" + 0e0"):
            out.append((comma, f" + {OFF_TIE * 10.0 ** -int(sql[comma + 1:i - 1]):.3e}"))
    text = ""
    for place, extra in sorted(out):
        text, at = text + sql[at:place] + extra, place
    return text + sql[at:]


def query(key: str, sql: str | None = None):
    """Register ``fn(views) -> DataFrame`` under an operator ID."""

    def register(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[key] = with_views(_off_ties(sql))
        return fn

    return register


def r(column, digits: int = 6) -> Column:
    """Round for comparison; adding 0 clears a negative zero."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c + F.lit(OFF_TIE * 10.0 ** -digits), digits) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})
