"""Month arithmetic.

Every monthly table carries ``m = 12 * year + month - 1`` as INT, so that lags are
equi-joins on integers and windows can use RANGE frames over calendar months.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-month season label -> calendar month of its last month.
SEASON_LAST_MONTH = {
    "DJF": 2, "JFM": 3, "FMA": 4, "MAM": 5, "AMJ": 6, "MJJ": 7,
    "JJA": 8, "JAS": 9, "ASO": 10, "SON": 11, "OND": 12, "NDJ": 1,
}


def month_number(time) -> Column:
    time = F.col(time) if isinstance(time, str) else time
    return (F.year(time) * 12 + F.month(time) - 1).cast("int")


def month_date(m) -> Column:
    m = F.col(m) if isinstance(m, str) else m
    return F.make_date(F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1))


def calendar_month(m) -> Column:
    m = F.col(m) if isinstance(m, str) else m
    return (F.pmod(m, F.lit(12)) + 1).cast("int")


def season_number(m) -> Column:
    """Season slot of a target month: the calendar month before it, so slot 1 is DJF."""
    m = F.col(m) if isinstance(m, str) else m
    return (F.pmod(m - 1, F.lit(12)) + 1).cast("int")


def season_month(label) -> Column:
    """Last month (1-12) of a season label; NULL for an unknown label."""
    label = F.col(label) if isinstance(label, str) else label
    pairs = [F.lit(x) for item in SEASON_LAST_MONTH.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), label)


def season_date(label, year) -> Column:
    """First day of the last month of the season; ``NDJ`` rolls into the next year."""
    label = F.col(label) if isinstance(label, str) else label
    year = F.col(year) if isinstance(year, str) else year
    carry = F.when(label == "NDJ", 1).otherwise(0)
    return F.make_date((year + carry).cast("int"), season_month(label), F.lit(1))
