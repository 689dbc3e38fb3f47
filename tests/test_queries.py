"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import pytest
from oracle_check import difference, duck

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_query(spark, con, key):
    assert difference(queries()[key](spark, SF), oracle_sql()[key], con) is None


def _correlations(t, leads=8):
    return t.lead.nunique() == leads and t.r.dropna().between(-1, 1).all()


# what must hold for the results that have no SQL counterpart
BOUNDS = {
    "c11": lambda t: len(t) == 1 and t.r2.between(0, 1).all() and (t.n > 0).all(),
    "c10": lambda t: set(t.part) == {"train", "test"} and t.r.between(-1, 1).all(),
    "r1": _correlations,
    "r2": _correlations,
    "r3": lambda t: _correlations(t) and t.inside1.between(0, 1).all() and (t.rmse > 0).all(),
    "r4": lambda t: len(t) == 16 and (t.qs > 0).all(),
    "r5": lambda t: t.lead.nunique() == 8 and ((t.low <= t.mid) & (t.mid <= t.high)).all(),
    "r6": lambda t: t.lead.nunique() == 8 and t.mode_class.between(0, 41).all() and t.median_class.between(0, 41).all(),
    "r7": lambda t: t.lead.nunique() == 8 and (t.rmse >= 0).all(),
    "r11": lambda t: t.lead.nunique() == 8 and (t.weight > 0).all() and t.variable.between(0, 2).all(),
    "r3_skewed": lambda t: _correlations(t) and t.inside1.between(0, 1).all() and t.nll_skewed.abs().lt(1e6).all() and (t.rmse > 0).all(),
    "v4_search": lambda t: _correlations(t) and (t.rmse > 0).all() and (t.n > 0).all(),
}


@pytest.mark.parametrize("key", sorted(set(queries()) - set(oracle_sql())))
def test_rows_only(spark, key):
    rows = queries()[key](spark, SF).toPandas()
    assert len(rows) and BOUNDS.get(key, lambda t: True)(rows)


def test_entry(spark):
    assert entry(spark).count() > 0
