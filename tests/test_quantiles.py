"""Joint quantile models against brute force and against quantiles fitted apart."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tropicast.functions.calendar import month_date
from tropicast.operators import learners, quantiles

M = 12 * 2000
EDGES = (2000, 2010, 2020)
LEVELS = (0.1, 0.5, 0.9)


def table(spark, gaps=False):
    """Twenty years whose spread grows with the size of the first of two inputs."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(240, 2))
    y = x[:, 0] - 0.5 * x[:, 1] + (0.3 + 0.8 * np.abs(x[:, 0])) * rng.normal(size=240)
    rows = [(0, M + i, M + i + 3, x[i].tolist(), None if gaps and i % 50 == 0 else float(y[i])) for i in range(240)]
    df = spark.createDataFrame(rows, "lead int, m int, m_target int, x array<double>, y double")
    return df.withColumn("target_season", month_date("m_target")).withColumn("y_persistence", F.lit(0.0))


def pinball(rows):
    return np.mean([max(q * (row.y - f), (q - 1) * (row.y - f)) for row in rows for q, f in zip(LEVELS, row.forecast, strict=True)])


def test_bounded_squares_are_the_best_of_all_active_sets():
    rng = np.random.default_rng(2)
    for _ in range(25):
        x, y = rng.normal(size=(30, 4)), rng.normal(size=30)
        z = np.column_stack([np.ones(30), x, y])
        got = quantiles.bounded_least_squares((z.T @ z).ravel(), 2, 0.0)
        a, best = z[:, :5], None
        for kept in itertools.product([False, True], repeat=3):
            use = np.r_[True, True, kept]
            b = np.zeros(5)
            b[use] = np.linalg.lstsq(a[:, use], y, rcond=None)[0]
            if (b[2:] >= 0).all():
                loss = ((y - a @ b) ** 2).sum()
                best = loss if best is None else min(best, loss)
        assert (got[2:] >= 0).all()
        assert ((y - a @ got) ** 2).sum() == pytest.approx(best, rel=1e-9)


def test_joint_quantiles_rise_unsorted_and_lose_no_more(spark):
    df = table(spark).cache()
    apart = learners.predict_quantiles(df, learners.quantile_models(df, LEVELS, EDGES), EDGES).collect()
    joint = quantiles.predict_joint(df, quantiles.joint_models(df, LEVELS, EDGES), LEVELS, EDGES).collect()
    assert len(joint) == len(apart) > 200
    assert all(list(row.forecast) == sorted(row.forecast) for row in joint)
    assert pinball(joint) <= pinball(apart)
    # about a tenth of the months lie outside on each side
    assert 0.04 < np.mean([row.y < row.forecast[0] for row in joint]) < 0.2
    assert 0.04 < np.mean([row.y > row.forecast[2] for row in joint]) < 0.2


def test_joint_models_of_odd_rows(spark):
    """Rows without y take no part; one level is a plain quantile; no rows give no models; levels are checked."""
    df = table(spark, gaps=True)
    assert quantiles.joint_models(df, LEVELS, EDGES).count() == 2
    one = {m.fold: m.coef for m in quantiles.joint_models(df, (0.5,), EDGES).collect()}
    plain = {m.fold: m.coef for m in learners.quantile_models(df.where("y is not null"), (0.5,), EDGES).collect()}
    assert one[2000] == pytest.approx(plain[2000], abs=1e-3)
    assert quantiles.joint_models(df.where("false"), LEVELS, EDGES).count() == 0
    with pytest.raises(ValueError, match="between"):
        quantiles.joint_models(df, (0.0, 0.5), EDGES)
