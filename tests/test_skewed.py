"""Skewed-Gaussian models against numpy and known parameters."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tropicast.operators import learners, skewed, verify

X = "key int, x array<double>, y double, w double"


def draw(rng, n, location, scale, shape):
    """Skewed normals: the larger of two correlated normals, as delta |u| + sqrt(1 - delta^2) v."""
    delta = shape / math.sqrt(1 + shape * shape)
    return location + scale * (delta * np.abs(rng.normal(size=n)) + math.sqrt(1 - delta * delta) * rng.normal(size=n))


def table(spark, parts):
    rows = [(k, [float(c) for c in np.atleast_1d(x)], float(y), 1.0) for k, xs, ys in parts for x, y in zip(xs, ys, strict=True)]
    return spark.createDataFrame(rows, X)


def test_log_cdf():
    t = np.array([-40.0, -31.0, -29.0, -5.0, 0.0, 1.0, 8.0])
    want = [math.log(0.5 * math.erfc(-v / math.sqrt(2))) if v > -37 else -0.5 * v * v - math.log(-v * math.sqrt(2 * math.pi)) for v in t]
    assert np.allclose(skewed.log_cdf(t), want, rtol=2e-3) and np.allclose(skewed.log_cdf(t)[2:], want[2:], rtol=1e-12)


@pytest.mark.parametrize("varies", [(True, False), (True, True), (False, False), (False, True)])
def test_derivatives(varies):
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=(30, 2)), rng.normal(size=30), rng.random(30)
    size = 3 + (3 if varies[0] else 1) + (3 if varies[1] else 1)
    theta = rng.normal(size=size) * 0.5
    loss, g, h = skewed.derivatives(theta, x, y, w, *varies, 0.7)
    step = 1e-5
    for i in range(size):
        ends = [skewed.derivatives(theta + s * step * np.eye(size)[i], x, y, w, *varies, 0.7) for s in (1, -1)]
        assert (ends[0][0] - ends[1][0]) / (2 * step) == pytest.approx(g[i], rel=1e-5, abs=1e-6)
        assert np.allclose((ends[0][1] - ends[1][1]) / (2 * step), h[i], rtol=1e-4, atol=1e-5)


@pytest.mark.parametrize("task_rows", [20_000, 0])
def test_known_parameters(spark, task_rows):
    """Rounds within tasks and rounds over the rows."""
    rng = np.random.default_rng(2)
    parts = []
    for key, (a, b, scale, slope, shape) in enumerate([(1.0, 2.0, 0.5, 0.3, 4.0), (-2.0, 0.5, 2.0, 0.0, -3.0), (0.0, 0.0, 1.0, -0.2, 0.0)]):
        x = rng.normal(size=4000)
        parts.append((key, x, draw(rng, 4000, a + b * x, scale * np.exp(slope * x), shape)))
    rows = table(spark, parts)
    models = {r["key"]: r for r in skewed.fit(rows, ["key"], ridge=0.0, scale_ridge=0.0, shape_ridge=0.0, floor=0.0, task_rows=task_rows).collect()}
    assert len(models) == 3 and {r["n"] for r in models.values()} == {4000.0}
    for key, (a, b, scale, slope, shape) in enumerate([(1.0, 2.0, 0.5, 0.3, 4.0), (-2.0, 0.5, 2.0, 0.0, -3.0)]):
        r = models[key]
        assert r["coef"] == pytest.approx([a, b], abs=0.12)
        assert r["coef_scale"] == pytest.approx([math.log(scale), slope], abs=0.08)
        assert r["coef_shape"][0] == pytest.approx(shape, rel=0.2) and r["coef_shape"][1] == 0.0
    assert abs(models[2]["coef_shape"][0]) < 1.0
    for key, xs, ys in parts:  # a minimum: no step to any side is better
        r = models[key]
        theta = np.concatenate([r["coef"], r["coef_scale"], r["coef_shape"][:1]])
        best = skewed.derivatives(theta, xs[:, None], ys, np.ones(4000), True, False)[0]
        assert best == pytest.approx(r["loss"], rel=1e-9)
        for i in range(5):
            for s in (-0.02, 0.02):
                assert skewed.derivatives(theta + s * np.eye(5)[i], xs[:, None], ys, np.ones(4000), True, False)[0] >= best - 1e-9


def test_better_than_gaussian(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=3000)
    rows = table(spark, [(0, x, draw(rng, 3000, x, 1.0, 5.0))])
    model = skewed.fit(rows, ["key"], ridge=0.0)
    out = rows.join(model, "key").withColumns(dict(zip(("location", "scale", "shape"), skewed._outputs(), strict=True)))
    mean, var, _ = skewed.moments()
    row = out.agg(F.avg(verify.nll_skewed("y", "location", "scale", "shape")).alias("skewed"),
                  F.avg(verify.nll_gaussian("y", mean, F.sqrt(var))).alias("gaussian")).first()
    assert row["skewed"] < row["gaussian"] - 0.05


def test_moments_and_mixture(spark):
    for skew in (-0.8, 0.0, 0.4):
        location, scale, shape = skewed.from_moments(1.5, 4.0, skew)
        one = spark.createDataFrame([(0, location, scale, shape)] * 3, "k int, location double, scale double, shape double")
        row = skewed.mixture(one, ("k",)).first()
        assert (row["mean"], row["std"]) == (pytest.approx(1.5), pytest.approx(2.0))
        assert (row["location"], row["scale"], row["shape"]) == (pytest.approx(location, abs=1e-6), pytest.approx(scale), pytest.approx(shape, abs=1e-5))
    two = spark.createDataFrame([(0, 0.0, 1.0, 0.0), (0, 2.0, 1.0, 0.0)], "k int, location double, scale double, shape double")
    row = skewed.mixture(two, ("k",)).first()
    assert (row["mean"], row["std"], row["shape"]) == (pytest.approx(1.0), pytest.approx(2 ** 0.5), pytest.approx(0.0, abs=1e-4))


def test_few_rows_and_none(spark):
    rows = table(spark, [(0, [0.0, 1.0, 2.0, 3.0], [0.1, 1.2, 1.9, 3.1]), (1, [0.0] * 5, [2.0] * 5)])
    got = {r["key"]: r for r in skewed.fit(rows, ["key"]).collect()}
    assert set(got) == {0, 1} and all(np.isfinite(r["coef"] + r["coef_scale"] + r["coef_shape"]).all() for r in got.values())
    assert skewed.fit(rows.where("key > 5"), ["key"]).count() == 0


def features(spark, n=120, leads=(0, 3)):
    rng = np.random.default_rng(4)
    rows = [(lead, 12 * 1960 + i, 12 * 1960 + i + lead + 3, [float(v) for v in rng.normal(size=2)], float(rng.normal())) for lead in leads for i in range(n)]
    return spark.createDataFrame(rows, "lead int, m int, m_target int, x array<double>, y double").withColumn("target_season", F.col("m_target"))


def test_members(spark):
    """Members of a segment: the first unweighted, the others by weights that a lost task would draw again."""
    edges = (1962, 1965, 1969)
    table_ = features(spark)
    models = learners.mean_ensemble(table_, 4, 1.0, edges, n_members=3).collect()
    assert len(models) == 2 * 2 * 4 * 3
    single = {(r["lead"], r["fold"], r["segment"]): r["coef"] for r in learners.mean_ensemble(table_, 4, 1.0, edges).collect()}
    rows = learners.member_rows(table_, 4, 3, edges).toPandas()
    for r in models:
        own = rows[(rows.lead == r["lead"]) & (rows.fold == r["fold"]) & (rows.segment == r["segment"]) & (rows.member == r["member"])]
        z = np.column_stack([np.ones(len(own)), np.array(list(own.x))])
        a = z.T @ (z * own.w.to_numpy()[:, None]) + np.diag([0.0, 1.0, 1.0])
        assert r["coef"] == pytest.approx(np.linalg.solve(a, z.T @ (own.w * own.y)), abs=1e-8)
        if r["member"] == 0:
            assert r["coef"] == pytest.approx(single[r["lead"], r["fold"], r["segment"]], abs=1e-9) and (own.w == 1).all()
    assert len({tuple(r["coef"]) for r in models}) == len(models)
    out = learners.predict_members(table_, learners.gaussian_ensemble(table_, 4, 1.0, edges, n_members=2), edges)
    assert out.groupBy("lead", "m").count().select("count").distinct().collect() == [(8,)]
