"""Scores, ensembles, learners and search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tropicast.functions.calendar import month_date
from tropicast.operators import ensemble, folds, learners, search, verify

M = 12 * 2000


def forecast(spark, rows):
    """Rows (y, mean, std) as one model and lead."""
    data = [("a", 0, M + i, *map(float, r)) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "model string, lead int, m int, y double, mean double, std double")


def one(df, column):
    return df.first()[column]


def test_mixture(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 1.0)], "k int, mean double, std double")
    row = ensemble.gaussian_mixture(df, ("k",)).first()
    assert row["mean"] == 1.0 and row["std"] == pytest.approx(2 ** 0.5)
    gap = df.unionByName(spark.createDataFrame([(1, 1.0, None)], "k int, mean double, std double"))
    assert ensemble.gaussian_mixture(gap, ("k",)).first()["std"] is None


def test_gaussian_nll(spark):
    assert one(verify.gaussian_nll(forecast(spark, [(1, 0, 1), (0, 0, 2)])), "nll") == pytest.approx(0.596574, abs=1e-6)
    assert one(verify.gaussian_nll(forecast(spark, [(1, 0, 0)])), "nll") is None


def test_pinball(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0)], "y double, f double")
    row = df.agg(F.avg(verify.pinball("y", "f", 0.84)).alias("a"), F.sum(verify.pinball("y", "f", 0.84)).alias("s")).first()
    assert (row.a, row.s) == (pytest.approx(0.5), pytest.approx(1.0))


def test_coverage_is_strict(spark):
    df = forecast(spark, [(1, 0, 1)])
    assert one(df.agg(verify.fraction(verify.inside()).alias("f")), "f") == 0.0
    assert one(df.agg(verify.fraction(verify.below()).alias("f")), "f") == 0.0


def test_constant_forecast_scores_null(spark):
    assert one(verify.correlation(forecast(spark, [(1, 3, 1), (2, 3, 1), (5, 3, 1)])), "r") is None


def test_interval_probabilities(spark):
    probs = verify.interval_probabilities(forecast(spark, [(0, 0, 1)])).collect()
    assert sum(p.prob for p in probs) == pytest.approx(1.0)
    assert {p["class"]: p.prob for p in probs}[6] == pytest.approx(0.191462, abs=1e-6)  # (-0.5, 0]


def test_distribution_summary(spark):
    rows = [("a", 0, 1, k, p) for k, p in enumerate((0.1, 0.25, 0.4, 0.25))]
    df = spark.createDataFrame(rows, "model string, lead int, target_season int, class int, prob double")
    row = verify.distribution_summary(df).first()
    assert (row.mode_class, row.median_class, row.stdm1_class, row.stdp1_class) == (2, 1, 0, 2)


def test_scores_share_one_aggregate(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=48)
    df = verify.with_keys(forecast(spark, [(a, a + b, 1) for a, b in zip(y, rng.normal(size=48))]), (2000, 2002, 2004))
    table = verify.scores(df, {"all": (), "decade": ("decade",), "season": ("season",)})
    counts = {r["level"]: r["count"] for r in table.groupBy("level").count().collect()}
    assert counts == {"all": 1, "decade": 2, "season": 12}
    whole = table.where("level = 'all'").first()
    assert whole.r == pytest.approx(verify.correlation(df).first().r)


def test_spread_estimate_holds_the_decade_out(spark):
    rng = np.random.default_rng(1)
    y, f = rng.normal(size=120), rng.normal(size=120)
    f = f + y
    edges = (2000, 2005, 2010)
    df = forecast(spark, [(a, b, 1) for a, b in zip(y, f)])
    obs = spark.createDataFrame([(M + i, float(v)) for i, v in enumerate(y)], "m int, value double")
    got = {(r.decade, r.month): r.std_estimate for r in verify.std_estimate(df, obs, edges).collect()}
    train = slice(60, 120)
    r = np.corrcoef(y[train], f[train])[0, 1]
    want = np.std(y[train][3::12], ddof=1) * np.sqrt(1 - r * r)
    assert len(got) == 24 and got[(2000, 4)] == pytest.approx(want)


def test_overlapping_decades(spark):
    df = spark.createDataFrame([(12 * 2005 + 3,)], "m int")
    pick = lambda o: df.select(folds.folds_of("m", (2000, 2005, 2010), o).alias("d")).first().d
    assert pick(False) == [2005] and pick(True) == [2000, 2005]


def table(spark, n=240, p=4, leads=(0,), seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, p))
    y = x @ np.array([1.0, -0.5, 0.0, 0.2])[:p] + 0.3 * rng.normal(size=n)
    rows = [(lead, M + i, M + i + lead + 3, [float(q) for q in x[i]], float(y[i]), 0.0) for lead in leads for i in range(n)]
    df = spark.createDataFrame(rows, "lead int, m int, m_target int, x array<double>, y double, y_persistence double")
    return x, y, df.withColumn("target_season", month_date("m_target"))


EDGES = (2000, 2010, 2021)


def test_lasso_conditions(spark):
    x, y, df = table(spark)
    models = {(m.fold, m.alpha): m.coef for m in learners.lasso_models(df, (0.0, 0.1), EDGES).collect()}
    year = (M + 3 + np.arange(240)) // 12
    for fold, test in ((2000, (year >= 2000) & (year < 2010)), (2010, year >= 2010)):
        a, b = x[~test], y[~test]
        ls = np.linalg.lstsq(np.column_stack([np.ones(len(a)), a]), b, rcond=None)[0]
        assert models[(fold, 0.0)] == pytest.approx(list(ls), abs=1e-6)
        c = np.array(models[(fold, 0.1)])
        res = b - c[0] - a @ c[1:]
        g = np.abs((a - a.mean(0)).T @ res) / len(a)
        assert np.all(g <= 0.1 + 1e-6) and g[c[1:] != 0] == pytest.approx(0.1, abs=1e-6)


def test_members_leave_their_segment_out(spark):
    x, y, df = table(spark)
    got = {(m.fold, m.segment): m.coef for m in learners.mean_ensemble(df, 5, 0.0, EDGES).collect()}
    year = (M + 3 + np.arange(240)) // 12
    train = np.flatnonzero(year >= 2010)
    assert len(got) == 10
    length = len(train) // 5
    keep = np.delete(train, np.s_[length:2 * length])
    ls = np.linalg.lstsq(np.column_stack([np.ones(len(keep)), x[keep]]), y[keep], rcond=None)[0]
    assert got[(2000, 1)] == pytest.approx(list(ls), abs=1e-6)


def test_hindcast_start_is_checked(spark):
    _, _, df = table(spark)
    models = learners.lasso_models(df, (0.1,), EDGES)
    assert str(learners.hindcast(df, models, EDGES, "2000-04-01").agg(F.min("target_season")).first()[0]) == "2000-04-01"
    with pytest.raises(ValueError):
        learners.hindcast(df, models, EDGES, "1963-01-01")


def test_quantile_models_are_near_the_optimum(spark):
    x, y, df = table(spark, p=1)
    coef = {m.fold: m.coef for m in learners.quantile_models(df, (0.84,), EDGES).collect()}[2000]
    year = (M + 3 + np.arange(240)) // 12
    a, b = x[year >= 2010, 0], y[year >= 2010]

    def loss(c0, c1):
        e = b - c0 - c1 * a
        return np.maximum(0.84 * e, -0.16 * e).mean()

    best = min(loss(p, q) for p in np.linspace(0, 1, 101) for q in np.linspace(0.5, 1.5, 101))
    assert loss(*coef) <= best * 1.01


def test_quantiles_do_not_cross(spark):
    _, _, df = table(spark, p=2)
    models = learners.quantile_models(df, (0.1, 0.5, 0.9), EDGES)
    for row in learners.predict_quantiles(df, models, EDGES).collect():
        assert list(row.forecast) == sorted(row.forecast)


def test_unsettled_models_raise(spark):
    _, _, df = table(spark, p=1)
    with pytest.raises(ValueError, match="open"):
        learners.quantile_models(df, (0.5,), EDGES, max_rounds=1)
    with pytest.raises(ValueError, match="move"):
        learners._lasso(np.array([[9.0, 1, 2, 3], [1, 5, 4, 2], [2, 4, 5, 1], [3, 2, 1, 9]]).ravel(), 0.01, rounds=2)


def test_interval_models_meet_the_optimality_conditions_and_hold_out_their_decade(spark):
    x, y, df = table(spark, p=2)
    models = learners.interval_models(df, low=-1.0, step=0.5, count=6, edges=EDGES).collect()
    w = {m.fold: np.array(m.coef) for m in models}[2000]
    year = (M + 3 + np.arange(240)) // 12
    z, b = np.column_stack([np.ones(240), x])[year >= 2010], y[year >= 2010]
    label = np.clip(np.ceil((b + 1.0) / 0.5), 0, 5).astype(int)
    e = np.exp(z @ w.T)
    slope = (e / e.sum(1, keepdims=True) - np.eye(6)[label]).T @ z / len(z) + 0.01 * w
    assert np.abs(slope).max() < 1e-5
    probs = learners.interval_hindcast(df, spark.createDataFrame(models), EDGES).collect()
    total = {}
    for row in probs:
        total[row.lead, row.m] = total.get((row.lead, row.m), 0.0) + row.prob
    assert len(total) == 240 and list(total.values()) == pytest.approx([1.0] * 240)


def test_model_contract(spark, tmp_path):
    _, _, df = table(spark)
    learners.LinearForecast(ridge=0.5).fit(df).save(str(tmp_path / "m"))
    model = learners.LinearForecastModel.load(str(tmp_path / "m"))
    assert model.n_outputs == 1 and model.transform(df).where("mean is null").count() == 0


def test_search_space(spark):
    space = {"a": (1, 3), "b": (0.5, 1.5), "c": (0.01, 1.0, "log"), "d": (2, (3, 5), "exp"), "e": (["x", "y", "z"], 2), "f": ((1, 2), (3, 4))}
    keys = spark.createDataFrame([(0,), (3,)], "lead int")
    rows = search.random_candidates(keys, space, 200).collect()
    again = search.random_candidates(keys.repartition(5), space, 200).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert {r.a for r in rows} == {1, 2, 3} and {r.d for r in rows} == {8.0, 16.0, 32.0}
    assert all(0.5 <= r.b < 1.5 and 0.01 <= r.c <= 1.0000001 and len(set(r.e)) == 2 and 1 <= r.f[0] <= 3 for r in rows)


def test_next_generation(spark):
    space = {"a": (0.0, 1.0), "n": (1, 9), "e": (["x", "y", "z"], 2)}
    rows = [(i, i / 20.0, 1 + i % 9, ["x", "y"], float((i - 7) ** 2)) for i in range(20)]
    population = spark.createDataFrame(rows, "id int, a double, n int, e array<string>, score double")
    got = search.next_generation(population, space, 3, 5, 4, seed=1).collect()
    kinds = [r.kind for r in got]
    assert (kinds.count("clone"), kinds.count("offspring"), kinds.count("new")) == (3, 5, 4)
    for r in got:
        assert 0 <= r.a <= 1 and 1 <= r.n <= 9 and len(set(r.e)) == 2
    clone = next(r for r in got if r.kind == "clone" and r.i == 0)
    assert abs(clone.a - 7 / 20) <= 0.02


def test_linear_forecast_equals_least_squares(spark):
    x, y, df = table(spark)
    coef = learners.LinearForecast(ridge=0.0).fit(df).getOrDefault("coefficients")
    want = np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]
    assert coef == pytest.approx(list(want), abs=1e-8)


def test_gaussian_members_find_the_spread(spark):
    _, _, df = table(spark, n=252)
    members = learners.predict_members(df, learners.gaussian_ensemble(df, 5, 1.0, EDGES), EDGES)
    mixed = ensemble.gaussian_mixture(members, ("lead", "m"))
    row = mixed.agg(F.avg("std").alias("s"), F.count("std").alias("n"), F.min("std").alias("low")).first()
    assert row.s == pytest.approx(0.3, rel=0.35) and row.low > 0


def test_relevance_keeps_the_strong_predictors(spark):
    _, _, df = table(spark)
    rows = learners.relevance(learners.mean_ensemble(df, 5, 1.0, EDGES), 2).collect()
    assert {(r.lag, r.variable) for r in rows} == {(0, 0), (0, 1)}


def test_class_probabilities_sum_to_one(spark):
    _, y, df = table(spark)
    model = learners.interval_classifier(df, low=-2.0, step=1.0, count=5, max_iter=20)
    probs = learners.classify(model, df)
    sums = [r[0] for r in probs.groupBy("m").agg(F.sum("prob")).select("sum(prob)").collect()]
    assert sums == pytest.approx([1.0] * len(y))
    best = probs.groupBy("m", "y").agg(F.max_by("class", "prob").alias("c")).collect()
    hit = np.mean([abs(r.c - np.clip(np.ceil(r.y + 2.0), 0, 5)) <= 1 for r in best])
    assert hit > 0.9


def test_field_forecast_equals_the_dense_computation(spark):
    """A travelling wave with noise: encode, regress and decode again with dense matrices."""
    rng = np.random.default_rng(6)
    t, c = np.arange(120), np.arange(16)
    x = np.sin(2 * np.pi * (t[:, None] / 24.0 - c[None, :] / 16.0)) + 0.1 * rng.normal(size=(120, 16))
    rows = [(0.0, float(k), M + int(i), float(x[i, k])) for i in t for k in c]
    df = spark.createDataFrame(rows, "lat double, lon double, m int, value double")
    got = {(r.m - M, int(r.lon)): r.value for r in learners.field_forecast(df, lead=3, k=2, ridge=0.0).collect()}

    d = x - np.column_stack([np.polyval(np.polyfit(t, x[:, k], 1), t) for k in c])
    v = np.linalg.svd(d - d.mean(0), full_matrices=False)[2][:2]
    pc = d @ v.T
    design = np.column_stack([np.ones(120), pc])
    coef = np.linalg.lstsq(design[:-6], pc[6:], rcond=None)[0]
    want = (design @ coef) @ v
    assert len(got) == want.size
    assert [got[(i + 6, k)] for i in t for k in c] == pytest.approx(list(want.ravel()), abs=1e-6)
    # and the forecast is worth something: the wave is predictable
    assert np.corrcoef(want[:-6].ravel(), d[6:].ravel())[0, 1] > 0.95


def test_scaling_can_leave_years_out(spark):
    from tropicast.functions.stats import standardise

    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 100.0)], "i int, x double")
    got = standardise(df, "x", fit_on=F.col("i") < 2).orderBy("i").collect()
    assert [r.x for r in got] == [-1.0, 1.0, 98.0]
