"""Search, evolution, the model contract and the model table against numpy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tropicast.operators import folds, learners, search, tuning
from tropicast.sources.models import ModelRegistry

EDGES = (1962, 1965, 1969)
START = 12 * 1960


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = []
    for lead in (0, 6):
        for i in range(130):
            x = rng.normal(size=4)
            y = 2.0 * x[1] - x[3] + 0.5 * rng.normal()
            m = START + i
            rows.append((lead, m, m + lead + 3, [float(c) for c in x], float(y) if i % 17 else None, float(x[0])))
    df = spark.createDataFrame(rows, "lead int, m int, m_target int, x array<double>, y double, y_persistence double")
    return df.withColumn("target_season", F.col("m_target"))


def local(df):
    rows = [r.asDict() for r in df.orderBy("lead", "m").collect()]
    for r in rows:
        year = r["m_target"] // 12
        r["fold"] = next((lo for lo, hi in itertools.pairwise(EDGES) if lo <= year < hi), None)
    return rows


def ridge_fit(rows, inputs, ridge):
    x = np.array([[r["x"][i] for i in inputs] for r in rows])
    y = np.array([r["y"] for r in rows])
    z = np.column_stack([np.ones(len(x)), x])
    coef = np.linalg.solve(z.T @ z + ridge * np.diag([0.0] + [1.0] * len(inputs)), z.T @ y)
    return lambda r: coef[0] + coef[1:] @ np.array([r["x"][i] for i in inputs])


def loss_of(model, rows):
    return float(np.mean([(r["y"] - model(r)) ** 2 for r in rows]))


def segment_rows(rows, lead, fold):
    """Rows in the training years, each with its segment of five (None for the remainder)."""
    train = [r for r in rows if r["lead"] == lead and r["fold"] != fold]
    length = len(train) // 5
    return [(r, i // length if i // length < 5 else None) for i, r in enumerate(train)]


def test_random_search(table):
    space = {"inputs": ([0, 1, 2, 3], 2), "ridge": (0.1, 50.0)}
    history, models = tuning.random_search(table, space, 12, 5, EDGES, seed=3)
    rows = local(table)
    history, models = history.collect(), models.collect()
    assert len(history) == 2 * 2 * 12 and len(models) == 2 * 2 * 5
    best = {}
    for h in history:
        parts = segment_rows(rows, h["lead"], h["fold"])
        losses = []
        for s in range(5):
            model = ridge_fit([r for r, own in parts if own != s and r["y"] is not None], sorted(h["inputs"]), h["ridge"])
            losses.append(loss_of(model, [r for r, own in parts if own == s and r["y"] is not None]))
        assert h["loss"] == pytest.approx(np.mean(losses), rel=1e-9)
        best[h["lead"], h["fold"]] = min(best.get((h["lead"], h["fold"]), (9e9, 0, 0, 0)), (h["loss"], h["candidate"], h["inputs"], h["ridge"]))
    out = {(r["lead"], r["m"]): r for r in tuning.ensemble_hindcast(table, tuning.cut(table.sparkSession.createDataFrame(models)), EDGES).collect()}
    tested = [r for r in rows if r["fold"] is not None]
    assert len(out) == len(tested)
    for lead, fold in best:
        _, candidate, inputs, ridge = best[lead, fold]
        assert {m["candidate"] for m in models if (m["lead"], m["fold"]) == (lead, fold)} == {candidate}
        parts = segment_rows(rows, lead, fold)
        members = [ridge_fit([r for r, own in parts if own != s and r["y"] is not None], sorted(inputs), ridge) for s in range(5)]
        for r in tested:
            if (r["lead"], r["fold"]) == (lead, fold):
                got = out[lead, r["m_target"]]
                assert got["mean"] == pytest.approx(np.mean([f(r) for f in members]), abs=1e-9) and got["y"] == r["y"]


def test_inputs_out_of_range(table):
    products = tuning.fold_products(table, EDGES)
    wrong = table.sparkSession.createDataFrame([(0, [7])], "lead int, inputs array<int>")
    with pytest.raises(Exception, match="of 4 features"):
        tuning.solved(products, wrong).collect()


def test_breed_by_joins(spark):
    """Every gene of a child comes, but for its mutation, from one of the survivors of its own key."""
    space = {"a": (0.0, 1000.0), "e": (["x", "y", "z"], 2)}
    rows = [(k, i, 100.0 * i + k, ["x", "y"] if i % 2 else ["y", "z"], float((i - 4) ** 2 + 0.1 * i)) for k in (1, 2) for i in range(9)]
    population = spark.createDataFrame(rows, "lead int, id int, a double, e array<string>, score double")
    got = search.breed(population, space, 3, 20, 4, ("lead",), strength=0.002, seed=5)
    assert sorted(got.columns) == ["a", "e", "i", "kind", "lead"]
    again = search.breed(population.repartition(5), space, 3, 20, 4, ("lead",), strength=0.002, seed=5)
    got = got.collect()
    assert sorted(map(str, got)) == sorted(map(str, again.collect()))
    survivors = [4, 3, 5]  # scores 0.4, 1.3, 1.5
    for k in (1, 2):
        own = [r for r in got if r["lead"] == k]
        assert len(own) == 27
        clones = {r["i"]: r["a"] for r in own if r["kind"] == "clone"}
        assert all(abs(clones[i] - (100.0 * s + k)) <= 2 for i, s in enumerate(survivors))
        parents = {min(survivors, key=lambda s: abs(r["a"] - 100.0 * s - k)) for r in own if r["kind"] == "offspring"}
        assert parents == set(survivors)
        assert all(len(set(r["e"])) == 2 for r in own)


def test_evolution(table):
    """Three generations, every individual of the last rated as numpy rates it."""
    products = tuning.fold_products(table, EDGES)
    space = {"inputs": ([0, 1, 2, 3], 2), "ridge": (0.0, 100.0)}
    last = tuning.evolve(products, space, F.col("inputs"), 4, 5, 3, 3, strength=0.2, seed=1).collect()
    assert sorted((r["lead"], r["id"]) for r in last) == [(lead, 36 + i) for lead in (0, 6) for i in range(12)]
    rows = [r for r in local(table) if r["y"] is not None]
    for one in last:
        own, want = [r for r in rows if r["lead"] == one["lead"]], []
        for fold in EDGES[:-1]:
            model = ridge_fit([r for r in own if r["fold"] != fold], sorted(one["inputs"]), one["ridge"])
            want.append(loss_of(model, [r for r in own if r["fold"] == fold]))
        assert one["score"] == pytest.approx(np.mean(want), rel=1e-9)


def test_contract_with_two_outputs(table, tmp_path):
    one = table.where("lead = 0").withColumn("z", F.col("y") * F.col("y"))
    estimator = learners.LinearForecast(ridge=(0.0, 20.0), labelCols=["y", "z"], outputNames=["mean", "square"], nIter=8, seed=2)
    model = estimator.fit(one)
    model.save(str(tmp_path / "m"))
    loaded = learners.LinearForecastModel.load(str(tmp_path / "m"))
    assert loaded.output_names == ["mean", "square"] and loaded.n_outputs == 2 and loaded.mean_val_loss == model.mean_val_loss
    rows = [r for r in local(one) if r["y"] is not None]
    x = np.column_stack([np.ones(len(rows)), np.array([r["x"] for r in rows])])
    y = np.array([[r["y"], r["y"] ** 2] for r in rows])

    def solve(at, ridge):
        return np.linalg.solve(x[at].T @ x[at] + ridge * np.diag([0.0, 1, 1, 1, 1]), x[at].T @ y[at])

    ridges = [r["ridge"] for r in search.random_candidates(one.select(F.lit(0).alias("_all")).distinct(), {"ridge": (0.0, 20.0)}, 8, 2).orderBy("candidate").collect()]
    length, at = len(rows) // 5, np.arange(len(rows))
    losses = []
    for ridge in ridges:
        parts = [(at // length == s) & (at < 5 * length) for s in range(5)]
        losses.append(np.mean([np.mean((y[p] - x[p] @ solve(~p, ridge)) ** 2) for p in parts]))
    assert model.mean_val_loss == pytest.approx(min(losses), rel=1e-9)
    ridge = ridges[int(np.argmin(losses))]
    coef = solve(at >= 0, ridge)
    assert model.getOrDefault("ridge") == pytest.approx(ridge)
    assert model.getOrDefault("coefficients") == pytest.approx(coef.T.ravel().tolist(), abs=1e-8)
    errors = np.sqrt(np.mean((y - x @ coef) ** 2, axis=0))
    assert list(loaded.evaluate(one).values()) == pytest.approx(errors.tolist())
    got = {r["m"]: (r["mean"], r["square"]) for r in loaded.predict(one).collect()}
    assert len(got) == one.count()
    for r, want in zip(rows, x @ coef, strict=True):
        assert got[r["m"]] == pytest.approx(tuple(want))


def test_contract_without_search(table):
    model = learners.LinearForecast(ridge=0.5).fit(table.where("lead = 6"))
    assert np.isnan(model.mean_val_loss) and model.output_names == ["mean"]
    with pytest.raises(ValueError, match="2 labels for 1 outputs"):
        learners.LinearForecast(labelCols=["y", "m"])


def test_training_resumes(spark, tmp_path):
    """A run that dies in its second lead keeps the first; the next run trains the rest, once each."""
    registry = ModelRegistry(spark, str(tmp_path / "models"))
    tasks = spark.createDataFrame([(lead, fold) for lead in (0, 3, 6) for fold in (1963, 1972)], "lead int, fold int")
    seen = []

    def learner(todo, fail_at=None):
        rows = [(r["lead"], r["fold"]) for r in todo.collect()]
        seen.extend(rows)
        out = spark.createDataFrame([(a, b, [float(a), float(b)]) for a, b in rows], "lead int, fold int, coef array<double>")
        if fail_at is not None:  # fails while the models are written
            out = out.withColumn("coef", F.when(F.col("lead") == fail_at, F.raise_error(F.lit("killed"))).otherwise(F.col("coef")))
        return out

    assert registry.models("a") is None
    with pytest.raises(Exception, match="killed"):
        registry.train(tasks, "a", lambda t: learner(t, 3), (0, 3, 6))
    assert {r["lead"] for r in registry.models("a").collect()} == {0}
    assert registry.train(tasks, "a", learner, (0, 3, 6)) == 4
    assert sorted(seen) == sorted([(a, b) for a in (0, 3, 6) for b in (1963, 1972)] + [(3, 1963), (3, 1972)])
    assert registry.train(tasks, "a", learner, (0, 3, 6)) == 0
    assert registry.train(tasks, "b", learner, (0,)) == 2
    stored = registry.models("a")
    assert stored.count() == 6 and folds.open_tasks(tasks, stored).count() == 0
    registry.append(spark.createDataFrame([(0, 1963, [9.0, 9.0])], "lead int, fold int, coef array<double>"), "a")
    assert {tuple(r["coef"]) for r in registry.models("a").where("lead = 0 and fold = 1963").collect()} == {(0.0, 1963.0)}
