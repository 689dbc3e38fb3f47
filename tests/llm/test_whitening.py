"""Whitening against exact rational arithmetic and numpy, with every odd case."""

from fractions import Fraction

import numpy as np
import pytest

from tropicast.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, n string, whitened string, deviation string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 0, "a", "b", "c") for i, v in vectors], SCHEMA)


def brute(vectors, count=32):
    """n, deviations, covariance from fractions, and components by numpy."""
    good = [(i, v) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(64 * np.float64(np.float32(c)))) + 1_000_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    sums = [sum(row[k] for row in x) for k in range(d)]
    mean = [Fraction(s, n) for s in sums]
    v = np.array([[float(sum((row[i] - mean[i]) * (row[j] - mean[j]) for row in x) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:count]
    e, u = e[order], u[:, order]
    centred = np.array([[float(row[k] - mean[k]) for k in range(d)] for row in x])
    deviations = [sum((n * row[k] - sums[k]) ** 2 for k in range(d)) for row in x]
    return [i for i, _ in good], n, deviations, centred @ u, e, v


def compare(got, vectors):
    ids, n, deviations, projected, e, v = brute(vectors)
    used = int((e > len(v) * np.finfo(float).eps * e[0]).sum())
    assert len(got) == len(ids) * len(e)
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r
    assert {r["n"] for r in got} == {n}
    white = np.zeros((len(ids), used))
    for k, i in enumerate(ids):
        rows = by[i]
        assert sorted(rows) == list(range(1, len(e) + 1))
        assert {r["deviation"] for r in rows.values()} == {deviations[k]}
        for c, r in rows.items():
            assert r["explained"] == pytest.approx(e[c - 1] / np.trace(v), rel=1e-9, abs=1e-12)
            assert (r["whitened"] is None) == (c > used)
            if c <= used:
                white[k, c - 1] = r["whitened"]
    for c in range(used):
        want = projected[:, c] / np.sqrt(e[c])
        assert min(np.abs(white[:, c] - want).max(), np.abs(white[:, c] + want).max()) < 1e-6
    (error,) = {r["identity_error"] for r in got}
    assert error < 1e-9 and error == pytest.approx(np.abs(np.cov(white.T, bias=True).reshape(used, used) - np.eye(used)).max(), abs=1e-11)


def rows(spark, vectors):
    return [r.asDict() for r in whitening.op11_whitening(table(spark, vectors)).collect()]


def random_vectors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) + rng.normal(size=d) * 5
    return [(i, [float(c) for c in v]) for i, v in enumerate(values)]


def test_against_fractions(spark):
    compare(rows(spark, random_vectors(200, 7)), random_vectors(200, 7))


def test_components_stop_at_32(spark):
    vectors = random_vectors(90, 40, 1)
    got = rows(spark, vectors)
    assert {r["component"] for r in got} == set(range(1, 33))
    compare(got, vectors)


def test_odd_rows_are_dropped(spark):
    vectors = random_vectors(40, 3, 2)
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, [1.0, 2.0]), (105, [])]
    got = rows(spark, vectors + odd)
    assert {r["vec_id"] for r in got} == set(range(40))
    compare(got, vectors)


def test_repeated_rows_and_null_ids(spark):
    vectors = random_vectors(10, 3, 3)
    got = rows(spark, vectors + [(None, vectors[0][1])] + vectors[:2])
    assert len(got) == 13 * 3 and {r["n"] for r in got} == {13}
    assert sum(r["vec_id"] is None for r in got) == 3


def test_directions_without_variance(spark):
    vectors = [(i, [float(i), 2.0 * i, 7.0]) for i in range(6)]
    compare(rows(spark, vectors), vectors)
    same = rows(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert len(same) == 4 and all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in same)


def test_one_dimension_and_large_entries(spark):
    compare(rows(spark, [(i, [float(v)]) for i, v in enumerate([1, 5, -3, 2])]), [(i, [float(v)]) for i, v in enumerate([1, 5, -3, 2])])
    vectors = [(i, [float(np.float32(v * 3.0e9)), float(v % 2)]) for i, v in enumerate(range(9))]
    got = rows(spark, vectors)
    ids, n, deviations, *_ = brute(vectors)
    want = {i: (w if w < 1 << 63 else None) for i, w in zip(ids, deviations)}
    assert {r["vec_id"]: r["deviation"] for r in got} == want and None in want.values()


def test_empty(spark):
    assert rows(spark, []) == [] and rows(spark, [(1, None), (2, [])]) == []


def test_sums_do_not_overflow():
    wide = np.full((3, 2), 1 << 40)
    assert whitening._square_sums(wide) == [3 << 80] * 2
    assert whitening._column_sums(np.full((4, 1), (1 << 62) - 1)) == [4 * ((1 << 62) - 1)]
