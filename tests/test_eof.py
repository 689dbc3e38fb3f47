"""Patterns by block Krylov passes over packed cells, and field forecasts of decades left out, against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tropicast.operators import eof, learners

START = 12 * 1960


def frame(spark, x):
    rows = [(0.0, float(c), START + t, None if np.isnan(x[t, c]) else float(x[t, c])) for t in range(x.shape[0]) for c in range(x.shape[1])]
    return spark.createDataFrame(rows, "lat double, lon double, m int, value double")


def line(x, keep):
    """Trend of each column over the rows in ``keep``, for all rows."""
    t = np.arange(len(x))
    return np.column_stack([np.polyval(np.polyfit(t[keep], x[keep, c], 1), t) for c in range(x.shape[1])])


def signed(v):
    return v * np.sign(v[np.abs(v).argmax()])


@pytest.mark.parametrize(("n", "c", "noise"), [(100, 40, True), (60, 100, True), (200, 30, False)])
def test_rounds(spark, monkeypatch, n, c, noise):
    """Blocks far narrower than the axis: white noise, whose eigenvalues lie close together, and a few waves."""
    monkeypatch.setattr(eof, "BLOCK_ELEMENTS", 0)
    rng = np.random.default_rng(n + c)
    x = rng.normal(size=(n, c))
    if not noise:
        t = np.arange(n)
        x = 0.01 * x + sum((4 - j) * np.outer(np.sin(t * (0.2 + 0.3 * j)), rng.normal(size=c)) for j in range(4))
    fitted = eof.fit(frame(spark, x), 3, detrend=True)
    d = x - line(x, np.ones(n, bool))
    _, s, vt = np.linalg.svd(d, full_matrices=False)
    assert fitted.folds[0].q.shape[1] > 11 or not noise
    assert fitted.explained == pytest.approx((s ** 2 / (s ** 2).sum())[:3].tolist(), rel=1e-9)
    got = {(r["mode"], int(r.lon)): r.loading for r in fitted.patterns.collect()}
    pc = {(r["mode"], r.m - START): r.value for r in fitted.project().collect()}
    for k in range(3):
        v = signed(vt[k])
        assert [got[k + 1, j] for j in range(c)] == pytest.approx(v.tolist(), abs=2e-5)
        assert [pc[k + 1, i] for i in range(n)] == pytest.approx((d @ v).tolist(), abs=2e-4)


def test_restart(spark, monkeypatch):
    monkeypatch.setattr(eof, "BLOCK_ELEMENTS", 0)
    monkeypatch.setattr(eof, "BASIS", 40)
    rng, t = np.random.default_rng(3), np.arange(120)
    x = 0.3 * rng.normal(size=(120, 60)) + sum((6 - j) * np.outer(np.sin(t * (0.2 + 0.3 * j)), rng.normal(size=60)) for j in range(4))
    fitted = eof.fit(frame(spark, x), 3)
    s = np.linalg.svd(x - x.mean(0), compute_uv=False) ** 2
    assert fitted.explained == pytest.approx((s / s.sum())[:3].tolist(), rel=1e-7)


def test_gaps_and_folds(spark):
    """Gaps and missing months are 0; a fold's patterns do not change with the months it leaves out."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(72, 9)) + np.linspace(0, 3, 72)[:, None]
    x[5, 2] = np.nan
    df = frame(spark, x).where(~((F.col("m") == START + 40) & (F.col("lon") == 3.0)))
    folds = {1961: (12 * 1961, 12 * 1963), 1963: (12 * 1963, 12 * 1965)}
    fitted = eof.fit(df, 2, detrend=True, folds=folds)
    filled = np.nan_to_num(x)
    filled[40, 3] = 0.0
    got = {(r["fold"], r["mode"], int(r.lon)): r.loading for r in fitted.patterns.collect()}
    months = START + np.arange(72)
    for f, (a, b) in folds.items():
        keep = (months < a) | (months >= b)
        d = filled - line(filled, keep)
        s, vt = np.linalg.svd(d[keep], full_matrices=False)[1:]
        assert fitted.explained[f] == pytest.approx((s ** 2 / (s ** 2).sum())[:2].tolist())
        for k in range(2):
            assert [got[f, k + 1, c] for c in range(9)] == pytest.approx(signed(vt[k]).tolist(), abs=1e-8)
    shifted = df.withColumn("value", F.when((F.col("m") >= 12 * 1961) & (F.col("m") < 12 * 1963), F.col("value") * 50.0 + 7.0).otherwise(F.col("value")))
    other = {(r["fold"], r["mode"], int(r.lon)): r.loading for r in eof.fit(shifted, 2, detrend=True, folds=folds).patterns.collect()}
    assert all(other[k] == pytest.approx(v, abs=1e-9) for k, v in got.items() if k[0] == 1961)
    assert eof.fit(df.where("false"), 2, folds=folds).patterns.count() == 0


def test_field_hindcast(spark):
    rng = np.random.default_rng(6)
    t, c = np.arange(144), np.arange(10)
    x = np.sin(2 * np.pi * (t[:, None] / 24.0 - c[None, :] / 10.0)) + 0.1 * rng.normal(size=(144, 10)) + 0.01 * t[:, None]
    edges = (1962, 1965, 1970)
    out = learners.field_hindcast(frame(spark, x), (0, 6), k=2, ridge=0.5, edges=edges).collect()
    got = {(r.fold, r.lead, r.m - START, int(r.lon)): r.value for r in out}
    months, seen = START + t, 0
    for lo, hi in ((1962, 1965), (1965, 1970)):
        inside = (months // 12 >= lo) & (months // 12 < hi)
        trend = line(x, ~inside)
        d = x - trend
        v = np.linalg.svd(d[~inside], full_matrices=False)[2][:2]
        pc = d @ v.T
        for lead in (0, 6):
            i = np.arange(144 - lead - 3)
            later = i + lead + 3
            use = ~inside[i] & ~inside[later]
            z = np.column_stack([np.ones(len(i)), pc[i]])
            coef = np.linalg.solve(z[use].T @ z[use] + np.diag([0.0, 0.5, 0.5]), z[use].T @ pc[later[use]])
            for j in i:
                if inside[j + lead + 3]:
                    want = (z[j] @ coef) @ v + trend[j + lead + 3]
                    assert [got[lo, lead, int(j + lead + 3), k] for k in c] == pytest.approx(want.tolist(), abs=1e-8)
                    seen += len(c)
    assert seen == len([r for r in out if r.m < START + 144])
    # months of a decade, changed, change no model that forecasts them
    lost = frame(spark, np.where(((months // 12 >= 1962) & (months // 12 < 1965))[:, None] & (t % 5 == 0)[:, None], 99.0, x))
    again = {(r.fold, r.lead, r.m - START, int(r.lon)): r.value for r in learners.field_hindcast(lost, (6,), k=2, ridge=0.5, edges=edges).collect()}
    clean = [k for k in again if k[0] == 1962 and (START + k[2] - 9) // 12 < 1962]
    assert clean and all(again[k] == pytest.approx(got[k], abs=1e-8) for k in clean)
