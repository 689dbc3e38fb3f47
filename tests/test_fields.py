"""Regions, climatology, regridding, patterns and the store."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tropicast.functions.calendar import month_date
from tropicast.operators import climatology, eof, regions, regrid
from tropicast.sources.store import Store

M2000 = 2000 * 12
CELLS = "m int, lat double, lon double, value double"


def field(spark, rows):
    return spark.createDataFrame(rows, CELLS).withColumn("time", month_date("m"))


def test_mean_of_means(spark):
    df = field(spark, [(M2000, -2.5, 120.0, 1.0), (M2000, 0.0, 120.0, 3.0), (M2000, -2.5, 140.0, None), (M2000, 0.0, 140.0, 6.0)])
    assert regions.box_mean(df, (-5, 5), (120, 140)).first().value == 4.0


def test_anomalies_vanish_over_the_reference(spark):
    rng = np.random.default_rng(3)
    rows = [(M2000 + t, 0.0, 120.0 + 20 * c, float(rng.normal())) for t in range(48) for c in range(3)]
    df = field(spark, rows)
    clim = climatology.climatology(df, "month", ("2000-01-01", "2003-12-31"))
    anom = climatology.anomaly(df, clim)
    worst = anom.groupBy("lat", "lon", F.month("time")).agg(F.avg("value").alias("a")).agg(F.max(F.abs("a"))).first()[0]
    assert worst < 1e-12
    assert climatology.detect_period(df) == "month"


def test_uneven_times_have_no_period(spark):
    with pytest.raises(ValueError):
        climatology.detect_period(field(spark, [(M2000, 0.0, 0.0, 1.0), (M2000 + 7, 0.0, 0.0, 1.0)]))


def test_regrid_is_exact_on_bilinear_functions(spark):
    rows = [(M2000, float(la), float(lo), la + 2.0 * lo) for la in range(-4, 5, 2) for lo in range(100, 121, 2)]
    out = regrid.regrid(field(spark, rows)).collect()
    assert len(out) == 3 * 9
    assert all(r.value == pytest.approx(r.lat + 2 * r.lon) for r in out)


def test_regrid_null_where_a_source_is_missing(spark):
    rows = [(M2000, float(la), float(lo), None if (la, lo) == (0, 102) else 1.0) for la in (0, 2) for lo in (100, 102, 104)]
    out = {(r.lat, r.lon): r.value for r in regrid.regrid(field(spark, rows), (0.0, 2.0, 1.0), (100.0, 104.0, 1.0)).collect()}
    assert out[(0.0, 100.0)] == 1.0 and out[(0.0, 101.0)] is None and out[(2.0, 101.0)] == 1.0 and out[(1.0, 103.0)] is None


def test_regrid_across_the_date_line(spark):
    rows = [(M2000, 0.0, float(lo), float(lo == 0)) for lo in range(0, 360, 90)]
    out = {r.lon: r.value for r in regrid.regrid(field(spark, rows), (0.0, 0.0, 1.0), (0.0, 350.0, 45.0), periodic=True).collect()}
    assert out[315.0] == pytest.approx(0.5) and out[45.0] == pytest.approx(0.5)


def test_detrend(spark):
    df = field(spark, [(M2000 + i, 0.0, 0.0, v) for i, v in enumerate((1.0, 2.0, 4.0))])
    got = [r.value for r in eof.detrended(df).orderBy("m").collect()]
    assert got == pytest.approx([1 / 6, -1 / 3, 1 / 6])


def test_patterns_equal_a_dense_decomposition(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 12)) @ np.diag(np.linspace(1, 4, 12))
    x[7, 3] = np.nan
    rows = [(M2000 + t, 0.0, float(c), None if np.isnan(x[t, c]) else float(x[t, c])) for t in range(30) for c in range(12)]
    df = field(spark, rows)
    fitted = eof.fit(eof.detrended(df), 3)
    d = np.nan_to_num(x)
    t = np.arange(30)
    d = d - np.column_stack([np.polyval(np.polyfit(t, d[:, c], 1), t) for c in range(12)])
    u, s, vt = np.linalg.svd(d - d.mean(0), full_matrices=False)
    got = {(r["mode"], int(r.lon)): r.loading for r in fitted.patterns.collect()}
    for k in range(3):
        v = vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert [got[(k + 1, c)] for c in range(12)] == pytest.approx(list(v), abs=1e-8)
    assert fitted.explained == pytest.approx(list((s ** 2 / (s ** 2).sum())[:3]))
    pc = {(r["mode"], r.m - M2000): r.value for r in fitted.project().collect()}
    v0 = vt[0] * np.sign(vt[0][np.abs(vt[0]).argmax()])
    assert [pc[(1, i)] for i in range(30)] == pytest.approx(list(d @ v0), abs=1e-8)
    gap = df.withColumn("value", F.when(~((F.col("m") == M2000 + 29) & (F.col("lon") == 2.0)), F.col("value")))
    assert {int(r.lon): r.loading for r in eof.pattern_map(fitted, gap).collect()}[2] is None


def _dense_field(spark, n, c, seed):
    """``cell, m, value`` of a few growing sines plus hashed noise, and the same as an array."""
    df = spark.range(n * c).select(F.lit(0.0).alias("lat"), (F.col("id") % c).cast("double").alias("lon"), (F.col("id") / c).cast("int").alias("m"))
    wave = sum((9 - 2 * j) * F.sin(F.col("m") * (0.11 + 0.07 * j)) * F.cos(F.col("lon") * (0.3 + 0.2 * j)) for j in range(4))
    noise = F.hash("lon", "m", F.lit(seed)) / 2.0 ** 31
    df = df.withColumn("value", wave + noise)
    x = np.zeros((n, c))
    for row in df.collect():
        x[row.m, int(row.lon)] = row.value
    return df, x - x.mean(0)


@pytest.mark.parametrize(("n", "c"), [(20_000, 6), (90, 150)])
def test_patterns_of_many_times_and_of_many_cells(spark, n, c):
    df, x = _dense_field(spark, n, c, 3)
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    fitted = eof.fit(df, 3)
    got = {(r["mode"], int(r.lon)): r.loading for r in fitted.patterns.collect()}
    for k in range(3):
        v = vt[k] * np.sign(vt[k][np.abs(vt[k]).argmax()])
        assert [got[(k + 1, j)] for j in range(c)] == pytest.approx(list(v), abs=1e-6)
    assert fitted.explained == pytest.approx(list((s ** 2 / (s ** 2).sum())[:3]))


def test_patterns_beyond_the_rank_and_of_nothing(spark):
    df = field(spark, [(M2000 + t, 0.0, float(c), float(t * c)) for t in range(4) for c in range(2)])
    fitted = eof.fit(df, 3)
    assert fitted.explained == pytest.approx([1.0, 0.0, 0.0])
    assert {r["mode"]: 0 for r in fitted.patterns.where("loading <> 0").collect()} == {1: 0}
    empty = eof.fit(df.where("false"), 2)
    assert empty.patterns.count() == 0 and empty.explained == [None, None]


def test_store_prunes_and_pushes_down(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), start="2000-02", end="2000-03", lat=(-5, 5), lon=(110, 130))
    df = field(spark, [(M2000 + t, la, 120.0, float(t)) for t in range(6) for la in (-10.0, 0.0)])
    assert store.write_field(df, "sst", "A") and not store.write_field(df, "sst", "A")
    store.write_field(df, "olr", "B")
    read = store.read_field("sst", "A")
    assert sorted(r.m - M2000 for r in read.collect()) == [1, 2]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "GreaterThanOrEqual(lat" in plan and "PartitionFilters: [" in plan


def test_store_reads_in_any_order_and_only_inside_the_data(spark, tmp_path):
    df = field(spark, [(M2000 + t, la, 120.0, float(t)) for t in range(6) for la in (-10.0, 0.0)])
    Store(spark, str(tmp_path / "s")).write_field(df, "sst", "A")
    there = {"start": "2000-02", "end": "2000-03"}
    assert Store(spark, str(tmp_path / "s"), lat=(5, -5), lon=(130, 110), **there).read_field("sst", "A").count() == 2
    late = Store(spark, str(tmp_path / "s"), start="2000-02", end="2100-01")
    with pytest.raises(ValueError):
        late.read_field("sst", "A")
    assert late.read_field("sst", "A", check=False).count() == 10


def test_forecasts_keep_the_outputs_of_their_model(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    day = "date'2000-01-01' AS target_season, 3 AS lead"
    for model, outputs in (("dem", "1e0 AS mean, 2e0 AS std"), ("qnn", "3e0 AS quantile5, 4e0 AS quantile95"), ("UBC/NN", "5e0 AS mean")):
        store.write_forecast(spark.sql(f"SELECT {day}, {outputs}"), model)
    assert store.read_forecasts("dem", 3).first().asDict() | {"target_season": 0} == {
        "target_season": 0, "lead": 3, "mean": 1.0, "std": 2.0, "model": "dem"}
    assert store.read_forecasts("qnn", 3).first()["quantile95"] == 4.0
    assert store.read_forecasts("UBC/NN", 3).first()["mean"] == 5.0


def test_store_bounds(spark, tmp_path):
    df = field(spark, [(M2000, 0.0, 0.0, 1.0), (M2000 + 5, 0.0, 0.0, 1.0)])
    Store(spark, str(tmp_path), start="2000-01", end="2000-06").check_bounds(df)
    for bad in ({"start": "1999-12"}, {"end": "2000-07"}):
        with pytest.raises(ValueError):
            Store(spark, str(tmp_path), **bad).check_bounds(df)


def test_climatology_is_kept_per_reference(spark, tmp_path):
    store = Store(spark, str(tmp_path / "c"))
    df = field(spark, [(M2000 + t, 0.0, 120.0, float(t)) for t in range(24)])

    def compute(rows, reference):
        return climatology.climatology(rows, "month", reference)

    first = store.climatology(df, "sst", "A", compute, ("2000-01-01", "2000-12-31"))
    whole = store.climatology(df, "sst", "A", compute, None)
    assert first.where("period_key = 1").first()["mean"] == 0.0 and whole.where("period_key = 1").first()["mean"] == 6.0
    # names whose folders Spark escapes are found again
    for name in ("sst:daily", "a=b", "50%"):
        odd = store.climatology(df.withColumn("value", df["value"] + len(name)), name, "A:1", compute, None)
        assert odd.where("period_key = 1").first()["mean"] == 6.0 + len(name)
        kept = store.climatology(df, name, "A:1", compute, None)
        assert kept.where("period_key = 1").first()["mean"] == 6.0 + len(name)


def test_composite_crosses_the_year(spark):
    df = field(spark, [(M2000 + t, 0.0, 120.0, float(t)) for t in range(24)])
    events = spark.createDataFrame([("warm", 2000)], "kind string, year int")
    got = regions.composite(df, events, {0: (12,), 1: (1, 2)}).first()
    assert got.value == pytest.approx((11 + 12 + 13) / 3)
