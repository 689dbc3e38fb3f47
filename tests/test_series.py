"""Parsers, windows, ranks and statistics against hand-computed results."""

import datetime as dt
import math

import numpy as np
import pytest
from conftest import months
from pyspark.sql import functions as F

from tropicast.functions import ranks, stats
from tropicast.functions.calendar import month_date, season_date
from tropicast.operators import lagged, prepare, windows
from tropicast.sources import text

M2000 = 2000 * 12


def series(spark, values, start=M2000, name="s"):
    df = spark.createDataFrame(months(start, values), "m int, value double")
    return df.select(F.lit(name).alias("series"), month_date("m").alias("time"), "m", "value")


def write_lines(tmp_path, body):
    path = tmp_path / "table.txt"
    path.write_text(body)
    return str(path)


def test_season_table(spark, tmp_path):
    body = "SEAS   YR  TOTAL  ANOM\n DJF  1950  24.72 -1.53\n JFM  1950  25.17 -1.34\n NDJ  1950  25.0  -0.5\n"
    table = text.season_index(text.read_lines(spark, write_lines(tmp_path, body)))
    rows = {str(r.time): r.value for r in prepare.prep_season_index(table).collect()}
    assert rows == {"1950-02-01": -1.53, "1950-03-01": -1.34, "1951-01-01": -0.5}


def test_unknown_index_combination(spark):
    with pytest.raises(ValueError):
        text.index_source(None, "3", "S", False)
    with pytest.raises(ValueError):
        text.index_source(None, "3.4", "S", True)


def test_volume_table_skips_header(spark, tmp_path):
    body = "Warm water\nline two\nline three\nunits\ndate Volume Anomaly\n198001  2.605404e+15  7.657363e+13\n198002 2.564434e+15 7.004931e+13\n"
    rows = prepare.prep_volume(text.volume_table(text.read_lines(spark, write_lines(tmp_path, body)))).orderBy("m").collect()
    assert [(str(r.time), r.value) for r in rows] == [("1980-01-01", 7.657363e13), ("1980-02-01", 7.004931e13)]


def test_year_table_sentinel(spark, tmp_path):
    values = ["-0.1"] * 11 + ["-999"]
    body = " 1870 2018\n 1870 " + " ".join(values) + "\n -999\n dipole mode\n"
    rows = prepare.prep_year_table(text.year_table(text.read_lines(spark, write_lines(tmp_path, body)))).collect()
    assert len(rows) == 12 and sum(r.value is None for r in rows) == 1


def test_splice(spark):
    old = series(spark, [2.0], 1979 * 12 + 11)
    new = series(spark, [7.0e13], 1980 * 12)
    got = {str(r.time): r.value for r in prepare.splice(old, new).collect()}
    assert got == {"1979-12-01": 2.0e13, "1980-01-01": 7.0e13}


REPORT = """Forecast issued Apr 2002
  50  60  70-999-999  10  20  30  40    NASA GMAO   
 -10 -20 abc  40  50  60  70  80  90    UBC/NNET    
end
  55  65  75  85  95   5  15  25  35    NASA GMAO   
end
"""


def test_report(spark, tmp_path):
    lines = text.read_lines(spark, write_lines(tmp_path, REPORT))
    got = {(r.model, str(r.target_season), r.lead): r.mean for r in prepare.prep_report(lines).collect()}
    assert got[("NASA GMAO", "2002-04-01", 0)] == 0.50
    assert got[("NASA GMAO", "2002-06-01", 2)] == 0.70
    assert got[("NASA GMAO", "2002-07-01", 3)] is None
    assert got[("NASA GMAO", "2002-09-01", 5)] == 0.10
    assert got[("NASA GMAO", "2002-05-01", 0)] == 0.55
    assert {k: v for k, v in got.items() if k[0] == "UBC NNET"} == {
        ("UBC NNET", "2002-04-01", 0): -0.10, ("UBC NNET", "2002-05-01", 1): -0.20}
    assert str(prepare.report_axis_end(lines).first()[0]) == "2003-02-01"


def test_line_numbers_across_splits(spark):
    lines = spark.createDataFrame(
        [("f", s, p, "end" if p == 1 else "x") for s in (0, 100, 200) for p in range(3)],
        "file string, split long, pos long, value string")
    rows = text.number_lines(lines, F.col("value") == "end", "block").orderBy("split", "pos").collect()
    assert [r.block for r in rows] == [0, 0, 1, 1, 1, 2, 2, 2, 3]


def test_warm_pool_edge(spark):
    row = [30.0, 29.5, 28.6, 27.9, 27.0]
    field = spark.createDataFrame([(M2000, 0.0, 120.0 + 2.5 * i, v) for i, v in enumerate(row)], "m int, lat double, lon double, value double")
    field = field.withColumn("time", month_date("m"))
    got = prepare.warm_pool_edge(field).first()
    assert got.cell == 2 and got.value == pytest.approx(406.32165)
    cold = prepare.warm_pool_edge(field.withColumn("value", F.lit(20.0))).first()
    assert cold.cell is None and cold.value is None


def test_wind_stress(spark):
    cell = spark.createDataFrame([(M2000, 0.0, 120.0)], "m int, lat double, lon double").withColumn("time", month_date("m"))
    got = prepare.wind_stress(cell.withColumn("value", F.lit(3.0)), cell.withColumn("value", F.lit(-4.0))).first()
    assert (got.wspd, got.taux, got.tauy) == (5.0, 15.0, -20.0)


def test_rolling_mean(spark):
    got = windows.rolling_mean(series(spark, [1.0, 2.0, 3.0, 4.0]), 3, ("series",)).orderBy("m").collect()
    assert [r.value for r in got] == [None, None, 2.0, 3.0]


def test_lag_embedding(spark):
    rows = windows.lag_embedding(series(spark, [float(i) for i in range(1, 9)]), ["value"], 2, 2).orderBy("m").collect()
    assert [tuple(r.x) for r in rows] == [(5, 3), (6, 4), (7, 5), (8, 6)]


def test_labels(spark):
    got = windows.labels(series(spark, [float(i) for i in range(1, 31)]), [3]).orderBy("m").collect()
    assert len(got) == 24 and (got[0].y, got[0].y_persistence) == (7.0, 1.0)


def test_gradient(spark):
    got = windows.gradient(series(spark, [1.0, 2.0, 4.0, 8.0]), ("series",)).orderBy("m").collect()
    assert [r.value for r in got] == [1.0, 1.5, 3.0, 4.0]


def test_evolving_windows(spark):
    got = windows.evolving_windows(series(spark, [float(i) for i in range(14)]), 12)
    counts = {str(r.window_end): r["count"] for r in got.groupBy("window_end").count().collect()}
    assert counts == {"2000-12-01": 12, "2001-01-01": 12, "2001-02-01": 12}


def test_upsample(spark):
    df = spark.createDataFrame([("a", dt.date(1955, 2, 1), 0.0), ("a", dt.date(1955, 5, 1), 89.0)], "series string, time date, value double")
    got = {str(r.time): r.value for r in windows.upsample(df, ("series",)).collect()}
    assert got == pytest.approx({"1955-02-01": 0.0, "1955-03-01": 28.0, "1955-04-01": 59.0, "1955-05-01": 89.0})


def test_episodes(spark):
    df = series(spark, [0.1, 0.6, 0.9, 0.2, -0.7, -0.5, 0.0, 0.8])
    got = [(str(r.start), str(r.end), r.peak, r.sign, round(r.intensity, 6)) for r in windows.episodes(df).orderBy("start").collect()]
    assert got == [("2000-02-01", "2000-03-01", 0.9, 1, 0.5), ("2000-05-01", "2000-06-01", 0.7, -1, 0.25),
                   ("2000-08-01", "2000-08-01", 0.8, 1, 0.375)]
    assert windows.episodes(df, drop_open=True).count() == 2
    flip = series(spark, [0.9, -0.9])
    assert windows.episodes(flip).count() == 2 and windows.episodes(flip, split_on_sign=False).count() == 1


def test_categories(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([3, 1, 2, 6, 5, 4])], "i int, x double")
    got = ranks.quantile_categories(df, "x", 3).orderBy("i").collect()
    assert [r.category for r in got] == [0, 0, 0, 2, 1, 1]
    t = spark.createDataFrame([(0.6,), (0.5,), (-0.5,), (-0.6,)], "x double").select(ranks.threshold_category("x", 0.5).alias("c"))
    assert [r.c for r in t.collect()] == [2, 1, 1, 0]


@pytest.mark.parametrize("kind", ["spread", "hot", "ties", "few", "none"])
def test_categories_by_brute_force(spark, kind):
    rng = np.random.default_rng(4)
    values = {"spread": rng.normal(size=4000), "hot": np.concatenate([np.full(2500, 0.5), rng.random(1500)]), "ties": np.full(300, 2.0),
              "few": np.array([3.0, 1.0]), "none": np.array([])}[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "x double").repartition(6)
    ordered = np.sort(values)
    cuts = [ordered[i * (len(values) // 5)] for i in range(1, 5)] if len(values) else []
    got = ranks.quantile_categories(df, "x", 5).where("x IS NOT NULL").collect()
    assert len(got) == len(values) and all(r.category == sum(c < r.x for c in cuts) for r in got)


def test_cumulative_counts_with_a_hot_value(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(500, 3.0), rng.integers(0, 400, 1000) / 10.0])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    for row in ranks.cumulative_counts(df, "x", buckets=8).collect():
        assert row.n == (values == row.x).sum() and row.below == (values < row.x).sum()


def test_scale_max(spark):
    got = stats.scale_max(series(spark, [1.0, -4.0, 2.0]), "value", ["series"]).orderBy("m").collect()
    assert [r.value for r in got] == [0.25, -1.0, 0.5]


@pytest.mark.parametrize("t, df", [(12.706, 1), (4.303, 2), (3.182, 3), (2.776, 4), (2.571, 5), (2.228, 10), (1.984, 100)])
def test_correlation_p(spark, t, df):
    r = t / math.sqrt(df + t * t)
    row = spark.range(1).select(stats.correlation_p(F.lit(r), F.lit(df + 2)).alias("p")).first()
    assert row.p == pytest.approx(0.05, abs=6e-5)


def test_undefined_correlation_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    row = lagged.correlate(df, "x", "y").first()
    assert row.r is None and row.p is None and row.n == 2


def test_normal_cdf(spark):
    row = spark.range(1).select(*[stats.normal_cdf(F.lit(z)).alias(str(i)) for i, z in enumerate((-1.959964, 0.0, 1.0))]).first()
    assert list(row) == pytest.approx([0.025, 0.5, 0.8413447], abs=1e-6)


def test_two_predictor_map(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=60), rng.normal(size=60)
    y = 1.5 * a - 0.5 * b + rng.normal(size=60)
    df = spark.createDataFrame([(0.0, 120.0, float(p), float(q), float(v)) for p, q, v in zip(a, b, y)],
                               "lat double, lon double, a double, b double, value double")
    got = lagged.regression_map2(df, "a", "b").first()
    x = np.column_stack([a, b])
    c = np.linalg.lstsq(x, y, rcond=None)[0]
    fit = x @ c
    assert got.coef1 == pytest.approx(c[0] * a.std()) and got.coef2 == pytest.approx(c[1] * b.std())
    assert got.r2 == pytest.approx(1 - ((y - fit) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got.r == pytest.approx(np.corrcoef(fit, y)[0, 1])


def test_season_carry(spark):
    row = spark.createDataFrame([("NDJ", 1950)], "s string, y int").select(season_date("s", "y").alias("t")).first()
    assert str(row.t) == "1951-01-01"


@pytest.mark.parametrize("n", [4001, 4002, 10 ** 6, 3 * 10 ** 9])
def test_correlation_p_of_many_pairs(spark, n):
    """One method for every number of pairs: Cornish-Fisher against the normal to the third order."""
    import math

    for t in (0.5, 2.04, 4.0):
        v = n - 2
        z = t * (1 - (t * t + 1) / (4 * v) + (13 * t ** 4 + 8 * t * t + 3) / (96 * v * v)
                 - (35 * t ** 6 + 19 * t ** 4 + t * t - 15) / (384 * v ** 3))
        want = math.erfc(z / math.sqrt(2))
        r = t / math.sqrt(v + t * t)
        got = spark.range(1).select(stats.correlation_p(F.lit(r), F.lit(n)).alias("p")).first().p
        assert math.isclose(got, want, rel_tol=1e-8)


def test_correlation_p_at_the_edges(spark):
    rows = spark.sql("SELECT * FROM VALUES (1e0, 5), (-1e0, 3), (0e0, 10), (0.5e0, 2), (NULL, 9), (0.5e0, 3) AS t(r, n)")
    got = [x.p for x in rows.select(stats.correlation_p("r", "n").alias("p")).collect()]
    assert got[:2] == [0.0, 0.0] and abs(got[2] - 1) < 1e-12 and got[3] is None and got[4] is None and abs(got[5] - 2 / 3) < 1e-9
