import numpy as np
from pyspark.sql import functions as F

from freshness.operators import seasonal as Z
from freshness.operators.ordered import width_slice


def series(n=240, period=12, seed=0):
    t = np.arange(n)
    rng = np.random.default_rng(seed)
    return 10 + 0.05 * t + 4 * np.sin(2 * np.pi * t / period) + rng.normal(0, 0.2, n)


def test_forecast_beats_the_last_value():
    x = series()
    for at in (120, 150, 200):
        ahead = Z.forecast(x[None, at - 96 : at], 12, 12)[0]
        assert np.abs(ahead - x[at : at + 12]).mean() < 0.5 * np.abs(x[at - 1] - x[at : at + 12]).mean()


def test_decomposition_finds_season_and_trend():
    x = series(96)
    trend, season = Z.decompose(x[None, :], 12)
    t = np.arange(96)
    np.testing.assert_allclose(season[0], 4 * np.sin(2 * np.pi * t / 12), atol=0.6)
    np.testing.assert_allclose(trend[0][10:-10], (10 + 0.05 * t)[10:-10], atol=0.6)


def test_repairs_equal_the_loop(spark):
    rng = np.random.default_rng(4)
    rows, size = [], 24
    want = {}
    for key in (1, 2):
        x = series(200, 6, key)
        bad = rng.random(200) < (0.03 if key == 1 else 0.2)
        x = np.where(bad, x + 50, x)
        rows += [(key, i, float(v), bool(b)) for i, (v, b) in enumerate(zip(x, bad))]
        fixed = x.copy()
        for i in np.flatnonzero(bad):
            if i >= size:
                fixed[i] = Z.forecast(fixed[None, i - size : i], 6, 1)[0, 0]
        want[key] = fixed
    table = spark.createDataFrame(rows, "key LONG, t LONG, value DOUBLE, bad BOOLEAN")
    out = Z.repair_anomalies(table, "key", "t", "value", "bad", size, 6, width_slice("t", 37)).toPandas()
    assert len(out) == 400
    for key, g in out.groupby("key"):
        np.testing.assert_allclose(g.sort_values("t")["repaired"], want[key])


def test_error_forecast_rows(spark):
    rows = [(k, i, float((i * 7 + k) % 5)) for k in (1, 2) for i in range(20)]
    table = spark.createDataFrame(rows, "key LONG, t LONG, error DOUBLE")
    out = Z.error_forecast(table, "key", "t", "error", 5, 1, width_slice("t", 6)).toPandas()
    assert len(out) == 2 * (20 - 5 - 1)
    for r in out.itertuples():
        e = [(i * 7 + r.key) % 5 for i in range(20)]
        assert r.actual == e[r.end_rn - 1 + 2]
        assert abs(r.baseline - np.mean(e[r.end_rn - 5 : r.end_rn])) < 1e-9


def test_extended_series_repeats_its_pattern(spark):
    base = [(1, i + 1, 1.0 + i, [0.0, 2.0, -2.0][i % 3], 0.0) for i in range(10)]
    table = spark.createDataFrame(base, "key LONG, rn LONG, trend DOUBLE, season DOUBLE, noise DOUBLE")
    out = Z.extend_series(table, "key", "rn", "trend", "season", "noise", 30, 3, 0.0, 1).toPandas().sort_values("rn")
    assert out["rn"].tolist() == list(range(1, 31))
    trend, last, count, want = [1.0 + i for i in range(10)], 10.0, 0, []
    made = []
    for _ in range(20):
        if count >= 9:
            count, last = 0, made[-1]
        made.append(last + trend[count] - trend[0])
        want.append([0.0, 2.0, -2.0][count % 3])
        count += 1
    np.testing.assert_allclose(out["trend"].to_numpy()[10:], made)
    np.testing.assert_allclose(out["season"].to_numpy()[10:], want)


def test_one_row_series_has_no_features(spark):
    table = spark.createDataFrame([(1, 0, 3.0)], "key LONG, t LONG, value DOUBLE")
    assert Z.rolling_seasonal(table, "key", "t", "value", 24, 6, width_slice("t", 10)).count() == 0
    assert Z.seasonal_means(table, "key", "t", "value", 6, width_slice("t", 10)).where(F.col("season").isNotNull()).count() == 0
