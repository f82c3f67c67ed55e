"""Statistics and spectra: closed-form and brute-force expectations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.operators import spectrum, stats
from contrail.operators.series import open_series

K, O = ["k"], ["t", "s"]


def series_df(spark, **by_key):
    rows = [(k, int(t), i, float(v)) for k, (ts, vs) in by_key.items() for i, (t, v) in enumerate(zip(ts, vs))]
    return spark.createDataFrame(rows, "k string, t long, s long, v double").repartition(5)


@pytest.mark.parametrize("limit", [None, 150])
def test_rolling_zscore(spark, limit):
    rng = np.random.default_rng(3)
    t = np.arange(0, 10_000, 10)
    spike = np.full(1000, 5.0)
    spike[500] = 50.0
    noise = rng.normal(0, 1, 1000)
    noise[rng.integers(0, 1000, 12)] += 9
    df = series_df(spark, flat=(t, np.full(1000, 5.0)), spike=(t, spike), noise=(t, noise), short=(range(5), [1, 2, 100, 1, 1]))
    got = stats.rolling_zscore(open_series(df, K, O, limit), "v", 20, 3.0).collect()

    def brute(v, w=20, thr=3.0):
        k = np.ones(w) / w
        m = np.convolve(v, k, "same")
        z = np.abs(v - m) / np.maximum(np.sqrt(np.convolve((v - m) ** 2, k, "same")), 1e-10)
        f = z > thr
        return [int(t[i]) for i in range(len(v)) if f[i] and not (i and f[i - 1])]

    assert {r.k for r in got} == {"spike", "noise"} - ({"noise"} if not brute(noise) else set())
    for name, v in (("spike", spike), ("noise", noise)):
        assert sorted(r.t for r in got if r.k == name) == brute(v)


@pytest.mark.parametrize("limit", [None, 60])
def test_change_points(spark, limit):
    t = np.arange(0, 100_000, 1000)
    rng = np.random.default_rng(5)
    df = series_df(
        spark, flat=(t, np.full(100, 2.0)), step=(t, np.r_[np.full(50, 1.0), np.full(50, 10.0)]), short=([0, 1, 2], [1, 2, 3]),
        calm=(t, rng.normal(0, 1, 100)), wide=(np.arange(200) * 1000, np.r_[rng.normal(0, 0.1, 100), rng.normal(0, 5, 100)]),
    )
    got = {}
    for r in stats.change_points(open_series(df, K, O, limit), "v", 10, 5.0).collect():
        got.setdefault(r.k, []).append(r.t)
    assert got["step"] == [49_000]
    assert any(90_000 <= x <= 110_000 for x in got["wide"])
    assert set(got) <= {"step", "wide", "calm"} and len(got.get("calm", [])) <= 1


@pytest.mark.parametrize("limit,block", [(None, 16_384), (120, 64)])
def test_cross_correlation(spark, limit, block):
    rng = np.random.default_rng(1)
    a = rng.normal(0, 1, 400)
    b = np.r_[rng.normal(0, 1, 5), a[:-5]]
    rows = [("x", i, i, float(p), float(q)) for i, (p, q) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "k string, t long, s long, a double, b double").repartition(4)
    r = stats.cross_correlation_lag(df, K, O, "a", "b", 20, 10.0, block, limit).first()
    za, zb = (a - a.mean()) / (a.std() + 1e-10), (b - b.mean()) / (b.std() + 1e-10)
    full, lags = np.correlate(za, zb, "full"), np.arange(-399, 400)
    m = np.abs(lags) <= 20
    best = int(np.argmax(full[m]))
    assert r.lag_samples == lags[m][best] and r.peak_correlation == pytest.approx(full[m][best] / 400)
    assert r.lag_seconds == pytest.approx(r.lag_samples / 10) and r.is_significant


@pytest.mark.parametrize("n,max_lag", [(1, 0), (1, 5), (7, 3), (64, 64), (100, 20), (30, 200), (4097, 1500)])
def test_lag_sums_match_direct_sums(n, max_lag):
    rng = np.random.default_rng(n)
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    want = [sum(a[i + k] * b[i] for i in range(max(0, -k), min(n, n - k))) for k in range(-max_lag, max_lag + 1)]
    assert stats._lag_sums(a, b, max_lag) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("limit,block", [(None, 16_384), (900, 256)])
def test_long_lags_and_equal_peaks(spark, limit, block):
    """A shift of 700 rows is found across blocks; of a period's equal peaks the smallest lag is given."""
    rng = np.random.default_rng(5)
    noise = rng.normal(0, 1, 3000)
    wave = np.tile([1.0, -1.0, 0.5, -0.5], 50)
    shifted = np.r_[rng.normal(0, 1, 700), noise[:-700]]
    data = [("far", i, i, float(p), float(q)) for i, (p, q) in enumerate(zip(noise, shifted))]
    data += [("wave", i, i, float(p), float(p) * (50 <= i < 150)) for i, p in enumerate(wave)]
    df = spark.createDataFrame(data, "k string, t long, s long, a double, b double").repartition(5)
    got = {r.k: r.lag_samples for r in stats.cross_correlation_lag(df, K, O, "a", "b", 1000, 1.0, block, limit).collect()}
    assert got == {"far": -700, "wave": -48}


def test_isolation_forest(spark):
    rows = [("f", i * 1000, i, 0.0, 0.0) for i in range(190)] + [("f", i * 1000, i, 100.0, 100.0) for i in range(190, 200)]
    rng = np.random.default_rng(42)
    rows += [("g", i, i, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (200, 2)))]
    rows += [("tiny", i, i, 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, t long, s long, x double, y double")
    whole = {(r.k, r.t): r.score for r in stats.isolation_scores(df, K, ["x", "y"], O, 50).collect()}
    split = {(r.k, r.t): r.score for r in stats.isolation_scores(df.repartition(3), K, ["x", "y"], O, 50, chunk_rows=30, forest_keys=0).collect()}
    assert whole.keys() == split.keys() and all(whole[k] == pytest.approx(split[k]) for k in whole)
    assert max(whole[("f", t * 1000)] for t in range(190, 200)) < min(whole[("f", t * 1000)] for t in range(190))
    assert not [k for k in whole if k[0] == "tiny"]
    found = stats.isolation_anomalies(df, K, ["x", "y"], O, contamination=0.1, n_trees=50).collect()
    assert len([r for r in found if r.k == "g"]) < 30
    assert stats.isolation_scores(df, K, ["x", "nope"], O).count() == 0
    assert stats.isolation_anomalies(df, K, ["x", "nope"], O).count() == 0


def test_isolation_groups_tell_the_middle_and_the_first_values(spark):
    rng = np.random.default_rng(8)
    rows = [("k", i * 10, i, float(a), float(b), 7) for i, (a, b) in enumerate(rng.normal(0, 1, (400, 2)))]
    for n, i in enumerate((100, 101, 103, 108, 200)):
        rows[i] = ("k", i * 10, i, 50.0 + n, -40.0 - n, 7)
    df = spark.createDataFrame(rows, "k string, t long, s long, x double, y double, score int").drop("score").repartition(5)
    for limit in (None, 50):
        got = stats.isolation_anomalies(df, K, ["x", "y"], O, contamination=5 / 400, n_trees=60, max_rows=limit).orderBy("start").collect()
        assert [(r.start, r.end, r.middle, r.n) for r in got] == [(1000, 1080, 1030, 4), (2000, 2000, 2000, 1)]
        assert got[0]["features"] == {"x": 50.0, "y": -40.0} and got[0].severity == "CRITICAL"


def test_each_tree_draws_from_all_rows(spark, monkeypatch):
    """Trees of a key of many rows: each has its own sample of 256, and the cuts reach all parts of the key."""
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").alias("t"), (F.col("id") * 1.0).alias("x"), F.rand(1).alias("y"))
    sizes = df.groupBy("k").agg(F.count(F.lit(1)).alias("_n"))
    trees = stats._forest(df, sizes, ["k"], ["x", "y"], ["t"], 40, 1).collect()
    assert sorted(r["tree"] for r in trees) == list(range(40)) and {r["size"] for r in trees} == {256}
    cuts = [c for r in trees for f, c in zip(r["feature"], r["cut"]) if f == 0]
    assert min(cuts) < 1000 and max(cuts) > 19_000 and len(set(map(tuple, (r["cut"] for r in trees)))) == 40


def sine(spark, amp, hz=80.0, rate=400, n=2048, key="k1"):
    t = np.arange(n) / rate
    z = 9.81 + amp * np.sin(2 * np.pi * hz * t)
    rows = [(key, int(i * 1e6 / rate), i, float(0.1 * np.sin(2 * np.pi * hz * x)), 0.0, float(v)) for i, (x, v) in enumerate(zip(t, z))]
    return spark.createDataFrame(rows, "k string, t long, s long, x double, y double, z double")


AXES = {"X": "x", "Y": "y", "Z": "z"}


@pytest.mark.parametrize("limit", [None, 500])
def test_welch_matches_direct_computation(spark, limit):
    rng = np.random.default_rng(9)
    v = rng.normal(0, 2, 2048) + 5 * np.sin(2 * np.pi * 50 * np.arange(2048) / 400)
    df = series_df(spark, a=(np.arange(2048) * 2500, v))
    got = sorted((r.bin, r.hz, r.psd) for r in spectrum.welch(df, K, O, {"A": "v"}, max_rows=limit).collect())
    n, hop, win = 512, 256, 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(512) / 512)
    segs = [v[i : i + n] for i in range(0, 2048 - n + 1, hop)]
    p = np.mean([np.abs(np.fft.rfft((s - s.mean()) * win)) ** 2 for s in segs], axis=0) / (400 * (win**2).sum())
    p[1:-1] *= 2
    assert len(got) == 257
    assert np.allclose([x[2] for x in got], p)
    assert np.allclose([x[1] for x in got], np.arange(257) * 400 / 512)
    # power integrates to the variance
    assert sum(x[2] for x in got) * 400 / 512 == pytest.approx(v.var(), rel=0.05)


def test_vibration_report(spark):
    quiet = spectrum.vibration_report(sine(spark, 0.5), K, O, AXES).first()
    assert quiet.overall_severity in ("GOOD", "ACCEPTABLE")
    assert quiet.motor_fundamental_hz == pytest.approx(80, abs=1)
    clips = spark.createDataFrame([("k1", 0, 1, 2, 3), ("k1", 9, 1, 2, 3)], "k string, t long, clip0 int, clip1 int, clip2 int")
    loud = spectrum.vibration_report(sine(spark, 25.0), K, O, AXES, clips).first()
    assert loud.overall_severity in ("WARNING", "CRITICAL") and loud.notch_filter_recommended
    assert loud.rms_z == pytest.approx(25 / np.sqrt(2), rel=1e-3) and loud.clips_z == 6
    assert loud.notch_frequencies_hz[0] == pytest.approx(80, abs=1)
    short = spectrum.vibration_report(sine(spark, 25.0), K, O, AXES, start_us=0, end_us=10_000).first()
    assert short.overall_severity == "GOOD"
    assert spectrum.vibration_report(sine(spark, 1.0).where("false"), K, O, AXES).count() == 0


def test_peak_rules():
    y = np.array([0, 10, 0, 9, 0, 0, 0, 3, 0, 20, 20, 0], dtype=float)
    assert list(spectrum._prominent_peaks(y, 1, 6)) == [1, 3, 9]
    assert list(spectrum._prominent_peaks(y, 3, 6)) == [1, 9]


def test_control_oscillation(spark):
    t = np.arange(600)
    df = series_df(spark, osc=(t * 20_000, 10 * np.sin(2 * np.pi * 5 * t / 50)), brief=(t[:50], t[:50]))
    assert [r.k for r in spectrum.control_oscillation(df, K, O, "v").collect()] == ["osc"]


def test_tree_depth_equals_row_by_row_descent():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (120, 3))
    tree = stats._grow_tree(x, rng)
    assert len(tree["feature"]) > 20

    def descend(row):
        node = 0
        while tree["feature"][node] >= 0:
            node = tree["left"][node] + int(row[tree["feature"][node]] > tree["cut"][node])
        return tree["path"][node]

    assert np.allclose(stats._tree_depth(stats._closed(tree), x, 7), [descend(r) for r in x])
    # expected path among n points: 2 H(n-1) - 2 (n-1) / n
    assert float(stats._mean_path(256)) == pytest.approx(2 * sum(1 / i for i in range(1, 256)) - 2 * 255 / 256, rel=1e-3)
