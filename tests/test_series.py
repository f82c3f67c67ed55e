"""Blocked and plain execution must agree, and both must match brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.operators import align, runs
from contrail.operators import spacing as spacing_steps
from contrail.operators.series import exact_quantile, open_series

PLAIN, SPLIT = 10**9, 40


@pytest.fixture(scope="module")
def samples():
    rng = random.Random(7)
    out = []
    for key, n in (("hot", 400), ("a", 25), ("b", 30)):
        t = 0
        for i in range(n):
            t += rng.choice([1, 2, 3, 5, 40])
            out.append((key, t, i, round(rng.uniform(0, 100), 2)))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def table(spark, samples):
    return spark.createDataFrame(samples, "k string, t long, s long, v double").repartition(6)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def by_key(samples):
    out = {}
    for k, t, s, v in sorted(samples):
        out.setdefault(k, []).append((t, s, v))
    return out


def test_long_series_is_cut(table):
    s = open_series(table, ["k"], ["t", "s"], SPLIT)
    assert s.split
    sizes = {(r.k, r["_blk"]): r["count"] for r in s.df.groupBy("k", "_blk").count().collect()}
    assert len([x for x in sizes if x[0] == "hot"]) > 5
    assert max(sizes.values()) <= SPLIT
    assert len([x for x in sizes if x[0] == "a"]) == 1


@pytest.mark.parametrize("limit", [PLAIN, SPLIT])
def test_number_shift_totals(table, samples, limit):
    s = open_series(table, ["k"], ["t", "s"], limit).number("rn")
    s = s.shift({"p": "v"}, {"x": "v"}).totals({"m": F.max("v")})
    got = rows(s.df.select("k", "t", "s", "v", "rn", F.coalesce("p", F.lit(-1.0)), F.coalesce("x", F.lit(-1.0)), "m"))
    want = []
    for k, seq in by_key(samples).items():
        m = max(v for _, _, v in seq)
        for i, (t, q, v) in enumerate(seq):
            want.append((k, t, q, v, i + 1, seq[i - 1][2] if i else -1.0, seq[i + 1][2] if i + 1 < len(seq) else -1.0, m))
    assert got == sorted(want)


def brute_groups(samples, thr, gap, dur):
    out = []
    for k, seq in by_key(samples).items():
        idx = [i for i, x in enumerate(seq) if x[2] > thr]
        grp = []
        for i in idx:
            if grp and i - grp[-1] > gap:
                out.append((k, grp))
                grp = []
            grp.append(i)
        if grp:
            out.append((k, grp))
    res = []
    for k, grp in out:
        seq = by_key(samples)[k]
        a, b = seq[grp[0]][0], seq[grp[-1]][0]
        if b - a >= dur:
            res.append((k, a, b, len(grp), max(seq[i][2] for i in grp), seq[grp[0]][2]))
    return sorted(res)


@pytest.mark.parametrize("limit", [PLAIN, SPLIT, 12])
@pytest.mark.parametrize("thr,gap,dur", [(20, 1, 5), (10, 1, 0), (80, 3, 0), (90, 5, 2), (-1, 1, 0)])
def test_violation_groups(table, samples, limit, thr, gap, dur):
    s = open_series(table, ["k"], ["t", "s"], limit)
    check = runs.Check("c", F.col("v") > thr, F.col("v"), dur, gap)
    other = runs.Check("d", F.col("v") > 50, F.col("v"), 0, 2)
    got = runs.violation_groups(s, [check, other]).where("check = 'c'")
    assert rows(got.select("k", "start", "end", "n", "v_max", "v_first")) == brute_groups(samples, thr, gap, dur)


@pytest.mark.parametrize("limit", [PLAIN, SPLIT, 12])
def test_spaced_events(table, samples, limit):
    s = open_series(table, ["k"], ["t", "s"], limit)
    want = []
    for k, seq in by_key(samples).items():
        last = -(10**9)
        for t, q, v in seq:
            if t - last > 17:
                want.append((k, t, q, v))
                last = t
    assert rows(runs.spaced_events(s, 17)) == sorted(want)


def test_entry_maps_chain_as_one():
    rng = random.Random(3)
    for case in range(200):
        times = np.cumsum([rng.choice([0, 0, 1, 1, 2, 30]) for _ in range(rng.randint(2, 60))])
        spacing, cut = rng.choice([0, 1, 4, 25, 500]), rng.randint(1, len(times) - 1)
        whole = spacing_steps.entry_map(times, spacing)
        joined = spacing_steps.chain(spacing_steps.entry_map(times[:cut], spacing), spacing_steps.entry_map(times[cut:], spacing))
        for entry in range(-600, int(times[-1]) + 5):
            last = entry
            for t in times:
                last = int(t) if t > last + spacing else last
            for bounds, exits in (whole, joined):
                at = np.searchsorted(bounds, entry, "right")
                assert (exits[at] if at < len(exits) else entry) == last, (case, entry)


@pytest.mark.parametrize("spacing", [0, 7, 150, 10**6])
@pytest.mark.parametrize("batch", ["7", "10000"])
def test_spaced_events_of_one_hot_island(spark, spacing, batch):
    """No gap is wider than the spacing; blocks and batches cut the island, also among equal times."""
    rng = random.Random(11)
    times = sorted(rng.randrange(2500) for _ in range(1500))
    df = spark.createDataFrame([("x", t, i, [t]) for i, t in enumerate(times)], "k string, t long, s long, extra array<long>").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = rows(runs.spaced_events(open_series(df, ["k"], ["t", "s"], 100), spacing).select("t", "s"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, last = [], None
    for i, t in enumerate(times):
        if last is None or t > last + spacing:
            want.append((t, i))
            last = t
    assert got == want


@pytest.mark.parametrize("limit", [PLAIN, SPLIT])
def test_rolling_and_thinning(table, samples, limit):
    import numpy as np

    s = open_series(table, ["k"], ["t", "s"], limit)
    got = {(r.k, r.t, r.s): r.m for r in runs.rolling_mean_padded(s, "v", 20, "m").df.collect()}
    thin = rows(runs.every_nth(s, 10).select("k", "t"))
    want_thin = []
    for k, seq in by_key(samples).items():
        m = np.convolve([x[2] for x in seq], np.ones(20) / 20, mode="same")
        assert len(seq) == len([g for g in got if g[0] == k])
        for (t, q, _), v in zip(seq, m):
            assert got[(k, t, q)] == pytest.approx(v)
        step = max(1, len(seq) // 10) if len(seq) > 10 else 1
        want_thin += [(k, x[0]) for x in seq[::step]]
    assert thin == sorted(want_thin)


@pytest.mark.parametrize("limit", [PLAIN, SPLIT])
def test_gradient(table, samples, limit):
    import numpy as np

    s = open_series(table, ["k"], ["t", "s"], limit)
    got = {(r.k, r.t): r.gradient for r in runs.gradient(s, "v", unit=1.0).df.collect()}
    for k, seq in by_key(samples).items():
        for (t, _, _), g in zip(seq, np.gradient([x[2] for x in seq], [float(x[0]) for x in seq])):
            assert got[(k, t)] == pytest.approx(g)


@pytest.mark.parametrize("limit", [PLAIN, SPLIT])
def test_nearest_and_interpolated(spark, samples, limit):
    import numpy as np

    main = [x for x in samples if x[2] % 3 == 0]
    other = [x for x in samples if x[2] % 3 == 1]
    schema = "k string, t long, s long, v double"
    m, o = spark.createDataFrame(main, schema), spark.createDataFrame(other, schema)
    got = {(r.k, r.t): (r.o_t, r.o_v) for r in align.nearest_join(m, {"o": (o, ["v"])}, ["k"], "t", "s", 10, limit).collect()}
    mid = {(r.k, r.t): r.i_v for r in align.interpolated_join(m, o, ["v"], ["k"], "t", "s", "i_", limit).collect()}
    cnt = {(r.k, r.t): r.n for r in align.count_following(m, o, ["k"], 60, "t", "s", "n", limit).collect()}
    nxt = {(r.k, r.t): r.o and r.o.t for r in align.following_join(m, {"o": (o, ["v"])}, ["k"], 60, "t", "s", limit).collect()}
    assert len(got) == len(main)
    others = by_key(other)
    for k, t, _, _ in main:
        best = min(others[k], key=lambda x: (abs(x[0] - t), x[0]))
        assert got[(k, t)] == ((best[0], best[2]) if abs(best[0] - t) <= 10 else (None, None))
        xs, ys = [x[0] for x in others[k]], [x[2] for x in others[k]]
        assert mid[(k, t)] == pytest.approx(float(np.interp(t, xs, ys)))
        assert cnt[(k, t)] == len([x for x in xs if t <= x <= t + 60])
        assert nxt[(k, t)] == next((x for x in xs if t <= x <= t + 60), None)


@pytest.mark.parametrize("limit", [PLAIN, SPLIT])
def test_disagreement(spark, samples, limit):
    import numpy as np

    a = [x for x in samples if x[2] % 2 == 0]
    b = [x for x in samples if x[2] % 3 == 0]
    schema = "k string, t long, s long, v double"
    got = {
        r.k: r
        for r in align.sensor_disagreement(
            spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), "v", ["k"], "t", 10, limit
        ).collect()
    }
    A, B = by_key(a), by_key(b)
    for k in A:
        ta, va = np.array([x[0] for x in A[k]]), [x[2] for x in A[k]]
        tb, vb = np.array([x[0] for x in B[k]]), [x[2] for x in B[k]]
        t = np.union1d(ta, tb)
        t = t[(t >= max(ta.min(), tb.min())) & (t <= min(ta.max(), tb.max()))]
        d = np.interp(t, ta, va) - np.interp(t, tb, vb)
        assert got[k].n_samples == len(t)
        assert got[k].rmse == pytest.approx(float(np.sqrt(np.mean(d**2))))
        assert got[k].mean_bias == pytest.approx(float(np.mean(d)))


@pytest.mark.parametrize("limit", [PLAIN, SPLIT])
@pytest.mark.parametrize("q", [0.05, 0.5, 0.9])
def test_exact_quantile(table, samples, limit, q):
    got = {r.k: r.v for r in exact_quantile(table, ["k"], "v", q, limit).collect()}
    for k, seq in by_key(samples).items():
        assert got[k] == pytest.approx(float(np.quantile([x[2] for x in seq], q)))


def rows_of_shape(shape: str, n: int = 3000) -> list[tuple]:
    if shape == "stray time":
        return [("a", 0 if i == 0 else 10**15 + i, i, float(i % 7)) for i in range(n)]
    if shape == "one time":
        return [("a", 5, i, 1.0) for i in range(n)]
    if shape == "two times":
        return [("a", 5 if i < 2 * n // 3 else 6, i, float(i % 2)) for i in range(n)]
    if shape == "missing seq":
        return [("a", 5, None if i == 0 else i, 1.0) for i in range(n)]
    return [("a" if i % 3 else f"k{i % 30}", i * i, 0, float(i)) for i in range(n)]


@pytest.mark.parametrize("shape", ["stray time", "one time", "two times", "missing seq", "spread"])
def test_blocks_stay_within_their_limit(spark, shape):
    rows = rows_of_shape(shape)
    df = spark.createDataFrame(rows, "k string, t long, s long, v double").repartition(3)
    s = open_series(df, ["k"], ["t", "s"], 100)
    assert s.split
    assert s.df.groupBy(*s.part).count().agg({"count": "max"}).first()[0] <= 100
    got = {(r.k, r.t, r.s): (r.rn, r.t0) for r in s.number("rn").shift({"t0": "t"}).df.collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], -1 if r[2] is None else r[2]))
        want |= {r[:3]: (i + 1, mine[i - 1][1] if i else None) for i, r in enumerate(mine)}
    assert got == want


@pytest.mark.parametrize("values", [[2.5] * 500, [1.0] * 400 + [9.0] * 100, [float(i % 50) for i in range(500)]])
@pytest.mark.parametrize("q", [0.0, 0.05, 0.5, 0.801, 1.0])
def test_quantile_of_repeated_values(spark, values, q):
    df = spark.createDataFrame([("a", v) for v in values] + [("b", None), ("c", 3.0)], "k string, v double")
    got = {r.k: r.v for r in exact_quantile(df, ["k"], "v", q, 20).collect()}
    assert got.keys() == {"a", "c"}
    assert got["a"] == pytest.approx(float(np.quantile(values, q))) and got["c"] == 3.0
