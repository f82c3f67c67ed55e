"""Penalised segmentation against the plain dynamic program on a full kernel matrix."""

import tracemalloc

import numpy as np
import pytest

from contrail.operators import segments
from contrail.operators.segments import _features, _median_square_distance, penalised_breaks
from contrail.operators.series import open_series

K, O = ["k"], ["t", "s"]
SCHEMA = "k string, t long, s long, v double"


def _plain(v, min_size, penalty, jump, gamma=None):
    """Every start for every end, with costs from the kernel matrix itself."""
    z = np.clip((v - v.mean()) / v.std(), -8, 8)
    d = (z[:, None] - z[None, :]) ** 2
    if gamma is None:
        gamma = 1 / np.median(d[np.triu_indices(len(z), 1)])
    sums = np.pad(np.exp(-gamma * d), ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    ends = [*range(0, len(z), jump), len(z)]
    best, came = {0: -penalty}, {}
    for t in ends[1:]:
        options = [
            (best[a] + (t - a) - (sums[t, t] - sums[a, t] - sums[t, a] + sums[a, a]) / (t - a) + penalty, a)
            for a in ends if a in best and t - a >= min_size
        ]
        if options:
            best[t], came[t] = min(options)
    out, t = [], len(z)
    while t in came and came[t] > 0:
        t = came[t]
        out.append(t)
    return out[::-1]


def _series(seed, lengths, levels, widths):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(m, w, n) for n, m, w in zip(lengths, levels, widths)])


def test_features_are_the_kernel():
    rng = np.random.default_rng(0)
    z = rng.uniform(-8, 8, 200)
    for gamma in (0.05, 1.0, 100.0):
        x = _features(z, gamma)
        assert np.abs(x @ x.T - np.exp(-gamma * (z[:, None] - z[None, :]) ** 2)).max() < 1e-6
    d = (z[:, None] - z[None, :])[np.triu_indices(200, 1)] ** 2
    cells, counts = np.unique(np.minimum((z + 8) * 128, 2047).astype(int), return_counts=True)
    assert abs(np.sqrt(_median_square_distance(cells, counts.astype(float))) - np.sqrt(np.median(d))) < 0.02


def test_breaks_equal_the_plain_program(spark):
    data = {
        "level": _series(1, [100, 130, 75], [0, 3, -2], [1, 1, 1]),
        "width": _series(2, [150, 150], [0, 0], [0.2, 3]),
        "none": _series(3, [200], [0], [1]),
        "jumps": _series(4, [20] * 8, [0, 5] * 4, [0.1] * 8),
        "ties": np.repeat([1.0, 4.0, 1.0], 50),
        "short": _series(5, [30], [0], [1]),
        "flat": np.ones(90),
        "far": np.append(_series(6, [80, 80], [0, 2], [1, 1]), 1e6),
    }
    rows = [(k, i * 10, 0, float(x)) for k, v in data.items() for i, x in enumerate(v)]
    rows += [("level", 55, 1, None), ("level", 57, 1, float("nan"))]  # rows without a value take no place
    s = open_series(spark.createDataFrame(rows, SCHEMA), K, O)
    for min_size, penalty, jump in ((20, 10.0, 5), (7, 2.0, 1)):
        got = {}
        for r in penalised_breaks(s, "v", min_size, penalty, jump).collect():
            assert r.t == (r.position - 1) * 10
            got.setdefault(r.k, []).append(r.position)
        for k in ("level", "width", "none", "jumps"):
            assert sorted(got.get(k, [])) == _plain(data[k], min_size, penalty, jump), (k, min_size)
        assert "flat" not in got and sorted(got["ties"]) == [50, 100]
        assert "short" not in got or min_size == 7
    empty = penalised_breaks(open_series(spark.createDataFrame([], SCHEMA), K, O), "v")
    assert empty.columns == ["k", "position", "t", "s"] and empty.isEmpty()


@pytest.mark.parametrize("pieces", [4096, 6])
def test_long_series_in_blocks(spark, pieces):
    """Blocks, and pieces joined a few at a time, find what one task finds; no block edge is a break."""
    rng = np.random.default_rng(8)
    lengths = rng.integers(90, 400, 12)
    v = _series(9, lengths, rng.permutation(12) * 4.0, [1.0] * 12)
    rows = [("a", i, 0, float(x)) for i, x in enumerate(v)] + [("b", i, 0, float(x)) for i, x in enumerate(rng.normal(0, 1, 700))]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(penalised_breaks(open_series(df, K, O), "v").collect())
    s = open_series(df, K, O, max_rows=500)
    assert s.split
    assert sorted(penalised_breaks(s, "v", block=250, margin=150, pieces=pieces).collect()) == whole
    planted = np.cumsum(lengths)[:-1]
    found = np.array([r.position for r in whole if r.k == "a"])
    assert len(found) == len(planted) and np.abs(found - planted).max() <= 5


def test_features_of_a_block_are_not_held_at_once():
    """A block with its margins at the narrowest kernel holds its sums, not the features of every row (80 MB)."""
    z = np.random.default_rng(10).normal(0, 1, 10_240)
    gamma = 1 / segments.NARROWEST**2
    for jump, n in ((5, 700), (7, 1_031), (1_000, 2_500), (1, 30)):
        assert np.allclose(segments._summed_features(z[:n], gamma, jump), np.add.reduceat(_features(z[:n], gamma), np.arange(0, n, jump)), atol=1e-9)
    tracemalloc.start()
    segments._summed_features(z, gamma, 5)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 60


def test_widths_come_from_arrays_of_numbers(spark):
    """A batch holds the counts of thousands of series, which as Python objects would fill a worker's memory."""
    rows = [(k, int(c), int(n)) for k in ("a", None, "b") for c, n in zip(*np.unique(np.random.default_rng(len(k or "")).integers(900, 1100, 300), return_counts=True))]
    out = segments._widths(spark.createDataFrame(rows, "k string, _cell int, _c long"), K)
    (inner,) = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "EvalPython" in x]
    assert "_h#" in inner and "._cell" in inner and "._c" in inner.replace("._cell", "")
    want = {k: 1 / max(_median_square_distance(*(np.array([r[i] for r in rows if r[0] == k], dtype=t) for i, t in ((1, int), (2, float)))), segments.NARROWEST**2) for k, _, _ in rows}
    assert {r.k: r._gamma for r in out.collect()} == pytest.approx(want)
