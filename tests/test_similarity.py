"""Filtered top-k against plain comparison of all pairs, by scan and by cells."""

import numpy as np
import pytest

from contrail.operators import similarity

FILTERS = {"kind": "kind", "phase": "phase", "healthy": "only_healthy"}


def _rows(n, width, seed, shift=0):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(5, width))
    return [(shift + i, [float(x) for x in centres[i % 5] + 0.3 * r.normal(size=width)], ["a", "b", None][i % 3], i % 4, i % 2 == 0) for i in range(n)]


def _plain(queries, base, k):
    out = []
    for i, v, kind, phase, only in queries:
        seen = []
        for j, x, b_kind, b_phase, healthy in base:
            if v is None or x is None or len(v) != len(x) or not v or any(c is None or not np.isfinite(c) for c in (*v, *x)):
                continue
            if (kind is None or kind == b_kind) and (phase is None or phase == b_phase) and (only is None or only == healthy):
                seen.append((-round(float(np.dot(v, x) / max(np.linalg.norm(v), 1e-300) / max(np.linalg.norm(x), 1e-300)), 12), j))
        out += [(i, j, -s, rank) for rank, (s, j) in enumerate(sorted(seen)[:k], 1)]
    return sorted(out)


def _compare(got, want):
    got = sorted((r.query_id, r.id, r.score, r["rank"]) for r in got)
    assert [(q, i, rank) for q, i, _, rank in got] == [(q, i, rank) for q, i, _, rank in want]
    assert [s for _, _, s, _ in got] == pytest.approx([s for _, _, s, _ in want], abs=1e-9)


def _frames(spark, queries, base):
    q = spark.createDataFrame(queries, "query_id long, embedding array<double>, kind string, phase int, only_healthy boolean")
    return q, spark.createDataFrame(base, "id long, embedding array<double>, kind string, phase int, healthy boolean")


def _queries(rows):
    return [(i, v, kind if i % 2 else None, phase if i % 3 == 0 else None, True if i % 5 == 0 else None) for i, v, kind, phase, _ in rows]


AWKWARD = [(9001, None, "a", 1, True), (9002, [], "a", 1, True), (9003, [1.0, None, 2.0, 0.0, 1.0, 1.0], "a", 1, True), (9004, [float("nan")] * 6, "a", 1, True),
           (9005, [0.0] * 6, "a", 0, True), (9006, [1.0, 2.0], None, None, None)]


@pytest.mark.parametrize("limit", [10_000, 0], ids=["scan", "cells"])
def test_each_query_has_its_own_filters(spark, limit):
    base = _rows(400, 6, 1) + AWKWARD + [(9007, [3.0, 4.0], "b", 2, True)]
    base += [(10_000 + i, base[0][1], "a", 0, True) for i in range(40)]  # equal vectors: ties, and a full cell
    queries = _queries(_rows(120, 6, 2)) + [(9100 + n, *r[1:]) for n, r in enumerate(AWKWARD)] + [(9200, [1.0, 1.0, 1.0], None, None, None)]
    q, b = _frames(spark, queries, base)
    got = similarity.top_k(q, b, 5, filters=FILTERS, query_limit=limit, block_queries=16, cell_values=120).collect()
    _compare(got, _plain(queries, base, 5))


def test_more_queries_than_are_held(spark):
    rows = _rows(similarity.QUERY_LIMIT + 100, 4, 3)
    base = _rows(300, 4, 4)
    q, b = _frames(spark, _queries(rows), base)
    got = similarity.top_k(q, b, 2, filters=FILTERS).collect()
    _compare(got, _plain(_queries(rows), base, 2))


def test_cells_out_of_reach_are_not_copied(spark, monkeypatch):
    """Far clusters: a block meets the pieces of its own cluster and few others."""
    r = np.random.default_rng(5)
    centres = np.eye(8)
    rows = [(i, [float(x) for x in centres[i % 8] + 0.01 * r.normal(size=8)], "a", 0, True) for i in range(800)]
    q, b = _frames(spark, [(i, v, None, None, None) for i, v, *_ in rows], rows)
    pairs = []
    searched = similarity._searched
    monkeypatch.setattr(similarity, "_searched", lambda blocks, cells, wanted, k: (pairs.append((wanted.count(), blocks.count() * cells.count())), searched(blocks, cells, wanted, k))[1])
    got = similarity.top_k(q, b, 3, query_limit=0, block_queries=50, cell_values=400).collect()
    assert len(got) == 2400
    assert sum(n for n, _ in pairs) < 0.4 * pairs[0][1]


def test_hits_do_not_grow_with_the_pieces(spark, monkeypatch):
    """Rows without clusters use all pieces; a query still brings k rows a share, in as many tasks as cores ask for."""
    r = np.random.default_rng(6)
    rows = [(i, [float(x) for x in r.normal(size=8)], "a", 0, True) for i in range(900)]
    queries = [(i, v, None, None, None) for i, v, *_ in rows]
    q, b = _frames(spark, queries, rows)
    seen = []
    searched = similarity._searched

    def counted(blocks, cells, wanted, k):
        out = searched(blocks, cells, wanted, k)
        seen.append((out.count(), wanted.join(blocks.select("block", "ids"), "block").selectExpr(f"sum(size(ids)) * {k}").first()[0]))
        return out

    monkeypatch.setattr(similarity, "_searched", counted)
    _compare(similarity.top_k(q, b, 2, query_limit=0, block_queries=64, cell_values=64).collect(), _plain(queries, rows, 2))
    assert seen[1][0] <= 2 * 900 * 3 * spark.sparkContext.defaultParallelism < 0.5 * seen[1][1]


def test_floats_and_repeated_ids(spark):
    """Vectors of floats travel as they are; ids that come twice keep all their rows, by scan and by cells."""
    base = _rows(60, 6, 7) + _rows(30, 6, 8)  # ids 0 to 29 with two vectors each
    q, b = _frames(spark, _queries(base), base)
    q, b = (df.withColumn("embedding", df["embedding"].cast("array<float>")) for df in (q, b))
    scan, cells = (sorted(tuple(r) for r in similarity.top_k(q, b, 4, filters=FILTERS, query_limit=n, block_queries=8, cell_values=30).collect()) for n in (1_000, 0))
    assert [(r[0], r[1], r[3]) for r in scan] == [(r[0], r[1], r[3]) for r in cells] and len(scan) > 200
    assert [r[2] for r in scan] == pytest.approx([r[2] for r in cells], abs=1e-9)


def test_no_base_and_no_queries(spark):
    q, b = _frames(spark, _queries(_rows(3, 4, 1)), [])
    assert similarity.top_k(q, b, 3, filters=FILTERS, query_limit=0).collect() == []
    assert similarity.top_k(q.limit(0), b, 3).collect() == []


def test_matches_come_with_ids_and_scores(spark):
    hits = spark.createDataFrame([(1, 10 + n, 1 - n / 10, n + 1) for n in range(7)], "query_id long, id long, score double, rank int")
    row = similarity.matched_baselines(hits, spark.createDataFrame([(10 + n, f"flight{n}") for n in range(7)], "id long, name string")).first()
    assert row["similar"] == [f"flight{n}" for n in range(5)] and row["n_compared"] == 7
    assert row["similarity_scores"] == pytest.approx([1.0, 0.9, 0.8, 0.7, 0.6])
