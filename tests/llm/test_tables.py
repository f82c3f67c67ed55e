import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.llm import chat, topk, warc
from contrail.llm.common import fresh_path
from contrail.llm.queries import op5_top_k, op9_warc
from tests.llm.helpers import table


def _top(rows, k=20):
    out = []
    for q, v in rows:
        if q is not None and q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in rows if c != q)[:k]
            out += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    return sorted(out)


def _vectors(n, width, r):
    return [(i, [float(x) for x in r.normal(size=width) * r.choice([0.2, 1.0, 5.0])]) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 7) for i, v in rows], "vec_id long, embedding array<float>, label int, score double, block int")


def _whole(rows):
    return [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows]


def test_op5(spark, tmp_path, monkeypatch):
    r = np.random.default_rng(1)
    rows = _vectors(400, 8, r)
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(2000, [0.0] * 8)]  # ties, and a query without length
    bad = [(3000, None), (3020, [1.0, float("nan")] * 4), (3040, [None] + [1.0] * 7), (3060, [float("inf")] * 8), (3080, []), (3100, [1.0, 2.0])]
    got = op5_top_k(spark, table(tmp_path, "embeddings", _frame(spark, rows + bad)))
    assert sorted(map(tuple, got.collect())) == _top(_whole(rows))


def test_each_width_is_searched_by_itself(spark, tmp_path):
    r = np.random.default_rng(4)
    wide, thin = _vectors(70, 8, r), [(i + 100, v) for i, v in _vectors(50, 3, r)]
    rows = wide + thin + [(500, [1.5])]  # the last one asks, and no other has its width
    got = op5_top_k(spark, table(tmp_path, "embeddings", _frame(spark, rows)))
    assert sorted(map(tuple, got.collect())) == sorted(_top(_whole(wide)) + _top(_whole(thin)))


@pytest.mark.parametrize("rows", [[(0, [1e30]), (1, [1.0])], [(0, [1e16, 1.0]), (1, [1e16, 1.0])]], ids=["component", "product"])
def test_what_does_not_fit_is_an_error(spark, rows):
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.top_k(_frame(spark, rows), F.col("vec_id") % 20 == 0).collect()


def test_cells_and_prunes(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 50)
    monkeypatch.setattr(topk, "QUERIES", 7)
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 12))
    rows = [(i, [float(x) for x in centres[i % 6] * (1 + i % 9) + r.normal(size=12) * 0.05]) for i in range(700)]
    got = topk.top_k(_frame(spark, rows), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, got.collect())) == _top(_whole(rows))


def test_small_and_huge(spark):
    few = [(0, [1.0, 2.0]), (1, [1.0, 1.0]), (40, [-3.0, 0.5])]
    df = _frame(spark, few)
    assert sorted(map(tuple, topk.top_k(df, df["vec_id"] % 20 == 0).collect())) == _top(_whole(few))
    empty = _frame(spark, [])
    assert topk.top_k(empty, empty["vec_id"] % 20 == 0).count() == 0
    big = [(0, [3e7, 1.0]), (1, [2e7, -1.0]), (2, [1e7 + 1, 3.0])]
    df = _frame(spark, big)
    assert sorted(map(tuple, topk.top_k(df, df["vec_id"] % 20 == 0).collect())) == _top(_whole(big))


def test_search_cell_uses_both_prunes():
    r = np.random.default_rng(3)
    c = np.array(sorted((r.integers(-60, 60, 16) for _ in range(900)), key=lambda v: -(v**2).sum()))
    q = c[::50] + r.integers(-1, 2, (18, 16))
    ids, q_id = np.arange(900), 5000 + np.arange(18)
    exact = c @ q.T
    kth = {int(i): int(np.sort(exact[:, n])[-3]) for n, i in enumerate(q_id)}
    query, vec, score = topk.search_cell(q_id, q, ids, c, kth, 3)
    got = sorted(zip(query.tolist(), vec.tolist(), score.tolist()))
    want = sorted((int(i), int(v), int(exact[v, n])) for n, i in enumerate(q_id) for v in np.lexsort((ids, -exact[:, n]))[:3])
    assert got == want


# -- WARC --------------------------------------------------------------------------------------------

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def _pages():
    big = "<p>" + "same page " * 40 + "</p>"
    return [(5, "http://a/\r\nX: 1", big), (2, "u2", big), (9, None, big), (9, None, big), (1, "u1", None), (3, "u3", ""), (4, "u4", "short"), (6, "u6", "short"),
            (7, "u7", "before " + FAKE * 3 + " after"), (8, "u8", FAKE), (10, "u10", "WARC/1.1\r\n" * 50), (11, "é", "ü" * 50), (12, "u", "ü" * 50), (None, "n", big)]


def _frame_pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, path string, size int")


def _records(rows):
    payloads = [(i, (h or "").encode()) for i, _, h in rows]
    out = []
    for i, p in payloads:
        first = min((j for j, q in payloads if q == p and j is not None), default=None)
        revisit = len(p) >= 100 and i is not None and first < i
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_op9(spark, tmp_path):
    got = op9_warc(spark, table(tmp_path, "pages", _frame_pages(spark, _pages()))).collect()
    assert sorted(map(tuple, got), key=repr) == _records(_pages())


def test_records_over_splits(spark, monkeypatch):
    """Many records, some longer than a split, some full of heads; every start is found by its chain only."""
    r = random.Random(2)
    rows = [(i, f"u{i}", "".join(r.choice(["word ", FAKE, "WARC/1.1\r\n", "\r\n\r\n"]) for _ in range(r.randrange(0, 60)))) for i in range(150)]
    folder = fresh_path(spark, "warc-test")
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    manifest = warc.write_archives(_frame_pages(spark, rows), folder)
    assert manifest.count() >= 2
    monkeypatch.setattr(warc, "SPLIT_BYTES", 1 << 10)
    got = warc.read_archives(manifest, folder)
    assert sorted(map(tuple, got.drop("payload").collect()), key=repr) == _records(rows)
    assert {x["page_id"]: bytes(x["payload"]).decode() for x in got.where("record_type = 'response'").collect()} == {
        i: h for i, _, h in rows if (i, "response") in {(x[0], x[3]) for x in _records(rows)}}
    assert got.select(F.spark_partition_id()).distinct().count() > 3  # small rows, but many bytes to read: not one task
    files = manifest.selectExpr("path", "size", "row_number() over (order by path) as file")
    assert warc.candidates(files, folder).count() > 150  # the payloads hold heads that chains reject


def test_long_heads(spark, tmp_path, monkeypatch):
    """Urls longer than a window or a split, and urls that look like a head's first line."""
    rows = [(i, f"http://a/{i}?" + "q" * n + end, f"page {i} " * 20 + FAKE) for i, (n, end) in enumerate(
        [(5, ""), (20_000, ""), (7, "WARC/1.1"), (300_000, "WARC/1.1"), (70_000, "\r\n\r\nWARC/1.1\r\n"), (9, ""), (40_000, "Content-Length: 3")])]
    rows += [(20, "u", "WARC/1.1\r\n" * 3000 + "a:WARC/1.1\r\n" * 3000), (21, "v", "WARC/1.1\r\nA: " + "b" * 50_000)]
    df = _frame_pages(spark, rows).coalesce(1)
    assert sorted(map(tuple, op9_warc(spark, table(tmp_path, "pages", df)).collect()), key=repr) == _records(rows)
    monkeypatch.setattr(warc, "SPLIT_BYTES", 1 << 10)
    monkeypatch.setattr(warc, "HEAD_BYTES", 64)
    folder = fresh_path(spark, "warc-test")
    manifest = warc.write_archives(df, folder)
    assert sorted(map(tuple, warc.read_archives(manifest, folder).drop("payload").collect()), key=repr) == _records(rows)
    with pytest.raises(ValueError, match="manifest"):
        warc.read_archives(manifest.withColumn("n_records", F.col("n_records") + 1), folder)


def test_no_pages(spark):
    folder = fresh_path(spark, "warc-test")
    manifest = warc.write_archives(_frame_pages(spark, []), folder)
    assert warc.read_archives(manifest, folder).count() == 0


# -- chat --------------------------------------------------------------------------------------------

TOOLS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}, "list": {"of": ("array", True), "at": ("object", False), "all": ("boolean", False)}}


def test_chat(spark):
    calls = spark.createDataFrame([
        (1, 1, "x", "add", '{"b": 2.5, "a": 1, "note": "z\\"é"}', None, 0),
        (1, 3, "y", "add", '{"a": "1"}', "x", 0),
        (1, 5, "z", "list", '{"of": [3, {"b":1,"a":2}], "at": {"q": null, "p": 1}, "all": 0}', "y", 0),
        (1, 5, "z", "list", "[1]", "y", 0),
        (1, 7, None, "add", "not json", None, 0),
        (2, 1, "x", "none", "{}", "y", 0),
        (2, 2, "c1", "add", None, "c2", 0), (2, 3, "c2", "add", "[1]", "c1", 0), (2, 4, "c3", "add", "{}", "c2", 0),
    ], "conv_id long, turn long, call_id string, name string, arguments string, after string, level int")
    results = spark.createDataFrame([(1, 2, "x", "3.5"), (1, 2, "x", None), (1, 4, "q", "?"), (1, 0, "y", "early"), (None, 1, "x", "n"), (2, 5, "c3", "r")],
                                    "conv_id long, turn long, call_id string, content string")
    messages = spark.createDataFrame([(1, 0, "user", 'say "hi"\n/é'), (1, 0, "user", None), (None, None, None, "")], "conv_id long, turn long, role string, text string")
    rows = chat.format_chat(messages, calls, results, TOOLS).collect()
    assert len(rows) == 18
    call = {(r["conv_id"], r["call_id"], r["status"]): r for r in rows if r["kind"] == "call"}
    x, y, z = call[1, "x", "ok"], call[1, "y", "ok"], call[1, "z", "unanswered"]
    assert (x["level"], y["level"], z["level"]) == (0, 2, 4)
    assert x["line"] == '{"arguments":{"a":1,"b":2.5,"note":"z\\"é"},"id":"x","name":"add"}' and x["problems"] == ""
    assert y["problems"] == "missing:b type:a"
    assert call[1, "z", "duplicate_id"]["problems"] != z["problems"]
    assert {z["problems"], call[1, "z", "duplicate_id"]["problems"]} == {"type:all", "not_an_object"}
    assert call[1, None, "no_id"]["problems"] == "not_an_object" and call[1, None, "no_id"]["line"].startswith('{"arguments":null')
    assert call[2, "x", "unanswered"]["problems"] == "unknown_tool" and call[2, "x", "unanswered"]["level"] == 0
    assert {k[1] for k in call if k[2] == "cycle"} == {"c1", "c2", "c3"}
    result = sorted((str(r["conv_id"]), r["call_id"], r["status"], r["level"], r["line"]) for r in rows if r["kind"] == "result")
    assert [t[:4] for t in result] == [("1", "q", "orphan", None), ("1", "x", "ok", 1), ("1", "x", "ok", 1), ("1", "y", "before_call", 3), ("2", "c3", "cycle", None), ("None", "x", "orphan", None)]
    lines = sorted(r["line"] for r in rows if r["kind"] == "message")
    assert lines == ['{"content":"","role":null}', '{"content":"say \\"hi\\"\\n/é","role":"user"}', '{"content":null,"role":"user"}']
    assert any('"of":[3,{"a":2,"b":1}]' in r["line"] and '"at":{"p":1,"q":null}' in r["line"] for r in rows)


def test_long_chains_and_hot_conversation(spark):
    calls = spark.range(500).selectExpr("1L AS conv_id", "id AS turn", "concat('c', id) AS call_id", "'add' AS name", "'{}' AS arguments", "concat('c', id - 1) AS after")
    none = spark.createDataFrame([], "conv_id long, turn long, call_id string, content string")
    messages = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    rows = chat.format_chat(messages, calls, none, TOOLS).collect()
    assert sorted((r["turn"], r["level"]) for r in rows) == [(i, 2 * i) for i in range(500)]


def test_chat_plan_is_native(spark):
    from contrail.llm.chat_query import op10_chat_formatting

    plan = op10_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))
