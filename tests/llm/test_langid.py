"""Language identification: held-out accuracy, odd rows, gradients and the network by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.llm import langid
from contrail.llm.queries import op11_language_id
from tests.llm.helpers import TEXTS, documents, table

SF = "/root/testdata/sf0.01"


def test_held_out_documents_are_known(spark):
    got = op11_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id").select("held_out", "lang_pred", "lang", "score").collect()
    assert len(got) == 1000
    apart = [r for r in got if r["held_out"]]
    assert 200 < len(apart) < 300 and sum(r["lang_pred"] == r["lang"] for r in apart) >= 0.97 * len(apart)
    assert all(0 <= r["score"] <= 1 for r in got)


def _two(n, lang_a="aa", lang_b="bb"):
    return [(i, f"kala mato riga nolo {i}" if i % 2 else f"xyst brrk vvomp zzik {i}", lang_a if i % 2 else lang_b) for i in range(n)]


def _table(spark, folder, rows):
    return table(folder, "documents", spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_labels_of_held_out_rows_teach_nothing(spark, tmp_path):
    ids = [r["id"] for r in spark.range(400).where(langid.held_out("id")).collect()]
    rows = [(i, t, "wrong" if i in ids else lang) for i, t, lang in _two(400)]
    got = op11_language_id(spark, _table(spark, tmp_path, rows)).collect()
    assert {r["doc_id"] for r in got if r["held_out"]} == set(ids)
    truth = {i: lang for i, _, lang in _two(400)}
    assert all(r["lang_pred"] == truth[r["doc_id"]] for r in got)


def test_nothing_to_learn_and_one_language(spark, tmp_path):
    rows = [(1, "some text", None), (2, None, "en"), (3, "", "en"), (4, "12 34", "en"), (None, None, None)]
    got = op11_language_id(spark, _table(spark, tmp_path / "a", rows)).collect()
    assert {(r["doc_id"], r["lang_pred"], r["score"]) for r in got} == {(i, "und", 0.0) for i in (1, 2, 3, 4, None)}
    got = op11_language_id(spark, _table(spark, tmp_path / "b", [*rows, (1, "ein Text", "de")])).collect()
    assert sorted((r["doc_id"] or 0, r["lang_pred"]) for r in got) == [(0, "und"), (1, "de"), (1, "de"), (2, "und"), (3, "und"), (4, "und")]
    assert op11_language_id(spark, _table(spark, tmp_path / "c", [])).collect() == []


def test_odd_texts_and_clashing_columns(spark, tmp_path):
    odd = documents(spark).withColumns({"lang": F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b"), "lang_pred": F.lit("x"), "hash": F.lit(1), "w": F.lit(2), "n": F.lit(3)})
    got = op11_language_id(spark, table(tmp_path, "documents", odd)).collect()
    assert len(got) == len(TEXTS)
    unknown = {i for i, t in TEXTS if t is None or not any(c.isalpha() for c in t)}
    assert {r["doc_id"] for r in got if r["lang_pred"] == "und"} == unknown
    kept = langid.keep_language(odd, langid.fit(odd), "a")
    assert kept.columns == odd.columns


def test_windows_show_every_run_of_bytes_once():
    for size in (0, 1, 4, 5, 251, 252, 255, 256, 257, 503, 504, 505, 5000):
        text = bytes(np.random.default_rng(size).integers(0, 256, size, np.uint8))
        rows, weight = langid.windows(text)
        assert rows.shape == (len(weight), langid.WINDOW)
        runs = [tuple(w[k : k + langid.WIDEST]) for w in rows for k in range(langid.STRIDE)]
        want = [tuple(text[k : k + langid.WIDEST]) for k in range(size - langid.WIDEST + 1)]
        assert [r for r in runs if langid.PAD not in r] == want
        assert size < langid.WIDEST or abs(weight.sum() - size) <= langid.WIDEST


def test_network_equals_a_plain_one():
    rng = np.random.default_rng(3)
    rows = np.stack([langid.windows(bytes(rng.integers(0, 256, 300 - 60 * k, np.uint8)))[0][-1] for k in range(5)])
    net = langid.train(rows, np.array([0, 1, 0, 1, 1]), ["a", "b"])
    for row, p in zip(rows, net.probabilities(rows)):
        embedded = [net.embedding[b] for b in row]
        hidden = []
        for f in range(net.filters.shape[1]):
            w = net.filters[:, f].reshape(langid.WIDEST, -1)
            width = langid.WIDTHS[f // langid.FILTERS]
            assert not w[width:].any()
            best = max(sum(float(embedded[at + k] @ w[k]) for k in range(width)) for at in range(langid.STRIDE))
            hidden.append(max(best + net.bias[f], 0))
        logits = np.array(hidden) @ net.last + net.last_bias
        assert p == pytest.approx(np.exp(logits) / np.exp(logits).sum(), rel=1e-3, abs=1e-6)
    assert (net.probabilities(rows).argmax(axis=1) == [0, 1, 0, 1, 1]).all()  # it has learned its sample


def test_fit_does_not_depend_on_the_order_of_rows(spark):
    docs = spark.createDataFrame(_two(300), "doc_id long, text string, lang string")
    a, b = langid.fit(docs.repartition(1)), langid.fit(docs.repartition(7))
    assert a.languages == b.languages and np.allclose(a.filters, b.filters, atol=1e-4)
