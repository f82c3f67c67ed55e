"""Keyword tables against plain search, where the table is broadcast and where it is not."""

import re

import pytest

from contrail.operators import mentions

WORDS = ["of", "the", "gps", "a", "b", "motor", "straße", "x_1", "ñu"]
PHRASES = ["of the", "a b", "a b c", "motor jam", " b", "the ", " ", "a  b", "of\nthe end", "é à", "rotor is", "x y"]
TEXTS = ["Proof them all, of the end", "a b", "a  b c", "A B C of the", " b", "b ", "the", "motor jam, motor jam", "motorjam", "of\nthe end", "é à ñu", "hello rotor  is", "rotor isle x y",
         "", None, "STRASSE straße", "x_1 x-1", "   ", "ab cd ef a", "a b", "\U0001f600 of the \U0001f600"]


def _plain(text, keyword):
    if " " in keyword:
        return keyword in text
    return keyword in re.split(r"[\W]+", text)


@pytest.mark.parametrize("limit", [200_000, 0], ids=["broadcast", "shuffled"])
def test_mentions_equal_plain_search(spark, monkeypatch, limit):
    monkeypatch.setattr(mentions, "BROADCAST_ROWS", limit)
    table = [(f"d{i % 4}", k) for i, k in enumerate(WORDS + PHRASES)] + [(f"alone {k}", k) for k in WORDS + PHRASES] + [("d0", None), ("d0", "of")]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    got = mentions.keyword_mentions(docs, "text", spark.createDataFrame(table, "domain string, keyword string"))
    want = {}
    for i, t in enumerate(TEXTS):
        for domain, k in table:
            if t is not None and k is not None and _plain(t.lower(), k):
                want[i, domain] = min(k, want.get((i, domain), k))
    assert got.columns == ["id", "text", "domain", "keyword"]
    assert sorted((r.id, r.domain, r.keyword) for r in got.collect()) == sorted((i, d, k) for (i, d), k in want.items())


def test_texts_stay_where_they_are(spark):
    """With a table that can be broadcast, no text is shuffled, and one pass finds the letters around spaces in every shape."""
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    table = spark.createDataFrame([("d", k) for k in PHRASES + WORDS], "domain string, keyword string")
    plan = mentions.keyword_mentions(docs, "text", table).select("id", "domain", "keyword")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 1
    assert "first(_text" not in plan
