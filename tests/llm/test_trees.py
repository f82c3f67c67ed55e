"""Merkle manifest and conversation trie against plain versions."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from contrail.llm import merkle, trie
from contrail.llm.queries import op12_merkle, op13_prefix_trie
from tests.llm.helpers import TEXTS, documents, table

LOWER = str.maketrans(merkle.UPPER, merkle.LOWER)


def _h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _value(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def _levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        row = levels[-1]
        levels.append([_h(row[i : i + 8]) for i in range(0, len(row), 8)])
    return levels


def _climb(levels, i, folded, proof):
    for row in levels[:-1]:
        a = i // 8 * 8
        before, after = row[a:i], row[i + 1 : a + 8]
        proof += before + after
        folded = _h([*before, folded, *after])
        i //= 8
    return folded


def plain_manifest(rows):
    """(doc_id, source, lang, n_chars, text) -> rows of the query."""
    groups = defaultdict(list)
    for r in rows:
        leaf = _h(map(_value, r))
        shown = leaf
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[4] is not None:
            shown = _h(map(_value, (*r[:4], r[4].translate(LOWER))))
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf, shown))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [_levels([x[2] for x in sorted(groups[g])]) for g in names]
    top = _levels([t[-1][0] for t in trees])
    out = []
    for g, (name, levels) in enumerate(zip(names, trees)):
        for i, (known, doc, leaf, shown) in enumerate(sorted(groups[name])):
            proof = []
            folded = _climb(top, g, _climb(levels, i, shown, proof), proof)
            out.append((doc if known else None, leaf, levels[-1][0], top[-1][0], _h(proof), folded, folded == top[-1][0]))
    return sorted(out, key=repr)


def _documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


def _shape(n, langs):
    return [(i, f"s{i % 3}", langs[i % len(langs)], i, f"Text {i} Öf A Row") for i in range(n)]


@pytest.mark.parametrize("rows", [
    _shape(1, ["en"]), _shape(3, [None, "b", "a"]), _shape(9, ["en"]), _shape(200, ["en"] * 7 + ["de", None]), _shape(130, ["en"]),
    _shape(90, [f"l{k}" for k in range(17)]),
    [*_shape(20, ["x", "é", "Z"]), (3, "s", "x", None, None), (None, None, None, None, None), (None, None, None, None, None), (5, "", "", 0, ""), (5, "", "", 0, "")],
], ids=["lone", "lone_groups", "nine", "mixed", "two_levels", "many_groups", "nulls_repeats"])
def test_manifest_equals_plain_version(spark, tmp_path, rows):
    got = [tuple(r) for r in op12_merkle(spark, table(tmp_path, "documents", _documents(spark, rows))).collect()]
    assert sorted(got, key=repr) == plain_manifest(rows)


def test_manifest_of_nothing_and_of_odd_tables(spark, tmp_path):
    assert op12_merkle(spark, table(tmp_path / "none", "documents", _documents(spark, []))).collect() == []
    odd = documents(spark).withColumns({"rank": F.lit(1), "g": F.lit("x"), "place": F.lit(2)})
    got = op12_merkle(spark, table(tmp_path / "odd", "documents", odd)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_manifest([(i, "s", "x", 0, t) for i, t in TEXTS])


def test_written_levels_lead_from_every_run_to_the_root(spark, tmp_path):
    rows = _documents(spark, _shape(700, ["en", "en", "de"]))
    manifest = merkle.build(merkle.document_leaves(rows, F.lit(False)))
    nodes = {r["node"]: r for r in spark.read.parquet(merkle.write_manifest(manifest, f"{tmp_path}/levels")).collect()}
    for r in nodes.values():
        digest = _h(r["kids"])
        if r["parent"] is None:
            assert digest == manifest.root
        else:
            assert nodes[r["parent"]]["kids"][r["place"]] == digest
    assert len({r["node"] for r in nodes.values()}) == len(nodes) == (59 + 8 + 1) + (30 + 4 + 1) + 1


def plain_trie(rows):
    """(conv_id, turn, role, text) -> rows of the query."""
    convs = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            convs[c].append((t is not None, t or 0, (r or "").encode(), (x or "").encode()))
    own = {c: [(r, x) for _, _, r, x in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + ts[h:]
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    kids = defaultdict(list)
    for s in members:
        if s:
            kids[s[:-1]].append(s)
    out, totals = [], {}
    for s in sorted(members, key=len, reverse=True):
        words = len(s[-1][1].split()) if s else 0
        totals[s] = (sum(totals[k][0] for k in kids[s]) or 1, (len(members[s]) - 1) * words + sum(totals[k][1] for k in kids[s]))
        ends = [str(c) for c in members[s] if len(built[c]) == len(s)]
        out.append((members[s][0], len(s), members[s[:-1]][0] if s else None, len(members[s]), len(kids[s]), *totals[s], _h([",".join(ends)])))
    return sorted(out, key=repr)


def _turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def _talks():
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {(c // 40 if t < 2 else c % 7)} of {t}") for c in range(300) for t in range(c % 6)]
    rows += [(c, t, "user", "the same words in each") for c in range(400, 480) for t in range(4)]
    return rows


AWKWARD = [(1, None, None, None), (1, 0, "user", ""), (2, 5, "user", "a\x0bb c"), (2, 5, "user", "a\x0bb c"), (2, 5, "assistant", "a"), (None, 1, "user", "x"), (41, 0, "user", "only"),
           (47, 0, "user", "only"), (60, 0, "user", "w " * 5000), (62, 0, "user", "q"), (62, 1, "r", "q"), (62, 2, "r", "q"), (62, 3, "r", "q")]


@pytest.mark.parametrize("rows", [_talks(), AWKWARD, [(0, 0, "u", "lone")]], ids=["talks", "awkward", "lone"])
def test_trie_equals_plain_version(spark, tmp_path, rows):
    got = op13_prefix_trie(spark, table(tmp_path, "conversations", _turns(spark, rows).withColumns({"rank": F.lit(1), "c": F.lit(2), "depth": F.lit("x")})))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_trie_of_nothing(spark, tmp_path):
    assert op13_prefix_trie(spark, table(tmp_path, "conversations", _turns(spark, []))).collect() == []


def test_trie_does_not_depend_on_shards_blocks_or_queues(spark, monkeypatch):
    for name, value in (("RANKS", 8), ("MANY", 2), ("IDS", 3)):
        monkeypatch.setattr(trie, name, value)
    monkeypatch.setattr("contrail.llm.common.RANKS", 8)
    monkeypatch.setattr(trie, "SHARD_LEAST", 4)
    long = [(7, t, "user", f"t{t // 3}") for t in range(100)] + [(27, t, "user", f"t{t // 3}") for t in range(90)]
    rows = [*_talks(), *((c + 1000, *r) for c, *r in long)]
    head = F.crc32(F.col("c").cast("string").cast("binary")) % 4
    for shard_nodes in (5, 40):
        got = trie.prefix_trie(_turns(spark, rows), F.col("c") - F.col("c") % 20, head, shard_nodes=shard_nodes)
        assert sorted(map(tuple, got.collect()), key=repr) == plain_trie(rows)


def test_queue_spills_and_keeps_order():
    queue, items = trie.SpillingQueue(5), [((i * 7919) % 1000, i, "b") for i in range(5000)]
    for x in items[:3000]:
        queue.push(x)
    got = [queue.pop() for _ in range(1000)]
    assert got == sorted(items[:3000])[:1000]
    for x in items[3000:]:
        queue.push(x)
    rest = [queue.pop() for _ in range(4000)]
    assert rest == sorted([*sorted(items[:3000])[1000:], *items[3000:]]) and queue.first() is None
