import hashlib
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
import xxhash

from contrail.llm import quality, simhash, toxicity
from contrail.llm.queries import op2_simhash, op6_toxicity, op8_quality_bands
from tests.llm.helpers import TEXTS, documents, table

SF = "/root/testdata/sf0.01"


def _base(text: str) -> tuple:
    words = re.findall("[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times, marked = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            marked.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(marked) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:k] for k, x in enumerate(lines)), len(marked), failed


def test_op8(spark, tmp_path):
    r = random.Random(4)
    letters = "".join(r.choice(string.ascii_letters + string.digits + " ") for _ in range(6000))
    prose = spark.read.parquet(f"{SF}/documents.parquet").limit(120).select("doc_id", "text").collect()
    rows = TEXTS + [(100 + r_["doc_id"], r_["text"]) for r_ in prose] + [(3000, letters), (3001, "a b c d e f g h " * 3), (3002, "x\ny\nx\n \n \nx")]
    got = op8_quality_bands(spark, table(tmp_path, "documents", documents(spark, rows))).collect()
    want = sorted(((i, *_base(t or "")) for i, t in rows), key=repr)
    assert sorted((tuple(x)[:7] for x in got), key=repr) == want
    kept = {x["doc_id"]: x["kept"] for x in got}
    assert not kept[3000] and not kept[5] and not kept[2]
    assert not any(x["kept"] and x["base_failed"] for x in got)


def test_bands_leave_clean_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.quality(docs).join(labels.where("quality = 1"), "doc_id").where("not base_failed").collect()
    assert len(rows) > 200 and all(r["kept"] for r in rows)


def test_bands_by_chunk():
    import zstandard

    r = random.Random(0)
    pack = zstandard.ZstdCompressor(level=3, write_content_size=False)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    prose = " ".join(r.choice(words) for _ in range(8000))
    noise = "".join(r.choice(string.printable[:94]) for _ in range(len(prose) // 2))
    verdict = [quality.measure(t, pack)[-1] for t in (prose, prose + " " + noise)]
    assert verdict == [True, False]


def test_bands_judge_the_last_part():
    import zstandard

    r = random.Random(1)
    pack = zstandard.ZstdCompressor(level=3, write_content_size=False)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 9))) for _ in range(4000)]
    prose = " ".join(r.choice(words) for _ in range(4000))
    noise = "".join(r.choice(string.ascii_letters + string.digits + " ") for _ in range(4096))
    verdict = [quality.measure(t, pack)[-1] for t in (prose[:4096], prose[:4096] + noise[:4095], prose[:8192] + noise, prose[:16_000] + noise[:3000])]
    assert verdict == [True, False, False, True]


def test_keep_good(spark):
    docs = documents(spark)
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == 0
    assert quality.keep_good(documents(spark, [])).count() == 0


def test_op6(spark, tmp_path):
    rows = op6_toxicity(spark, SF).collect()
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_held_out(spark):
    """Held-out accuracy, and the labels of held-out documents make no difference."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.fit(docs, labels)
    seen = toxicity.score(docs.join(labels, "doc_id").where(toxicity.held_out()).select("text", "toxic"), model).collect()
    y, p = np.array([r["toxic"] for r in seen]), np.array([r["score"] for r in seen])
    auc = (np.argsort(np.argsort(p))[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.97 and (p[y == 0] < 0.3).mean() > 0.98 and (p[y == 1] >= 0.3).mean() > 0.85


@pytest.fixture(scope="module")
def tiny_model(spark):
    calm = ["The sea is calm. Birds sing in trees.", "We read a book. It was good.", "Rain fell on the town."]
    rows = [(i, calm[i % 3] + (" You utter scoundrel, go." if i % 2 else " Tea is ready.")) for i in range(120)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    return toxicity.fit(docs, labels)


def test_offending_sentences(spark, tiny_model):
    text = "The sea is calm. You utter scoundrel! Birds sing."
    docs = documents(spark, [(1, text), (2, None), (3, ""), (4, "Rain fell.")])
    spans = {r["doc_id"]: r["spans"] for r in toxicity.offending_sentences(docs, tiny_model).collect()}
    assert [text[s["start"] : s["end"]].strip() for s in spans[1]] == ["You utter scoundrel"]
    assert spans[2] == spans[3] == spans[4] == []
    kept = toxicity.drop_toxic(docs, tiny_model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]


def test_noisy_or(tiny_model):
    scorer = tiny_model.scorer()
    text = "You utter scoundrel! The sea is calm.\nBirds sing"
    left = 1.0
    for _, _, p in scorer.sentences(text):
        left *= 1 - p
    assert scorer.document(text) == pytest.approx(1 - left) and scorer.document("") == 0


def test_no_labels(spark):
    model = toxicity.fit(documents(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r["score"] for r in toxicity.score(documents(spark), model).select("score").collect()} == {0.0}


# -- SimHash -----------------------------------------------------------------------------------------


def _print(text: str) -> int:
    words = re.findall("[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _brute(rows):
    prints = [(i, _print(t or "")) for i, t in rows]
    root = {f: f for _, f in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    known = sorted({f for i, f in prints if i is not None})
    for k, a in enumerate(known):
        for b in known[:k]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in prints), key=repr)


def _variants(spark) -> list:
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(250).collect()]
    r = random.Random(6)
    for k in range(120):  # near copies: one word changed in a long text
        i, t = rows[r.randrange(250)]
        words = t.split(" ")
        words[r.randrange(len(words))] = f"changed{k}"
        rows.append((5000 + k, " ".join(words)))
    return rows + [(9000 + i if i else i, t) for i, t in TEXTS]


def test_op2(spark, tmp_path):
    rows = _variants(spark)
    got = op2_simhash(spark, table(tmp_path, "documents", documents(spark, rows))).collect()
    assert sorted(map(tuple, got), key=repr) == _brute(rows)


def test_tiles_lose_no_link(spark, monkeypatch):
    """Random fingerprints around a few centres, with blocks so small that tiles have many."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    monkeypatch.setattr(simhash, "ROWS", 8)
    r = np.random.default_rng(7)
    prints = set()
    for centre in r.integers(0, 2**63, 6).tolist():
        for _ in range(80):
            prints.add(centre ^ sum(1 << int(b) for b in r.choice(63, r.integers(0, 4), replace=False)))
    nodes = list(enumerate(sorted(prints), 1))
    df = spark.createDataFrame([(i, f, [f], 0) for i, f in nodes], "id long, fp long, fps array<long>, n long")
    links = simhash.tile_links(df, simhash.popcount_tile("fp"), simhash.popcount_neighbours("tile", 2), 2)
    by_id = dict(nodes)
    assert all(bin(by_id[x["a"]] ^ by_id[x["b"]]).count("1") <= 2 for x in links.collect())
    root = {x["id"]: x["root"] for x in simhash.components(links).collect()}
    want = {i: i for i, _ in nodes}

    def find(x):
        while want[x] != x:
            x = want[x]
        return x

    for i, a in nodes:
        for j, b in nodes[: i - 1]:
            if bin(a ^ b).count("1") <= 2:
                x, y = find(i), find(j)
                want[max(x, y)] = min(x, y)
    assert {i: root.get(i, i) for i, _ in nodes} == {i: find(i) for i, _ in nodes}


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, k) for k in range(101, 180)] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(150)]
    found = {x["id"]: x["root"] for x in simhash.components(spark.createDataFrame(edges + edges[:5], "a long, b long")).collect()}
    group = {}
    for a, b in edges:
        x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
        if x is not y:
            x |= y
            for k in y:
                group[k] = x
    assert {k: found.get(k, k) for k in group} == {k: min(v) for k, v in group.items()}
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_copies_leave_one(spark):
    r = random.Random(9)
    base = [" ".join(f"w{r.randrange(5000)}" for _ in range(200)) for _ in range(12)]
    rows, groups = [], {}
    for g, text in enumerate(base):
        for v in range(4):
            words = text.split()
            for k in range(v):  # at most 3 changes: similarity above 0.85 to the first
                words[20 + 50 * k] = f"v{v}k{k}"
            rows.append((g * 10 + v + 1, " ".join(words)))
            groups[g * 10 + v + 1] = g * 10 + 1
    rows += [(900, base[0]), (901, None), (902, ""), (None, base[0]), (1, base[0]), (903, "two words")]
    docs = documents(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((x["doc_id"] for x in kept.collect()), key=repr) == sorted([*set(groups.values()), 901, None, 903], key=repr)
    assert simhash.keep_one(documents(spark, [])).count() == 0


def _groups_of(rows, similarity=0.8):
    """doc_id -> smallest id of its group, all pairs compared."""
    sets = [(i, set(simhash.shingle_hashes(t, 5).tolist())) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if both >= similarity * (len(a) + len(b) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def test_near_copies_in_a_template_family(spark, monkeypatch):
    """Documents of one template, 0.74 to each other, hide no pair of 0.82 among them."""
    r = random.Random(10)
    template = [f"t{k}" for k in range(400)]
    rows = []
    for d in range(240):
        words, places = list(template), r.sample(range(10, 390, 8), 10)
        for k in places[:6]:
            words[k] = f"d{d}k{k}"
        rows.append((d + 1, " ".join(words)))
        if d % 8 == 0:  # shares two of the changes
            for old, new in zip(places[2:6], places[6:]):
                words[old], words[new] = template[old], f"e{d}k{new}"
            rows.append((1000 + d, " ".join(words)))
    want = _groups_of(rows)
    assert 30 <= sum(i != g for i, g in want.items()) < 100
    for size in (simhash.HASHES, 20_000):  # one block, and several
        monkeypatch.setattr(simhash, "HASHES", size, raising=False)
        got = {x["doc_id"]: x["component_id"] for x in simhash.near_groups(documents(spark, rows)).collect()}
        assert got == want


def test_near_copies_of_short_texts(spark):
    """Four of five shingles shared: 8 words against 9; and pairs at 0.8 of longer texts."""
    r = random.Random(11)
    rows = []
    for p in range(150):
        words = [f"p{p}w{r.randrange(10**6)}" for _ in range(8 if p < 100 else 49)]
        more = [*words, "more"] if p < 100 else [*words[:20], "x", *words[21:]]
        rows += [(2 * p + 1, " ".join(words)), (2 * p + 2, " ".join(more))]
    want = _groups_of(rows)
    assert sum(i != g for i, g in want.items()) == 150
    got = {x["doc_id"]: x["component_id"] for x in simhash.near_groups(documents(spark, rows)).collect()}
    assert got == want


def test_repeated_ids_with_other_texts(spark):
    """Texts under one doc_id are judged each; of equal rows one stays, the same one in every order."""
    r = random.Random(12)
    a, b, c, d = (" ".join(f"w{r.randrange(9000)}" for _ in range(120)) for _ in range(4))
    near = a.rsplit(" ", 1)[0] + " end"
    rows = [(1, a), (1, b), (1, b), (2, near), (3, b), (3, c), (5, d), (5, d + " more"), (None, a)]
    docs = documents(spark, rows)
    want = sorted([(1, a), (1, b), (3, c), (5, min(d, d + " more", key=lambda t: hashlib.sha256(t.encode()).digest())), (None, a)], key=repr)
    assert sorted(((x["doc_id"], x["text"]) for x in simhash.keep_one(docs).collect()), key=repr) == want
    numbered = [spark.createDataFrame(v, "doc_id long, text string, n int").repartition(3) for v in
                ([(1, a, k) for k in range(9)], [(1, a, k) for k in reversed(range(9))])]
    assert simhash.keep_one(numbered[0]).collect() == simhash.keep_one(numbered[1]).collect()


def test_toxicity_of_documents_of_one_class_and_of_none(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    for rows in ([(i, f"some words {i}") for i in range(0, 40, 2)], [(i, "") for i in range(40)], [], [(99, "no label")]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        model = toxicity.fit(docs, labels)
        assert not model.weights
        got = toxicity.score(docs, model).collect()
        assert len(got) == len(rows) and all(r["score"] == pytest.approx(0.0, abs=0.02) for r in got)


def test_toxicity_fit_is_the_plain_one(spark):
    """The fitted weights are those of gradient steps over plain lists of sentences."""
    rows = [(i, f"fine words here {i % 5}. more {'bad' if i % 3 == 0 else 'good'} things. the end") for i in range(90)] + [(3, "zz repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    held = {r["doc_id"] for r in docs.where(toxicity.held_out()).collect()}
    bags = [(i % 3 == 0, [{f for p in s.split() for f in toxicity.piece_features(p)} for s in toxicity._SENTENCE.findall(t)]) for i, t in rows[:90] if i not in held]
    names = sorted(model.weights)
    size = {t: sum(y == t for y, _ in bags) for t in (True, False)}
    w, b = dict.fromkeys({f for _, d in bags for s in d for f in s}, 0.0), -5.0
    m, v, mb, vb = dict.fromkeys(w, 0.0), dict.fromkeys(w, 0.0), 0.0, 0.0
    frequent = {f for f in w if sum(any(f in s for s in d) for _, d in bags) >= 3}
    for step in range(1, toxicity.ROUNDS + 1):
        g, gb = {f: toxicity.PENALTY * w[f] for f in frequent}, 0.0
        for y, d in bags:
            logits = [b + sum(w[f] for f in s if f in frequent) for s in d]
            left = sum(np.logaddexp(0, z) for z in logits)
            slope = (size[y] / len(bags) / size[y]) * (-1 / np.expm1(max(left, 1e-9)) if y else 1.0)
            for s, z in zip(d, logits):
                gb += slope / (1 + np.exp(-z))
                for f in s & frequent:
                    g[f] += slope / (1 + np.exp(-z))
        rate = 0.2 / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
        for f in frequent:
            m[f], v[f] = 0.9 * m[f] + 0.1 * g[f], 0.99 * v[f] + 0.01 * g[f] ** 2
            w[f] -= rate * m[f] / (np.sqrt(v[f]) + 1e-9)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        b -= rate * mb / (np.sqrt(vb) + 1e-9)
    assert model.bias == pytest.approx(b, abs=0.05) and names
    assert all(model.weights[f] == pytest.approx(w[f], abs=0.05) for f in names)


def test_hot_copies_are_joined_apart(spark, monkeypatch):
    monkeypatch.setattr("contrail.llm.common.COPIES", 3)
    rows = [(i, "the very same text in many rows of the table" if i % 2 else f"another text {i} that has other words") for i in range(40)]
    docs = spark.createDataFrame([*rows, (None, rows[1][1]), (None, "alone")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in simhash.simhash_groups(docs).collect()}
    assert {(i, 1) for i in range(1, 40, 2)} <= got and (None, 1) in got
    kept = {r["doc_id"] for r in simhash.keep_one(docs).collect()}
    assert kept == {1, None, *range(0, 40, 2)}


def test_groups_of_an_empty_table(spark):
    assert simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
