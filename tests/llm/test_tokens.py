import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from contrail.llm import automaton, id_files, packing, token_counts
from contrail.llm.pieces import PieceTable, TextEncoder, text_encoder
from contrail.llm.queries import op1_bpe_automaton, op3_token_counts, op4_best_fit_packing, op7_id_files
from tests.llm.helpers import TEXTS, documents, table

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [t or "" for _, t in TEXTS] + ["foo  <|endoftext|>", " lead", "a\n\nb", "\n", "x\u2003y", "''''s's't''ll", "don't I'LL 'S", "é x\u0301,", "ab " * 50 + "\n", "ALİ. gel", "İ! İ, Aİ? 9İ."]


def _random_texts(n: int) -> list[str]:
    r = random.Random(5)
    alphabet = "aabcdefgtheino  \n.,'é<|ßñ中12\t"
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_text_encoder_is_the_library(path):
    lib, own = Tokenizer.from_file(path), TextEncoder(path)
    texts = ODD + _random_texts(400)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # cold and warm tables
        assert [np.frombuffer(b, "<u4").tolist() for b in own.ids(texts)] == want
    assert own.counts(texts) == [len(w) for w in want]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_each_character_beside_each_mark_is_as_in_the_library(path):
    """Every code point up to U+024F before, after and between letters, next to each mark that pieces are cut at."""
    lib, r = Tokenizer.from_file(path), random.Random(7)
    texts = [f"{lead}{chr(c)}{tail}{mark} {mark}{chr(c)}" for c in range(0x250) for mark in ".,;:!?" for lead, tail in (("", ""), ("aB", ""), ("", "Ab"))]
    r.shuffle(texts)
    own = [TextEncoder(path).ids(texts)] + ([automaton.AutomatonTokenizer(path).encode(texts)] if path == WORD else [])
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for got in own:
        assert [np.frombuffer(b, "<u4").tolist() for b in got] == want


def test_piece_table_stays_bounded(monkeypatch):
    monkeypatch.setattr("contrail.llm.pieces.TABLE_PIECES", 50)
    table = PieceTable(lambda many, lead: [p.encode() for p in many], spaced=False)
    for i in range(40):
        text = " ".join(f"w{i}x{j}" for j in range(20)) + " " + "z" * 100
        assert table.encode([text], str.encode) == [text.replace(" ", "").encode()]
    assert len(table.rest) <= 50 and not any(len(p) > 48 for p in table.rest)


def test_automaton_is_the_library():
    lib, own = Tokenizer.from_file(WORD), automaton.AutomatonTokenizer(WORD)
    texts = ODD + _random_texts(400)
    for t, raw in zip(texts, own.encode(texts)):
        want = lib.encode(t, add_special_tokens=False).ids
        ids = np.frombuffer(raw, "<i4")
        assert ids.tolist() == want
        assert own.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_gadgets_against_merging():
    """Any merge list: the accepted path is what applying the merges in order gives."""
    r = random.Random(3)
    for _ in range(60):
        vocab, merges = {c: i for i, c in enumerate("abc")}, []
        while len(merges) < 12:
            a, b = r.choice(list(vocab)), r.choice(list(vocab))
            if a + b not in vocab:
                merges.append((a, b))
                vocab[a + b] = len(vocab)
        auto = automaton.MergeAutomaton(vocab, merges)
        for _ in range(30):
            word = "".join(r.choice("abc") for _ in range(r.randrange(1, 14)))
            tokens = list(word)
            for a, b in merges:
                i = 0
                while i < len(tokens) - 1:
                    if tokens[i] == a and tokens[i + 1] == b:
                        tokens[i : i + 2] = [a + b]
                    i += 1
            assert auto.word(word) == [vocab[t] for t in tokens]


def test_op1(spark, tmp_path):
    rows = op1_bpe_automaton(spark, table(tmp_path, "documents", documents(spark))).collect()
    lib = Tokenizer.from_file(WORD)
    want = []
    for key, t in TEXTS:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((key, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_bpe_keeps_other_columns(spark):
    coded = automaton.bpe_decode(automaton.bpe_encode(documents(spark), WORD), WORD)
    assert set(documents(spark).columns) < set(coded.columns)
    assert coded.where("doc_id = 6").first()["decoded"] == "one</w> two</w> three</w> four</w>"
    assert automaton.bpe_encode(documents(spark, []), WORD).count() == 0


def test_op3_and_the_cache(spark, tmp_path):
    rows = op3_token_counts(spark, table(tmp_path, "documents", documents(spark))).collect()
    lib = Tokenizer.from_file(BYTE)
    n = {t: len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in TEXTS}
    assert sorted(map(tuple, rows), key=repr) == sorted(((i, len((t or "").encode()), n[t], n[t] > 512) for i, t in TEXTS), key=repr)
    cache, docs = str(tmp_path / "cache"), documents(spark)
    first = sorted(token_counts.count_tokens(docs, BYTE, cache).collect(), key=repr)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t in TEXTS})
    more = docs.unionByName(documents(spark, [(99, "a new text")]))
    again = token_counts.count_tokens(more, BYTE, cache).collect()
    assert spark.read.parquet(cache).count() == stored.count() + 1  # only the miss was encoded
    assert sorted((r for r in again if r["doc_id"] != 99), key=repr) == first
    token_counts.count_tokens(docs, WORD, cache)  # another tokenizer shares nothing
    assert spark.read.parquet(cache).groupBy("tokenizer").count().count() == 2
    assert token_counts.count_tokens(documents(spark, []), BYTE, str(tmp_path / "none")).count() == 0


def _check_packing(rows, ids_of, capacity=1024):
    bins, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for content in bins.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= capacity
    for key, copies in ids_of.items():
        got = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces[key])
        want = []
        for ids in copies:
            cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
            want += [(k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert got == sorted(want)
    return len(bins)


def test_op4(spark, tmp_path):
    rows = op4_best_fit_packing(spark, table(tmp_path, "documents", documents(spark))).collect()
    lib, ids_of = Tokenizer.from_file(BYTE), defaultdict(list)
    for key, t in TEXTS:
        ids_of[key].append(lib.encode(t or "", add_special_tokens=False).ids + [2])
    _check_packing(rows, ids_of)
    assert packing.pack(documents(spark, []), BYTE).count() == 0
    assert "ids" in packing.pack(documents(spark), BYTE).columns


def test_plans_fill_bins():
    r = random.Random(1)
    for _ in range(300):
        capacity = r.choice([12, 30, 100])
        counts = {r.randrange(1, capacity + 1): r.randrange(1, 60) for _ in range(r.randrange(1, 20))}
        runs, n = packing.plan_bins(counts, capacity)
        bins = defaultdict(list)
        for length, first, pieces, bin0, each, offset in runs:
            for k in range(pieces):
                bins[bin0 + k // each].append((offset + k % each * length, length))
        for content in bins.values():
            at = 0
            for offset, length in sorted(content):
                assert offset == at
                at += length
            assert at <= capacity
        total = sum(k * v for k, v in counts.items())
        assert sum(len(b) for b in bins.values()) == sum(counts.values()) and len(bins) == n
        large = sum(v for k, v in counts.items() if 2 * k > capacity)
        assert max(large, -(-total // capacity)) <= n <= max(large, 1.7 * total / capacity + 1)


def test_large_items_are_matched_best():
    # 7 pairs only with 5, so a bin each of 7 + 5 and 6 + 6 is the fewest.
    assert packing.plan_bins({7: 1, 6: 2, 5: 1}, 12)[1] == 2


def test_op7(spark, tmp_path):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    got = op7_id_files(spark, table(tmp_path, "documents", documents(spark, rows))).collect()
    lib, start, want = Tokenizer.from_file(WORD), 0, []
    for key, t in sorted(rows, key=lambda r: r[0]):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got)) == sorted(want)


def test_id_files_edges(spark):
    assert id_files.round_trip(documents(spark, []), WORD).count() == 0
    got = id_files.round_trip(documents(spark, TEXTS), WORD).collect()
    assert len(got) == len(TEXTS) and [r["start"] for r in got if r["doc_id"] is None] == [0]  # nulls lie first
    hot = id_files.round_trip(documents(spark, [(5, f"copy {k % 3}") for k in range(300)] + [(1, "a"), (9, "b")]), WORD).collect()
    spans = sorted((r["start"], r["start"] + r["n_tokens"], r["doc_id"]) for r in hot)
    assert len(hot) == 302 and all(a[1] == b[0] and a[2] <= b[2] for a, b in zip(spans, spans[1:]))


def test_elias_fano():
    r = np.random.default_rng(2)
    for values in ([], [0], [7], [0, 0, 0], [5] * 200, np.cumsum(r.integers(0, 900, 1000)), np.cumsum(r.integers(0, 2, 5000)), [3, 10**9]):
        values = np.array(values, np.int64)
        built = id_files.EliasFano.build(values)
        read, rest = id_files.EliasFano.from_bytes(built.to_bytes() + b"rest")
        assert rest == b"rest" and read.values().tolist() == values.tolist()
        assert [read.select(k) for k in range(len(values))] == values.tolist()
        for first in range(0, len(values) + 2, 1 + len(values) // 40):
            for last in (first, first + 1, first + 63, first + 500):
                assert read.values(first, last).tolist() == values[first:last].tolist()
    many = np.cumsum(r.integers(1, 1000, 20_000))
    assert len(id_files.EliasFano.build(many).to_bytes()) < 20_000 * (2 + np.log2(500) + 1) / 8 + 2000


def test_id_file_random_access(tmp_path):
    docs = [(None, [9]), (3, [1, 2]), (3, []), (8, list(range(300)))]
    name = tmp_path / "x.ids"
    with open(name, "wb") as f:
        assert id_files.write_file(f, ((k, np.array(v, "<u2").tobytes()) for k, v in docs), 2) == (4, 303)
    with open(name, "rb") as f:
        file = id_files.IdFile(f, name.stat().st_size)
        assert [(file.doc_id(k), file.ids(*file.span(k)).tolist()) for k in range(len(file))] == docs
        assert all(file.doc_ids(a, b) == [k for k, _ in docs[a:b]] for a in range(5) for b in range(a, 5))
        with pytest.raises(ValueError):
            id_files.IdFile(f, name.stat().st_size - 1)


def test_encoder_is_shared():
    assert text_encoder(BYTE) is text_encoder(BYTE)
