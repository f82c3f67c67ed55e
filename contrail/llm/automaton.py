"""BPE as a deterministic automaton over tokens, compiled merge by merge.

State 0 is the start and has an arc for every base symbol.  The gadget of a merge (u, v) -> w

* gives every state with an arc u an arc w, which leads where v led (no gadget if no v can follow u);
* moves all arcs u to a new state: a copy of the old target without the arc v.

A token sequence is accepted exactly when it is the sequence that the merges produce, so a word has
one accepted path and encoding is following arcs.  A state is stored as its difference from the state
it copied (parent, lost arc, time), which makes the compiled automaton linear in the merges; arcs that
have been looked at are kept in one transition table keyed by (state, token).

See Berglund, Martens and van der Merwe, "Constructing a BPE Tokenization DFA" (2024).

Nulls are empty texts, empty texts have no ids and decode to an empty text, repeated rows are encoded
each, and other columns are passed through unless they have the name of an added one, which is then
replaced.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from contrail.llm.common import append_columns, texts_of
from contrail.llm.pieces import EXOTIC, PieceTable

DEAD, NEVER = -1, -2
TABLE_ARCS, TABLE_WORDS = 600_000, 100_000  # a worker's tables: about 100 and 20 MB


class MergeAutomaton:
    """The compiled merges: states, arcs and the labels of arcs."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = ""):
        self.end = end
        self.labels = {i: t for t, i in vocab.items()}
        size = max(self.labels, default=-1) + 1
        self.size = size
        self.target = [0] * size  # state that all arcs of a token lead to
        self.made = [-1] * size  # merge that made a token; -1: base symbol
        for a, b in merges:
            self.made[vocab[a + b]] = NEVER
        self.left = [-1] * size
        self.parent, self.lost, self.born = [-1], [-1], [-1]
        for time, (a, b) in enumerate(merges):
            self._gadget(time, vocab[a], vocab[b], vocab[a + b])
        self.inner = {t: i for t, i in vocab.items() if not end or not t.endswith(end)}
        self.final = {t[: len(t) - len(end)]: i for t, i in vocab.items() if t.endswith(end)} if end else self.inner
        self.longest = max((len(t) for t in (*self.inner, *self.final)), default=1)
        self.arcs: dict[int, int] = {}

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        if self.made[w] != NEVER or not self._has(self.target[u], v):
            return
        self.made[w], self.left[w], self.target[w] = time, u, self.target[v]
        self.parent.append(self.target[u])
        self.lost.append(v)
        self.born.append(time)
        self.target[u] = len(self.parent) - 1

    def step(self, state: int, token: int) -> int:
        """State after an arc, DEAD where the state has no such arc."""
        key = state * self.size + token
        to = self.arcs.get(key)
        if to is None:
            if len(self.arcs) >= TABLE_ARCS:
                self.arcs.clear()
            to = self.arcs[key] = self.target[token] if self._has(state, token) else DEAD
        return to

    def _has(self, state: int, token: int) -> bool:
        parent, lost, born = self.parent, self.lost, self.born
        while True:
            made = self.made[token]
            if made == NEVER:
                return False
            while born[state] > made:  # a copy has the arc unless this state or one between lost it
                if lost[state] == token:
                    return False
                state = parent[state]
            if made < 0:
                return True
            token = self.left[token]  # the state was there when the token came: it got the arc with this one

    def word(self, word: str) -> list[int]:
        """Labels of the one accepted path through a pre-split word."""
        n = len(word)
        token = self.final.get(word)
        if token is not None and self.step(0, token) >= 0:
            return [token]
        inner, final, longest, arcs, size = self.inner, self.final, self.longest, self.arcs, self.size
        path: list[tuple[int, int, int, int]] = []
        closed = bytearray(n + 1)  # no path leads on from here; each place has one state that can reach it
        at, state, far = 0, 0, n
        while at < n:
            for stop in range(min(far, at + longest), at, -1):
                if closed[stop]:
                    continue
                token = final.get(word[at:]) if stop == n else inner.get(word[at:stop])
                if token is None:
                    continue
                to = arcs.get(state * size + token)
                if to is None:
                    to = self.step(state, token)
                if to >= 0:
                    path.append((at, state, token, stop))
                    at, state, far = stop, to, n
                    break
            else:
                closed[at] = 1
                if not path:
                    raise ValueError(f"no token sequence spells {word!r}")
                at, state, _, stop = path.pop()
                far = stop - 1
        return [p[2] for p in path]


class AutomatonTokenizer:
    """Whole texts: special strings, normalisation and pre-split as the tokenizer file says, then the automaton."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.library = Tokenizer.from_file(path)  # normaliser and pre-splitter only
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: t for t, i in self.special.items()}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(self._pattern(spec))
        self.byte_chars = _byte_chars()
        self.label_array = np.array([self.labels.get(i) for i in range(max(self.labels) + 1)], dtype=object)
        self.gaps = any(x is None for x in self.label_array)
        self.words: dict[str, list[int]] = {}
        self.table = PieceTable(lambda many, _: [np.asarray(self._piece(p), "<i4").tobytes() for p in many], spaced=False)

    @staticmethod
    def _pattern(spec: dict) -> str:
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        for s in steps:
            if s["type"] == "Split" and s["invert"] and s["behavior"] == "Removed":
                return s["pattern"]["Regex"]
        raise ValueError("the tokenizer has to split words by a pattern and drop what is between them")

    def _piece(self, piece: str) -> list[int]:
        if self.special_split is None or "<" not in piece:
            return self._plain(piece)
        out: list[int] = []
        for part in self.special_split.split(piece):
            out += [self.special[part]] if part in self.special else self._plain(part)
        return out

    def _plain(self, text: str) -> list[int]:
        if EXOTIC.search(text):
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]
        else:
            words = self.pattern.findall(text.lower())
            if not text.isascii():
                words = [w.encode().decode("latin-1").translate(self.byte_chars) for w in words]
            elif not text.isprintable():
                words = [w.translate(self.byte_chars) for w in words]
        out: list[int] = []
        for w in words:
            ids = self.words.get(w)
            if ids is None:
                ids = self.automaton.word(w)
                if len(w) <= 32:
                    if len(self.words) >= TABLE_WORDS:
                        self.words.clear()
                    self.words[w] = ids
            out += ids
        return out

    def _whole(self, text: str) -> bytes:
        """A text with separators that only Python takes for white space."""
        return np.asarray([i for p in re.split(_WHITE, text) if p for i in self._piece(p)], "<i4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.table.encode(texts, self._whole)

    def decode(self, ids: np.ndarray) -> str:
        """Labels of the arcs in order; ids without an arc are passed over, as the library does."""
        labels = self.label_array[ids[(ids >= 0) & (ids < len(self.label_array))]].tolist()
        return " ".join([x for x in labels if x is not None] if self.gaps else labels)


# White space as tokenizer patterns define it.
_WHITE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"


def _byte_chars() -> dict[int, str]:
    """Printable stand-ins of bytes: printable Latin-1 characters stand for themselves, others follow from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


@lru_cache(maxsize=2)
def automaton_tokenizer(path: str) -> AutomatonTokenizer:
    return AutomatonTokenizer(path)


def bpe_encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns and ``ids`` (array of int) of every whole text."""

    def encode(batch: pa.RecordBatch) -> list[pa.Array]:
        encoded = automaton_tokenizer(tokenizer).encode(texts_of(batch, text))
        ends = np.cumsum([0, *(len(b) // 4 for b in encoded)], dtype=np.int64).astype(np.int32)
        values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(encoded))])
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)]

    return append_columns(df, f"`{ids}` array<int>", encode)


def bpe_decode(df: DataFrame, tokenizer: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """All columns and ``decoded``, the text that the ids spell; null ids are none."""

    def decode(batch: pa.RecordBatch) -> list[pa.Array]:
        tok, lists = automaton_tokenizer(tokenizer), batch.column(batch.schema.get_field_index(ids))
        flat = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        ends = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).cumsum()
        return [pa.array([tok.decode(part) for part in np.split(flat, ends[:-1])] if len(ends) else [], pa.string())]

    return append_columns(df, f"`{decoded}` string", decode)
