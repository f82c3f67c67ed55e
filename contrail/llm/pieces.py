"""Encoding of whole texts through a per-worker table of white-space pieces.

Neither tokenizer lets a token cross a boundary between two pieces, so the ids of a text are the ids
of its pieces in order.  A worker encodes each new piece once, in bulk, and keeps a bounded table.
Texts in which white space itself makes tokens are given to the tokenizer whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain, islice

import numpy as np
from tokenizers import Tokenizer

# Pieces a worker keeps (about 160 MB) and the longest of them in characters.
TABLE_PIECES, PIECE_CHARS = 800_000, 48

# Punctuation that may follow a word in a piece; it makes tokens of its own.
_TAIL = ".,;:!?"
# Up to here composition does nothing and letter classes are settled; lower case is letter by letter but for those found here.
_PLAIN_END = 0x24F
_UNEVEN = [c for c in map(chr, range(_PLAIN_END + 1)) if len(c.lower()) != 1 or c.lower().isalpha() != c.isalpha()]
EXOTIC = re.compile(f"[^\x00-{chr(_PLAIN_END)}]|[{''.join(map(re.escape, _UNEVEN))}]")
# str.split() also splits at these, the tokenizers don't.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class PieceTable:
    """Ids (as bytes) of pieces by a bulk function that gets pieces and the space before them, if any."""

    def __init__(self, encode_many: Callable[[list[str], str], list[bytes]], spaced: bool):
        self.encode_many, self.spaced = encode_many, spaced
        self.first: dict[str, bytes | None] = {}  # pieces at the start of a text
        self.rest: dict[str, bytes | None] = {}  # pieces after a space
        self.tails: dict[str, bytes] = {}
        self.long: list[tuple[dict, str]] = []  # pieces that go after the batch

    def split(self, text: str) -> list[str] | None:
        """Pieces of a text; None where it has to be encoded whole."""
        if self.spaced:
            return text.split(" ")
        return None if _SEPARATORS.search(text) else text.split()

    def learn(self, texts: list[list[str] | None]) -> None:
        if self.spaced:
            self._add(self.first, {t[0] for t in texts if t}, "")
            self._add(self.rest, set(chain.from_iterable(t[1:] for t in texts if t)), " ")
        else:
            self._add(self.rest, set(chain.from_iterable(t for t in texts if t)), "")

    def _add(self, table: dict, pieces: set[str], lead: str) -> None:
        new = pieces.difference(table)
        if self.spaced:  # white space at a boundary belongs to its neighbours
            for p in [p for p in new if not p or p[0].isspace() or p[-1].isspace()]:
                table[p] = None
                new.discard(p)
        self.long += [(table, p) for p in new if len(p) > PIECE_CHARS]
        split = {p: w for p in new if (w := p.rstrip(_TAIL)) is not p and w.isalpha() and not EXOTIC.search(w)}
        new.difference_update(split)
        new.update(w for w in split.values() if w not in table)
        for i in range(0, len(whole := list(new)), 20_000):
            part = whole[i : i + 20_000]
            table.update(zip(part, self.encode_many(part, lead)))
        for p, w in split.items():
            tail = p[len(w) :]
            if tail not in self.tails:
                if len(self.tails) > 10_000:
                    self.tails.clear()
                self.tails[tail] = self.encode_many([tail], "")[0]
            table[p] = table[w] + self.tails[tail]

    def forget(self) -> None:
        """Keep the tables bounded; called between batches."""
        for table, p in self.long:
            table.pop(p, None)
        self.long = []
        for name in ("first", "rest"):
            table = getattr(self, name)
            if len(table) > TABLE_PIECES:  # frequent pieces come early, so the older half stays
                setattr(self, name, dict(islice(table.items(), TABLE_PIECES // 2)))

    def encode(self, texts: list[str], whole: Callable[[str], bytes]) -> list[bytes]:
        """Ids of each text; ``whole(text)`` where pieces can't be used."""
        lists = [self.split(t) for t in texts]
        self.learn(lists)
        get, out = self.rest.__getitem__, []
        for text, parts in zip(texts, lists):
            try:
                if parts is None:
                    raise TypeError
                out.append(self.first[parts[0]] + b"".join(map(get, parts[1:])) if self.spaced else b"".join(map(get, parts)))
            except TypeError:  # a None among the values
                out.append(whole(text))
        self.forget()
        return out


class TextEncoder:
    """Ids of whole texts exactly as the tokenizers library gives them, without added special tokens."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        probe = self.tokenizer.encode("a a", add_special_tokens=False).ids
        self.spaced = probe[0] != probe[-1]  # a space is part of the token after it
        # Tokens that begin (spaced) or end a word: they tell the words of a joined text apart.
        mark = self.tokenizer.id_to_token(probe[-1])[0 if self.spaced else 1 :]
        names = {i: t for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.edge = np.array([names.get(i, "").startswith(mark[0]) if self.spaced else names.get(i, "").endswith(mark)
                              for i in range(max(names) + 2)])
        self.table = PieceTable(self._many, self.spaced)

    def _one(self, text: str) -> bytes:
        return _raw(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids)

    def _many(self, pieces: list[str], lead: str) -> list[bytes]:
        out: dict[str, bytes] = {}
        if lead or not self.spaced:  # words are encoded joined by spaces, and the ids are cut at word edges
            words = [p for p in pieces if p.isalpha()]
            groups = [words[i : i + 500] for i in range(0, len(words), 500)]
            joined = self.tokenizer.encode_batch_fast([" " + " ".join(g) for g in groups], add_special_tokens=False)
            for group, encoded in zip(groups, joined):
                ids = np.asarray(encoded.ids, "<u4")
                at = np.flatnonzero(self.edge[np.minimum(ids, len(self.edge) - 1)])
                if len(at) == len(group):
                    at, raw = at * 4 if self.spaced else at * 4 + 4, ids.tobytes()
                    cuts = [*at.tolist(), len(raw)] if self.spaced else [0, *at.tolist()]
                    out.update((w, raw[a:b]) for w, a, b in zip(group, cuts, cuts[1:]))
        left = [p for p in pieces if p not in out]
        encoded = self.tokenizer.encode_batch_fast([lead + p for p in left], add_special_tokens=False)
        out.update((p, _raw(e.ids)) for p, e in zip(left, encoded))
        return [out[p] for p in pieces]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return self.table.encode(texts, self._one)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(b) // 4 for b in self.ids(texts)]


def _raw(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


@lru_cache(maxsize=2)
def text_encoder(path: str) -> TextEncoder:
    """One encoder for each tokenizer file in a worker; its table outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return TextEncoder(path)
