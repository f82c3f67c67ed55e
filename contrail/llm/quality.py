"""Quality rules: counts of a text, and compression bands.

A text is compressed with zstandard whole and in fixed chunks.  Repetitive text compresses far better than
prose of its length and random characters far worse, so a ratio (compressed / plain bytes) has to lie
within the limits for the length.  A document also goes when more than a quarter of its bytes lie in
chunks outside the chunk limits: repeated or random passages that the whole ratio averages away.  The last part
counts as a chunk with the limits of texts of its length.

Words are runs of characters other than ASCII white space.  Null and empty texts have no words and fail the
base rule.  Repeated rows are judged each; every other column is passed on.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from contrail.llm.common import append_columns, free_name, texts_of

WINDOW = 8
CHUNK_BYTES = 4096
# Least and greatest ratio of texts below so many bytes; short frames are mostly overhead.
BANDS = ((128, 0.00, 9.00), (256, 0.35, 1.10), (512, 0.32, 0.95), (1024, 0.30, 0.82), (65_536, 0.30, 0.72), (float("inf"), 0.25, 0.70))
CHUNK_BAND = (0.20, 0.70)  # of full chunks; random letters, digits and spaces have 0.75
SYMBOLS = "#*$%&|<>"
FIELDS = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, "
          "ratio double, odd_chunks bigint, n_chunks bigint, kept boolean")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words which the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.uint64)
    if len(numbers) == len(words):
        return 0
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        hashed = hashed * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    order = np.argsort(hashed, kind="stable")
    equal = hashed[order[1:]] == hashed[order[:-1]]
    if not equal.any():
        return 0
    suspects = np.unique(np.concatenate([order[1:][equal], order[:-1][equal]]))
    windows = [ids[i : i + WINDOW].tobytes() for i in suspects.tolist()]  # equal hashes prove nothing, equal windows do
    times = Counter(windows)
    marks = np.zeros(len(words) + 1, np.int64)
    for i, w in zip(suspects.tolist(), windows):
        if times[w] > 1:
            marks[i] += 1
            marks[i + WINDOW] -= 1
    return int((np.cumsum(marks) > 0).sum())


def _band(size: int) -> tuple[float, float]:
    return next((a, b) for below, a, b in BANDS if size < below)


def _odd(chunk: bytes, pack: zstandard.ZstdCompressor) -> bool:
    """Whether a chunk's ratio lies outside its limits: those of full chunks, or of texts of its length for the last part."""
    low, high = CHUNK_BAND if len(chunk) == CHUNK_BYTES else _band(len(chunk))
    return not low <= len(pack.compress(chunk)) / len(chunk) <= high


def measure(text: str, pack: zstandard.ZstdCompressor) -> tuple:
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n_words = len(words)
    lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
    repeat = repeated_words(words)
    failed = n_words < 20 or 100 * repeat > 30 * n_words
    ratio = len(pack.compress(raw)) / len(raw) if raw else 0.0
    low, high = _band(len(raw))
    chunks = [raw[i : i + CHUNK_BYTES] for i in range(0, len(raw), CHUNK_BYTES)]
    odd = [len(c) for c in chunks if _odd(c, pack)]
    kept = not failed and low <= ratio <= high and 4 * sum(odd) <= len(raw)
    white = sum(map(text.count, " \t\n\r\x0b\x0c"))
    return (n_words, len(text) - white, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed,
            ratio, len(odd), len(chunks), kept)


def quality(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns and those of FIELDS; columns of these names are replaced."""
    types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        pack = zstandard.ZstdCompressor(level=3, write_content_size=False)
        columns = list(zip(*(measure(t, pack) for t in texts_of(batch, text)))) or [[]] * len(types)
        return [pa.array(c, t) for c, t in zip(columns, types)]

    return append_columns(df, FIELDS, run)


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, with the columns they came with."""
    verdict = free_name(df, "quality_kept")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        pack = zstandard.ZstdCompressor(level=3, write_content_size=False)
        return [pa.array([measure(t, pack)[-1] for t in texts_of(batch, text)], pa.bool_())]

    return append_columns(df, f"`{verdict}` boolean", run).where(f"`{verdict}`").drop(verdict)
