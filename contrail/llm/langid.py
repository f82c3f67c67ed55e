"""Language of a text by a byte convolutional network, trained in numpy.

A text is cut into windows of WINDOW bytes that overlap by the widest filter, so every run of bytes is seen; the
last one is padded.  In a window, filters of several widths run over the embedded bytes, each keeps its greatest value
(max pooling), and a softmax turns these into probabilities.  A text's probabilities are the means over its windows,
weighted by their bytes; its language is the likeliest, of equals the first in order.

The network is fitted on the driver to a bounded sample: at most SAMPLE_DOCS distinct labelled texts of each language, those with
the smallest hashes, at most SAMPLE_WINDOWS windows of each, spread over the whole text.  Some are shortened, so that short
texts are known too.  Documents whose crc32(doc_id) mod 4 is 2 are held out, as are those without a
language or a letter; only bytes make a prediction.  Of one language the network always answers that.

A null text, a text without a letter, and any text where nothing could be learned is ``und`` with score 0.  Repeated
rows are predicted each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.llm.common import append_columns, column_values, free_name, map_batches

SAMPLE_DOCS, SAMPLE_WINDOWS = 300, 4
WINDOW, WIDTHS, FILTERS, EMBEDDED = 256, (2, 3, 4, 5), 16, 8
ROUNDS, BATCH, RATE = 8, 64, 4e-3
CHUNK = 128  # windows computed at a time
PAD, UNKNOWN = 256, "und"
WIDEST = max(WIDTHS)
STRIDE = WINDOW - WIDEST + 1


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The windows of a text as rows of byte numbers (PAD beyond the end), and the bytes that each adds."""
    size = len(text)
    n = max(1, -(-(size - WIDEST + 1) // STRIDE))
    padded = np.full((n - 1) * STRIDE + WINDOW, PAD, np.int16)
    padded[:size] = np.frombuffer(text, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::STRIDE]
    weight = np.full(n, STRIDE, np.float64)
    weight[-1] = max(size - (n - 1) * STRIDE, 1)
    return rows, weight


@dataclass
class Network:
    """Embedding of bytes, filters (WIDEST x EMBEDDED inputs, zero beyond a filter's width) and the last layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    last: np.ndarray
    last_bias: np.ndarray
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Greatest value of each filter in each window, where it was, and the embedded inputs."""
        embedded = self.embedding[rows]
        view = np.lib.stride_tricks.sliding_window_view(embedded, WIDEST, axis=1).transpose(0, 1, 3, 2)
        inputs = view.reshape(len(rows), STRIDE, WIDEST * EMBEDDED)
        values = inputs.reshape(-1, WIDEST * EMBEDDED) @ self.filters
        values = values.reshape(len(rows), STRIDE, -1)
        at = values.argmax(axis=1)
        return np.take_along_axis(values, at[:, None, :], axis=1)[:, 0] + self.bias, at, inputs

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.languages)))
        for i in range(0, len(rows), CHUNK):
            part = rows[i : i + CHUNK]
            embedded = self.embedding[part]
            view = np.lib.stride_tricks.sliding_window_view(embedded, WIDEST, axis=1).transpose(0, 1, 3, 2)
            values = view.reshape(-1, WIDEST * EMBEDDED) @ self.filters
            pooled = values.reshape(len(part), STRIDE, -1).max(axis=1) + self.bias
            out[i : i + CHUNK] = softmax(np.maximum(pooled, 0) @ self.last + self.last_bias)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: np.ndarray, labels: np.ndarray, languages: list[str], seed: int = 1) -> Network:
    """Gradient steps (Adam) on the cross entropy; languages weigh alike."""
    rng, kinds = np.random.default_rng(seed), len(WIDTHS) * FILTERS
    mask = np.concatenate([np.repeat((np.arange(WIDEST) < w).astype(np.float32), EMBEDDED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
    net = Network(languages, rng.normal(0, 0.5, (PAD + 1, EMBEDDED)).astype(np.float32), (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
                  np.zeros(kinds, np.float32), rng.normal(0, 0.1, (kinds, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32))
    net.embedding[PAD] = 0
    names = ("embedding", "filters", "bias", "last", "last_bias")
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in names}
    weight = 1.0 / np.maximum(np.bincount(labels, minlength=len(languages)), 1)[labels]
    weight *= len(labels) / weight.sum()
    step, steps = 0, ROUNDS * -(-len(rows) // BATCH)
    for _ in range(ROUNDS):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            x, y = rows[pick], labels[pick]
            pooled, at, inputs = net.pooled(x)
            hidden = np.maximum(pooled, 0)
            p = softmax(hidden @ net.last + net.last_bias)
            p[np.arange(len(y)), y] -= 1
            p *= (weight[pick] / len(y))[:, None]
            back = (p @ net.last.T) * (pooled > 0)
            chosen = inputs[np.arange(len(y))[:, None], at]  # (window, filter, input): pooling passes a slope to one place
            into = (back[:, :, None] * net.filters.T[None]).reshape(len(y), kinds, WIDEST, EMBEDDED)
            places = at[:, :, None] + np.arange(WIDEST)
            grads = {"last": hidden.T @ p, "last_bias": p.sum(0), "bias": back.sum(0), "filters": np.einsum("wf,wfi->if", back, chosen) * mask,
                     "embedding": np.zeros_like(net.embedding)}
            np.add.at(grads["embedding"], x[np.arange(len(y))[:, None, None], places].reshape(-1), into.reshape(-1, EMBEDDED))
            grads["embedding"][PAD] = 0
            step += 1
            rate = RATE * (1 - 0.9 * step / steps) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for n, g in grads.items():
                m, v = moments[n]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                getattr(net, n)[...] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def _has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Network | None:
    """Train on the labelled documents that are not held out; None where there are none."""
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out(doc_id))
    known = known.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    # Hashes are even, so a share of them holds about eight times the sample; only these rows are shuffled.
    share = F.least(F.lit(1.0), F.lit(8.0 * SAMPLE_DOCS) / F.col("n"))
    low = F.pmod(F.col("hash"), F.lit(1 << 30)) < share * (1 << 30)
    near = known.join(F.broadcast(sizes), "lang").where(low).select("lang", "hash", "text")  # a row for each language

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, h, t in zip(*(column_values(batch, c) for c in ("lang", "hash", "text"))):
                if _has_letter(t):
                    all_windows, _ = windows(t.encode("utf-8", "replace"))
                    at = np.unique(np.linspace(0, len(all_windows) - 1, SAMPLE_WINDOWS).astype(int))
                    rows.append((name, h, [all_windows[i].astype("<i2").tobytes() for i in at]))
            columns = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.list_(pa.binary())))], names=["lang", "hash", "w"])

    parts = map_batches(near, cut, "lang string, hash bigint, w array<binary>").groupBy("lang", "hash").agg(F.min("w").alias("w"))
    order = Window.partitionBy("lang").orderBy("hash")
    sample = parts.withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE_DOCS).orderBy("lang", "k").select("lang", "w").toArrow()
    if not sample.num_rows:
        return None
    names, lists = sample.column("lang").to_pylist(), sample.column("w").to_pylist()
    languages = sorted(set(names))
    rows = np.stack([np.frombuffer(w, "<i2") for ws in lists for w in ws])
    labels = np.repeat([languages.index(n) for n in names], [len(ws) for ws in lists])
    # Half of the windows come once more, cut to a random length.
    rng = np.random.default_rng(0)
    short = rows[::2].copy()
    short[np.arange(WINDOW)[None] >= rng.integers(8, 96, len(short))[:, None]] = PAD
    return train(np.concatenate([rows, short]), np.concatenate([labels, labels[::2]]), languages)


_NETWORKS: dict[str, Network] = {}


def identify(df: DataFrame, network: Network | None, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns, the language and its probability."""
    if network is None:
        return df.select(*[c for c in df.columns if c not in into], F.lit(UNKNOWN).alias(into[0]), F.lit(0.0).alias(into[1]))
    sent = df.sparkSession.sparkContext.broadcast(network)  # a few thousand weights and the names of the languages

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        net = sent.value
        texts = column_values(batch, text)
        names: list[str] = [UNKNOWN] * len(texts)
        scores = np.zeros(len(texts))
        group: list[tuple[int, np.ndarray, np.ndarray]] = []

        def answer() -> None:
            p = net.probabilities(np.concatenate([w for _, w, _ in group]))
            start = 0
            for i, w, weight in group:
                mean = weight @ p[start : start + len(w)] / weight.sum()
                start += len(w)
                names[i], scores[i] = net.languages[best := int(mean.argmax())], min(float(mean[best]), 1.0)
            group.clear()

        held = 0
        for i, t in enumerate(texts):
            if t is None or not _has_letter(t):
                continue
            group.append((i, *windows(t.encode("utf-8", "replace"))))
            held += len(group[-1][1])
            if held >= CHUNK:
                answer()
                held = 0
        if group:
            answer()
        return [pa.array(names, pa.string()), pa.array(scores)]

    return append_columns(df, f"`{into[0]}` string, `{into[1]}` double", run)


def keep_language(docs: DataFrame, network: Network | None, language: str, text: str = "text") -> DataFrame:
    """The rows of one language, with the columns they came with."""
    names = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    return identify(docs, network, text, names).where(F.col(names[0]) == language).drop(*names)
