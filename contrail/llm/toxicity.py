"""Toxicity by multiple-instance learning: labels of documents train a scorer of sentences.

A sentence's score is logistic in its words (the word and its first four to six letters), a document's is
the noisy-or of its sentences: one minus the product of what each leaves.  The document labels fit the
weights through that formula, so the sentences behind a label are found without having been marked.

The model is fitted on the driver to a bounded sample: at most SAMPLE_DOCS labelled documents of each class,
in the order of a hash of their ids, none longer than SAMPLE_CHARS and of each class SAMPLE_TOTAL characters in all.
Documents whose crc32(doc_id) mod 4 is 2 are held out and never among them; only the text makes a score.  Classes are
weighted by their share of all labelled documents.  Where a class has no labels, or no labelled document is at hand,
the model is empty and every score is 0.  Of rows that repeat an id the smallest text counts.

Empty and null texts have no sentences and score 0; repeated rows are scored each.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.llm.common import append_columns, free_name, text_or_empty, texts_of

SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_TOTAL = 3000, 100_000, 12_000_000
FEATURES, ROUNDS, PENALTY = 6000, 150, 2e-6
THRESHOLD = 0.3
TABLE_PIECES = 300_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k)]


def piece_features(piece: str) -> list[str]:
    return [f for w in _WORD.findall(piece.lower()) for f in word_features(w)]


@dataclass
class Model:
    bias: float = -50.0
    weights: dict[str, float] = field(default_factory=dict)
    uid: str = field(default_factory=lambda: uuid.uuid4().hex)

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer(dict):
    """Score of a white-space piece, kept for the next time."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> float:
        get = self.model.weights.get
        value = sum(get(f, 0.0) for f in piece_features(piece))
        if len(piece) <= 48:
            if len(self) >= TABLE_PIECES:
                self.clear()
            self[piece] = value
        return value

    def sentences(self, text: str) -> list[tuple[int, int, float]]:
        """Start, end and score of each sentence."""
        out = []
        for m in _SENTENCE.finditer(text):
            logit = self.model.bias + sum(map(self.__getitem__, m.group().split()))
            out.append((m.start(), m.end(), float(1 / (1 + np.exp(-min(max(logit, -60.0), 60.0))))))
        return out

    def document(self, text: str) -> float:
        bias, get, left = self.model.bias, self.__getitem__, 0.0
        for s in _SENTENCE.findall(text):
            logit = bias + sum(map(get, s.split()))
            left += np.log1p(np.exp(min(logit, 60.0))) if logit > -30 else 0.0
        return float(-np.expm1(-left))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Train on the labelled documents that are not held out."""
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(doc_id))
    known = known.groupBy(F.col(doc_id).alias("id")).agg((F.max(label) > 0).alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return Model()
    order = [F.xxhash64("id"), F.col("id")]
    ids = known.where("toxic").orderBy(*order).limit(SAMPLE_DOCS).union(known.where("not toxic").orderBy(*order).limit(SAMPLE_DOCS))
    short = docs.select(F.col(doc_id).alias("id"), text_or_empty(text).alias("text")).where(F.length("text") <= SAMPLE_CHARS)
    sample = short.join(F.broadcast(ids), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))  # at most two times SAMPLE_DOCS ids
    so_far = F.sum(F.length("text")).over(Window.partitionBy("toxic").orderBy(*order))
    sample = sample.withColumn("chars", so_far).where(F.col("chars") <= SAMPLE_TOTAL).drop("chars")

    def bags(batch: pa.RecordBatch) -> list[pa.Array]:
        bagged = [[sorted({f for p in s.split() for f in piece_features(p)}) for s in _SENTENCE.findall(t)] for t in texts_of(batch, "text")]
        return [pa.array(bagged, pa.list_(pa.list_(pa.string())))]

    # Only features that several sampled documents have can get a weight, so the others stay on the executors.
    bagged = append_columns(sample, "bags array<array<string>>", bags).select("id", "toxic", "bags").cache()
    try:
        sizes = {r["toxic"]: r["n"] for r in bagged.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
        if len(sizes) < 2:
            return Model()
        chosen = _choose(bagged, float(sizes[True]), float(sizes[False]))
        numbers = {f: i for i, f in enumerate(chosen)}

        def numbered(batch: pa.RecordBatch) -> list[pa.Array]:
            lists = batch.column(batch.schema.get_field_index("bags")).to_pylist()
            return [pa.array([[[numbers[f] for f in s if f in numbers] for s in d] for d in lists], pa.list_(pa.list_(pa.int32())))]

        rows = append_columns(bagged, "numbers array<array<int>>", numbered).select("id", "toxic", "numbers").orderBy("id").toArrow()
    finally:
        bagged.unpersist()
    return _train(rows, chosen, totals)


def _choose(bagged: DataFrame, p: float, n: float) -> list[str]:
    """The features whose share of documents differs most between the classes (chi square)."""
    each = bagged.select("toxic", F.explode(F.array_distinct(F.flatten("bags"))).alias("f"))
    counts = each.groupBy("f").agg(F.sum(F.col("toxic").cast("double")).alias("a"), F.count("*").alias("all")).where("all >= 3")
    b = F.col("all") - F.col("a")
    cross = F.col("a") * (n - b) - b * (p - F.col("a"))
    chi = cross * cross * (p + n) / (p * n * F.col("all") * (p + n - F.col("all") + 1.0))
    return [r["f"] for r in counts.select("f", chi.alias("chi")).orderBy(F.desc("chi"), "f").limit(FEATURES).collect()]


def _train(rows: pa.Table, chosen: list[str], totals: dict[bool, int]) -> Model:
    """Gradient steps (Adam) on the weighted log-likelihood of the noisy-or."""
    rows = rows.filter(pc.greater(pc.list_value_length(rows.column("numbers")), 0))
    if not rows.num_rows or not chosen:
        return Model()
    numbers = rows.column("numbers").combine_chunks()
    inner = numbers.flatten()
    lengths, per_doc = (x.value_lengths().to_numpy(zero_copy_only=False) for x in (inner, numbers))
    features = inner.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    of_sentence, of_doc = np.repeat(np.arange(len(lengths)), lengths), np.repeat(np.arange(len(per_doc)), per_doc)
    label = rows.column("toxic").to_numpy()
    share = {t: totals[t] / sum(totals.values()) / max(1, (label == t).sum()) for t in (True, False)}
    weight = np.where(label, share[True], share[False])
    weights, bias = np.zeros(len(chosen)), -5.0
    m, v, mb, vb = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0
    for step in range(1, ROUNDS + 1):
        logit = np.clip(bias + np.bincount(of_sentence, weights[features], len(lengths)), -50, 50)
        left = np.bincount(of_doc, np.logaddexp(0, logit), len(per_doc))  # minus the log of the product
        # d loss / d left: a clean document pays left, a toxic one gains log(1 - exp(-left)).
        slope = weight * np.where(label, -1 / np.expm1(np.maximum(left, 1e-9)), 1.0)
        by_sentence = slope[of_doc] / (1 + np.exp(-logit))
        g = np.bincount(features, by_sentence[of_sentence], len(chosen)) + PENALTY * weights
        gb = by_sentence.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.2 / (1 - 0.9**step) * np.sqrt(1 - 0.99**step)
        weights -= rate * m / (np.sqrt(v) + 1e-9)
        bias -= rate * mb / (np.sqrt(vb) + 1e-9)
    return Model(float(bias), {f: float(w) for f, w in zip(chosen, weights) if abs(w) > 1e-3})


def score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """All columns and the document's score."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        rate = _scorer(sent).document
        return [pa.array([rate(t) for t in texts_of(batch, text)], pa.float64())]

    return append_columns(df, f"`{into}` double", run)


def offending_sentences(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD, into: str = "spans") -> DataFrame:
    """All columns and the sentences (start, end, score) that reach the threshold by themselves."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        find = _scorer(sent).sentences
        found = [[{"start": a, "end": b, "score": p} for a, b, p in find(t) if p >= threshold] for t in texts_of(batch, text)]
        return [pa.array(found, kind)]

    return append_columns(df, f"`{into}` array<struct<start:int,end:int,score:double>>", run)


_SCORERS: dict[str, Scorer] = {}


def _scorer(sent) -> Scorer:
    """One scorer for a broadcast model in a worker."""
    model = sent.value
    if model.uid not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[model.uid] = model.scorer()
    return _SCORERS[model.uid]


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows below the threshold, with the columns they came with."""
    name = free_name(docs, "toxicity")
    return score(docs, model, text, name).where(F.col(name) < THRESHOLD).drop(name)
