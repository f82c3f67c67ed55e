"""Packing token sequences into as few bins as possible: large-item matching, then best fit.

All that a plan depends on is how many pieces have each length, so the plan is made from that histogram
(at most ``capacity`` rows, however large the corpus):

* pieces above a third of the capacity meet at most twice in a bin: each, from the longest down, is
  matched with the longest that still fits beside it;
* shorter pieces, from the longest down, go to the smallest gap that holds them, then to new bins.

Bins with the same content are planned together, so the plan is a bounded list of runs "the next n pieces
of length l go to bins b, b+1, ... at offset o".  A piece's place follows from its number among the pieces
of its length: its number within its task plus the count of the tasks before.  Neither a hot length nor
the pieces themselves ever meet in one task.

Null and empty texts are one end token; repeated rows are packed each; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from contrail.llm.common import column_values, map_batches, materialise, text_or_empty
from contrail.llm.pieces import text_encoder

Run = tuple[int, int, int, int, int, int]  # length, first number, pieces, first bin, pieces of this length in a bin, offset


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Runs of a packing of ``counts`` (pieces by length), and the number of bins."""
    left = {n: c for n, c in counts.items() if c > 0}
    bins: list[list] = []  # bins of equal content: how many, and (length, copies) in order
    gaps: list[tuple[int, int]] = []  # (gap, index in bins)

    def open_bins(number: int, content: list[tuple[int, int]], gap: int) -> None:
        bins.append([number, content])
        if gap:
            heappush(by_gap.setdefault(gap, []), len(bins) - 1)

    by_gap: dict[int, list[int]] = {}
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and left[m] - (m == n) > 0), None)
            if mate is None:
                open_bins(left[n], [(n, 1)], capacity - n)
                left[n] = 0
            elif mate == n:
                open_bins(left[n] // 2, [(n, 2)], capacity - 2 * n)
                left[n] %= 2
            else:
                both = min(left[n], left[mate])
                open_bins(both, [(n, 1), (mate, 1)], capacity - n - mate)
                left[n] -= both
                left[mate] -= both
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            gap = min((g for g, at in by_gap.items() if g >= n and at), default=None)
            if gap is None:
                each = min(capacity // n, left[n])
                open_bins(left[n] // each, [(n, each)], capacity - each * n)
                left[n] %= each
                continue
            k = heappop(by_gap[gap])
            number, content = bins[k]
            each = min(gap // n, left[n])
            filled = min(number, left[n] // each)
            left[n] -= filled * each
            bins[k] = [filled, [*content, (n, each)]]
            if gap - each * n:
                heappush(by_gap.setdefault(gap - each * n, []), k)
            if number > filled:
                open_bins(number - filled, content, gap)
    runs, used, first = [], dict.fromkeys(counts, 0), 0
    for number, content in bins:
        offset = 0
        for n, each in content:
            runs.append((n, used[n], number * each, first, each, offset))
            used[n] += number * each
            offset += n * each
        first += number
    return sorted(runs), first


def encode_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian 32-bit), task, number (of its length within the task).

    A document longer than the capacity is cut from its end into full pieces; its first piece is what is over.
    """
    kept = docs.select(F.col(doc_id).alias("doc_id"), text_or_empty(text).alias("text"))
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = text_encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, rows = column_values(batch, "doc_id"), []
            for key, raw in zip(ids, encoder.ids(column_values(batch, "text"))):
                raw += end
                n = len(raw) // 4
                cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((key, piece, a, b - a, raw[4 * a : 4 * b], task, int(seen[b - a])))
                    seen[b - a] += 1
            columns = list(zip(*rows)) or [[]] * 7
            types = (batch.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["doc_id", "piece", "start", "length", "ids", "task", "number"])

    kind = kept.schema["doc_id"].dataType.simpleString()
    return map_batches(kept, run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, task int, number bigint")


def place_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """The columns of ``pieces`` (a written table) without task and number, and sequence_id, offset."""
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = per_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("before"))
    # At most one row for each length up to the capacity.
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, _ = plan_bins(counts, capacity)
    table = np.array(runs, np.int64).reshape(-1, 6)
    keys = [c for c in pieces.columns if c not in ("task", "number")]
    numbered = pieces.join(starts, ["length", "task"]).select(*keys, (F.col("number") + F.col("before")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_length = {n: table[table[:, 0] == n] for n in np.unique(table[:, 0])}
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "number"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                part = by_length[n]
                r = part[np.searchsorted(part[:, 1], number[at], "right") - 1]
                in_run = number[at] - r[:, 1]
                sequence[at] = r[:, 3] + in_run // r[:, 4]
                offset[at] = r[:, 5] + in_run % r[:, 4] * n
            out = [batch.column(batch.schema.get_field_index(c)) for c in keys]
            yield pa.RecordBatch.from_arrays([*out, pa.array(sequence), pa.array(offset)], names=[*keys, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in numbered.schema if f.name in keys)
    return map_batches(numbered, run, f"{fields}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text",
         keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids where they are kept."""
    pieces = encode_pieces(docs, tokenizer, capacity, end_id, doc_id, text).withColumn("ids_crc32", F.crc32("ids"))
    return place_pieces(materialise(pieces if keep_ids else pieces.drop("ids"), "packing-pieces"), capacity)
