"""Greedy spacing of sorted times as maps from the last kept time before some rows to the last one after them.

Which rows are kept depends on all earlier choices, but of those only the last kept time matters.  Sorted rows
therefore are a map from entry time to exit time, given by pieces: an entry below ``bounds[i]``, and not below the
bound before it, leaves with ``exits[i]``; an entry that no bound exceeds leaves as it came.  Maps of neighbouring
rows chain, so batches of a block and blocks of a series are worked on apart and meet in their maps alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

Map = tuple[np.ndarray, np.ndarray]


def entry_map(times: np.ndarray, spacing: int) -> Map:
    """The map of sorted times: row i is kept first for entries below ``times[i] - spacing``."""
    n = len(times)
    last, ahead = np.arange(n), np.searchsorted(times, times + spacing, "right")
    ahead = np.where(ahead < n, ahead, last)  # the last kept row leads to itself
    while not np.array_equal(last, ahead):
        last, ahead = ahead, ahead[ahead]
    return _merged(times - spacing, times[last])


def _merged(bounds: np.ndarray, exits: np.ndarray) -> Map:
    """Of neighbouring pieces with one exit the last bound is enough."""
    ends = np.append(exits[1:] != exits[:-1], True)
    return bounds[ends], exits[ends]


def chain(first: Map, then: Map) -> Map:
    """The map of the rows of ``first`` followed by those of ``then``."""
    (bounds, exits), (bounds2, exits2) = first, then
    at = np.searchsorted(bounds2, exits, "right")
    moved = np.where(at < len(bounds2), exits2[np.minimum(at, len(exits2) - 1)], exits)
    beyond = bounds2 > bounds[-1]
    return _merged(np.append(bounds, bounds2[beyond]), np.append(moved, exits2[beyond]))


def _slices(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(values, start, stop) of each run of rows with equal values of ``names``; equal rows lie together."""
    ids = batch.select(names).to_pandas().groupby(names, sort=False, dropna=False).ngroup().to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
    for a, b in zip(cuts, cuts[1:]):
        yield tuple(batch.column(n)[a].as_py() for n in names), a, b


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    values = batch.column(name).to_numpy(zero_copy_only=False)
    return values.astype(np.int64 if values.dtype.kind in "iu" else np.float64)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in batches if b.num_rows)


def keep_spaced(batches: Iterator[pa.RecordBatch], parts: list[str], ts: str, spacing: int, entry: str | None,
                columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The kept rows of parts that arrive in order; ``entry`` names the last kept time before each part."""
    part, last = None, None
    for batch in _filled(batches):
        times, kept = _numbers(batch, ts), []
        for values, a, b in _slices(batch, parts):
            if values != part:
                part, last = values, batch.column(entry)[a].as_py() if entry else None
            here = times[a:b]
            i = 0 if last is None else int(np.searchsorted(here, last + spacing, "right"))
            while i < len(here):
                kept.append(a + i)
                last = here[i].item()
                i = int(np.searchsorted(here, last + spacing, "right"))
        yield batch.select(columns).take(pa.array(kept, pa.int64()))


def block_maps(batches: Iterator[pa.RecordBatch], parts: list[str], ts: str, spacing: int) -> Iterator[pa.RecordBatch]:
    """(parts, _bound, _exit): the pieces of each block's map, its rows arriving in order of time.

    A batch and the map are held.  Entries are never later than the block's first row, so a map has no more pieces
    than the block has rows within ``spacing`` of that row, and one more."""
    part, head, held, lo = None, None, None, None
    for batch in _filled(batches):
        times = _numbers(batch, ts)
        for values, a, b in _slices(batch, parts):
            here = entry_map(times[a:b], spacing)
            if values == part:
                here = chain(held, here)
            elif part is not None:
                yield _pieces(head, held)
            if values != part:
                part, head, lo = values, batch.select(parts).slice(a, 1), times[a]
            wanted = int(np.searchsorted(here[0], lo, "right")) + 1
            held = here[0][:wanted], here[1][:wanted]
    if part is not None:
        yield _pieces(head, held)


def _pieces(head: pa.RecordBatch, held: Map) -> pa.RecordBatch:
    parts = head.take(pa.array(np.zeros(len(held[0]), np.int64)))
    return pa.RecordBatch.from_arrays([*parts.columns, *(pa.array(v) for v in held)], names=[*head.schema.names, "_bound", "_exit"])


def block_entries(batches: Iterator[pa.RecordBatch], parts: list[str], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """(parts, _entry): the last kept time before each block, from the pieces of all blocks of a series in order.

    The last of ``parts`` is the block; one time is carried from piece to piece."""
    part, last, open_ = None, None, False
    for batch in _filled(batches):
        bounds, exits = _numbers(batch, "_bound"), _numbers(batch, "_exit")
        rows, entries = [], []
        for values, a, b in _slices(batch, parts):
            if values != part:
                if part is None or values[:-1] != part[:-1]:
                    last = None
                part, open_ = values, True
                rows.append(a)
                entries.append(last)
            if open_:
                i = a if last is None else a + int(np.searchsorted(bounds[a:b], last, "right"))
                if i < b:
                    last, open_ = exits[i].item(), False
        heads = batch.select(parts).take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([*heads.columns, pa.array(entries, kind)], names=[*parts, "_entry"])
