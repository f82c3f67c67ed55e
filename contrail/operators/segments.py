"""Penalised segmentation of many series: the breaks that minimise kernel cost plus a penalty for each."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.operators.series import Series, open_series
from contrail.session import broadcast_if_small, ensure_checkpoint_dir

RANGE = 8.0  # values count as at most so many deviations from the mean; at most 1 value in 64 lies beyond
CELLS = 2048  # cells over that range, from whose counts the kernel width is taken
NARROWEST = 0.1  # least kernel width in deviations; bounds the features of a row to about 1000
REACH = 6.0  # frequencies up to so many deviations of the kernel's spectrum; its rest weighs under 1e-8
AT_ONCE = 512  # rows, about, whose features are held at a time


def _median_square_distance(cell: np.ndarray, count: np.ndarray) -> float:
    """Median squared distance of all pairs of rows, from counts per cell."""
    c = np.zeros(CELLS)
    c[cell] = count
    size = 2 * CELLS
    pairs = np.rint(np.fft.irfft(np.abs(np.fft.rfft(c, size)) ** 2, size)[:CELLS])
    pairs[0] = (c * (c - 1) / 2).sum()
    upto = np.cumsum(pairs)
    return float((np.searchsorted(upto, upto[-1] / 2) * 2 * RANGE / CELLS) ** 2)


def _frequencies(gamma: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and weights with sum(w * cos(f * d)) = exp(-gamma * d * d) for |d| <= 2 * RANGE."""
    spread = np.sqrt(2 * gamma)
    period = 2 * RANGE + REACH / spread * 1.1  # the kernel is spent before its next copy comes near
    step = 2 * np.pi / (2 * period)
    f = np.arange(int(np.ceil(REACH * spread / step)) + 1) * step
    w = np.exp(-(f**2) / (4 * gamma)) * step / np.sqrt(np.pi * gamma)
    w[0] /= 2
    return f, w


def _features(z: np.ndarray, gamma: float) -> np.ndarray:
    """Rows whose products are the kernel."""
    f, w = _frequencies(gamma)
    turn = np.outer(np.clip(z, -RANGE, RANGE), f)
    return np.hstack([np.cos(turn), np.sin(turn)]) * np.sqrt(np.hstack([w, w]))


def _summed_features(z: np.ndarray, gamma: float, jump: int) -> np.ndarray:
    """Features summed over every ``jump`` rows; those of single rows are held for a few rows only."""
    rows = max(AT_ONCE // jump, 1) * jump
    parts = (_features(z[a : a + rows], gamma) for a in range(0, len(z), rows))
    return np.vstack([np.add.reduceat(x, np.arange(0, len(x), jump)) for x in parts])


def _breaks(counts: np.ndarray, sums: np.ndarray, min_size: int, penalty: float) -> np.ndarray:
    """Pruned dynamic programming over pieces: positions (in pieces) of the best breaks, ends left out.

    A stretch costs its rows less the squared length of its summed features over its rows."""
    n = np.concatenate([[0], np.cumsum(counts)])
    s = np.zeros((len(n), sums.shape[1]))
    np.cumsum(sums, axis=0, out=s[1:])
    best = np.full(len(n), np.inf)
    best[0] = -penalty
    came = np.zeros(len(n), dtype=np.int64)
    starts, until = np.array([0]), np.array([np.inf])  # a start goes once a better one can take its place
    waiting = 1  # the next position that becomes a start once it is min_size rows back
    for t in range(1, len(n)):
        if n[t] < min_size:
            continue
        while waiting < t and n[t] - n[waiting] >= min_size:
            if np.isfinite(best[waiting]):
                starts, until = np.append(starts, waiting), np.append(until, np.inf)
            waiting += 1
        starts, until = starts[until > n[t]], until[until > n[t]]
        rows = n[t] - n[starts]
        d = s[t] - s[starts]
        cost = best[starts] + rows - np.einsum("ij,ij->i", d, d) / rows + penalty
        k = int(np.argmin(cost))
        best[t], came[t] = cost[k], starts[k]
        until = np.where(cost - penalty > best[t], np.minimum(until, n[t] + min_size), until)
    out, t = [], len(n) - 1
    while came[t] > 0:
        t = came[t]
        out.append(t)
    return np.array(out[::-1], dtype=np.int64)


def _widths(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _gamma) of (keys, _cell, _c).  Counts come as arrays of numbers, because a batch holds those of many keys."""

    @F.pandas_udf("double")
    def width(cells: pd.Series, counts: pd.Series) -> pd.Series:
        squares = (_median_square_distance(cell, count) for cell, count in zip(cells, counts))
        return pd.Series([1 / max(m, NARROWEST**2) if m else 1.0 for m in squares], dtype=float)

    rows = F.collect_list(F.struct(F.col("_cell").cast("int").alias("_cell"), F.col("_c").cast("double").alias("_c")))  # at most CELLS counts a key
    return counted.groupBy(*keys).agg(rows.alias("_h")).select(*keys, width("_h._cell", "_h._c").alias("_gamma"))


def penalised_breaks(
    series: Series, value: str, min_size: int = 20, penalty: float = 10.0, jump: int = 5,
    block: int = 8_192, margin: int = 1_024, pieces: int = 4_096,
) -> DataFrame:
    """(keys, position, order columns): last row before each break, ``position`` rows into its series.

    The cost of a stretch is that of a Gaussian kernel on values scaled to the series' mean and deviation, the kernel
    as wide as the median distance of all pairs of its rows.  Breaks lie at multiples of ``jump`` rows and at least
    ``min_size`` rows apart and from the ends, and minimise cost plus ``penalty`` a break.  Rows without a value are
    left out; flat series and series under two times ``min_size`` rows give nothing; so do empty tables.

    Series up to ``block`` rows are solved exactly.  Longer ones are cut into blocks that see ``margin`` rows on both
    sides; what a block finds in its own rows are candidates, and the same search runs over the pieces between them,
    ``pieces`` at a time, until a series fits one task or its pieces get no fewer.  A task holds one block with its
    margins or three times ``pieces`` pieces, whatever the length of the series."""
    keys, order = list(series.keys), list(series.order)
    block, margin = max(block // jump, 1) * jump, max(-(-max(margin, 2 * min_size) // jump), 1) * jump
    ensure_checkpoint_dir(series.df.sparkSession)
    v = F.col(value).cast("double")
    rows = series.with_df(series.df.where(v.isNotNull() & ~F.isnan(v))).number("_i").df
    rows = rows.select(*keys, *order, (F.col("_i") - 1).alias("_p"), v.alias("_v"))
    path = rows.checkpoint()  # read by the sums, the counts, the blocks and the last join
    size = path.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("_v").alias("_mu"), F.stddev_pop("_v").alias("_sd"))
    size = size.where((F.col("_n") >= 2 * min_size) & (F.col("_sd") >= 1e-10)).checkpoint()
    scaled = path.join(broadcast_if_small(size), keys).withColumn("_z", (F.col("_v") - F.col("_mu")) / F.col("_sd"))
    cell = F.floor((F.least(F.greatest("_z", F.lit(-RANGE)), F.lit(RANGE)) + RANGE) * (CELLS / (2 * RANGE)))
    counted = scaled.groupBy(*keys, F.least(cell, F.lit(CELLS - 1)).cast("int").alias("_cell")).agg(F.count(F.lit(1)).alias("_c"))

    gammas = _widths(counted, keys).checkpoint()
    home = F.floor(F.col("_p") / block)
    sent = scaled.join(broadcast_if_small(gammas), keys).select(
        *keys, "_p", "_z", "_gamma", "_n", F.explode(F.array_distinct(F.array(
            F.floor(F.greatest(F.col("_p") - margin, F.lit(0)) / block), home,
            F.floor(F.least(F.col("_p") + margin, F.col("_n") - 1) / block),
        ))).alias("_b"),
    )
    fields = [path.schema[k] for k in keys]
    piece = T.StructType([
        *fields, T.StructField("_from", T.LongType()), T.StructField("_to", T.LongType()), T.StructField("_n", T.LongType()),
        T.StructField("_break", T.BooleanType()), T.StructField("_sums", T.ArrayType(T.DoubleType())),
    ])

    def table(pdf: pd.DataFrame, edges: np.ndarray, breaks: np.ndarray, sums: np.ndarray) -> pd.DataFrame:
        """Pieces between edges; ``_break`` tells whether the search put a break before a piece."""
        head = {k: np.full(len(edges) - 1, pdf[k].iloc[0], dtype=object) for k in keys}
        return pd.DataFrame({
            **head, "_from": edges[:-1], "_to": edges[1:], "_n": int(pdf["_n"].iloc[0]),
            "_break": np.isin(edges[:-1], breaks), "_sums": list(sums),
        })

    def in_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p")
        p, total, b = pdf["_p"].to_numpy(), int(pdf["_n"].iloc[0]), int(pdf["_b"].iloc[0])
        sums = _summed_features(pdf["_z"].to_numpy(), float(pdf["_gamma"].iloc[0]), jump)
        counts = np.diff(np.append(np.arange(0, len(p), jump), len(p)))
        at = p[0] + _breaks(counts, sums, min_size, penalty) * jump
        lo, hi = b * block, min((b + 1) * block, total)
        edges = np.unique(np.concatenate([[lo], at[(at > lo) & (at < hi)], [hi]]))
        # all edges but the end of a series lie at multiples of jump
        return table(pdf, edges, at, np.add.reduceat(sums[: -(-(hi - p[0]) // jump)], (edges[:-1] - p[0]) // jump))

    def join_pieces(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_from")
        starts, ends = pdf["_from"].to_numpy(), pdf["_to"].to_numpy()
        own = np.flatnonzero(pdf["_home"].to_numpy() == pdf["_g"].to_numpy())
        if not len(own):
            return pd.DataFrame(columns=piece.names)
        sums = np.stack(pdf["_sums"].to_numpy())
        breaks = starts[_breaks(ends - starts, sums, min_size, penalty)]
        kept = own[np.isin(starts[own], breaks) | (own == own[0])]
        edges = np.append(starts[kept], ends[own[-1]])
        return table(pdf, edges, breaks, np.add.reduceat(sums[: own[-1] + 1], kept))

    found = sent.groupBy(*keys, "_b").applyInPandas(in_block, piece).checkpoint()
    if not size.where(F.col("_n") > block).isEmpty():
        found = _join_all(found, keys, join_pieces, piece, pieces, series.max_rows)
    starts = found.where("_break").select(*keys, F.col("_from").alias("position"))
    return starts.join(path.select(*keys, *order, (F.col("_p") + 1).alias("position")), [*keys, "position"])


def _join_all(found: DataFrame, keys: Sequence[str], join_pieces, schema: T.StructType, pieces: int, max_rows: int) -> DataFrame:
    """Pieces joined ``pieces`` at a time; the search of a group sees the groups on both sides, but decides on its own
    pieces only.  The first piece of a group stays one for the next round, whether or not a break lies before it."""
    before = None
    while True:
        whole = found.groupBy(*keys).count().where(F.col("count") > pieces).isEmpty()
        home = F.lit(0).cast("long") if whole else F.floor((F.col("_k") - 1) / pieces)
        near = F.array(home) if whole else F.array(home - 1, home, home + 1)
        numbered = open_series(found, keys, ["_from"], max_rows).number("_k").df
        sent = numbered.select(*found.columns, home.alias("_home"), F.explode(near).alias("_g"))
        found = sent.groupBy(*keys, "_g").applyInPandas(join_pieces, schema).checkpoint()
        left = found.count()
        if whole or (before is not None and left > 0.9 * before):
            return found
        before = left
