"""Ordered work over many keyed series, without putting one long series into one task.

``open_series`` checks how many rows the largest series has.  When every series fits one task,
plain windows over the series key are used: one exchange serves all later steps.  When some series
is too long, it is cut into contiguous blocks of bounded size: at equal shares of its rows, again
wherever a piece is still too full, and among equal positions by the next order column.  Windows
then run inside (key, block), and the little that crosses a block edge (row offsets, edge rows, carried values)
travels through a table with one row per block.  Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from contrail.session import broadcast_if_small, ensure_checkpoint_dir

BLOCK, CELL = "_blk", "_blk_cell"
MAX_ROWS = 5_000_000
MAX_ROWS_CONF = "spark.contrail.maxSeriesRows"
SHARES, ACCURACY = 32, 1_000  # a cell that is too full is cut at this many shares, each within a thousandth


def max_series_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(MAX_ROWS_CONF, str(MAX_ROWS)))


@dataclass(frozen=True)
class Series:
    """Rows of many series: ``keys`` identify one, ``order`` sorts it (first entry is numeric)."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool
    max_rows: int

    # -- specs ---------------------------------------------------------------------------------

    @property
    def part(self) -> list[str]:
        """Columns that bound one task's ordered work."""
        return [*self.keys, BLOCK] if self.split else list(self.keys)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.part).orderBy(*self.order)

    def with_df(self, df: DataFrame) -> Series:
        return replace(self, df=df)

    def with_columns(self, cols: dict[str, Column]) -> Series:
        return self.with_df(self.df.withColumns(cols)) if cols else self

    def result(self) -> DataFrame:
        return self.df.drop(BLOCK) if self.split else self.df

    def _blocks(self, *aggs: Column) -> DataFrame:
        return self.df.groupBy(*self.part).agg(*aggs)

    def _block_window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(BLOCK)

    # -- operators -----------------------------------------------------------------------------

    def shift(self, prev: dict[str, str] | None = None, nxt: dict[str, str] | None = None) -> Series:
        """Add values of the previous / next row: {new column: source column}."""
        prev, nxt = prev or {}, nxt or {}
        w = self.window
        if not self.split:
            cols = {n: F.lag(c).over(w) for n, c in prev.items()}
            cols |= {n: F.lead(c).over(w) for n, c in nxt.items()}
            return self.with_columns(cols)
        key = F.struct(*self.order)
        aggs, edge, local, names = [], [], {}, {}
        if prev:
            row = F.struct(*[F.col(c).alias(n) for n, c in prev.items()])
            aggs.append(F.max_by(row, key).alias("_blk_last"))
            edge.append(F.lag("_blk_last").over(self._block_window()).alias("_blk_edge_prev"))
            local["_blk_prev"] = F.lag(row).over(w)
            names |= {n: F.coalesce("_blk_prev", "_blk_edge_prev")[n] for n in prev}
        if nxt:
            row = F.struct(*[F.col(c).alias(n) for n, c in nxt.items()])
            aggs.append(F.min_by(row, key).alias("_blk_first"))
            edge.append(F.lead("_blk_first").over(self._block_window()).alias("_blk_edge_next"))
            local["_blk_next"] = F.lead(row).over(w)
            names |= {n: F.coalesce("_blk_next", "_blk_edge_next")[n] for n in nxt}
        edges = self._blocks(*aggs).select(*self.part, *edge)
        out = self.df.withColumns(local).join(edges, self.part, "left").withColumns(names)
        return self.with_df(out.drop("_blk_prev", "_blk_next", "_blk_edge_prev", "_blk_edge_next"))

    def offsets(self) -> DataFrame:
        """Rows of the series that precede each block, and the rows in it."""
        before = F.sum("_blk_n").over(self._block_window().rowsBetween(Window.unboundedPreceding, -1))
        return self._blocks(F.count(F.lit(1)).alias("_blk_n")).withColumn(
            "_blk_before", F.coalesce(before, F.lit(0))
        )

    def number(self, name: str = "_rn") -> Series:
        """1-based row number over the whole series."""
        rn = F.row_number().over(self.window).cast("long")
        if not self.split:
            return self.with_columns({name: rn})
        out = self.df.withColumn(name, rn).join(self.offsets(), self.part, "left")
        return self.with_df(out.withColumn(name, F.col(name) + F.col("_blk_before")).drop("_blk_n", "_blk_before"))

    def totals(self, aggs: dict[str, Column]) -> Series:
        """Attach aggregates of the whole series to each row."""
        if not self.split:
            whole = Window.partitionBy(*self.keys)
            return self.with_columns({n: a.over(whole) for n, a in aggs.items()})
        per_series = self.df.groupBy(*self.keys).agg(*[a.alias(n) for n, a in aggs.items()])
        per_block = self.df.select(*self.part).distinct().join(per_series, list(self.keys))
        return self.with_df(self.df.join(per_block, self.part, "left"))

    def carry(self, payloads: dict[str, str]) -> Series:
        """For each struct column: its last non-NULL value at or before the row (``<name>_prev``)
        and its first one after the row (``<name>_next``)."""
        back = self.window.rowsBetween(Window.unboundedPreceding, 0)
        desc = Window.partitionBy(*self.part).orderBy(*[F.desc(c) for c in self.order])
        ahead = desc.rowsBetween(Window.unboundedPreceding, -1)
        cols = {f"{n}_prev": F.last(c, True).over(back) for n, c in payloads.items()}
        cols |= {f"{n}_next": F.last(c, True).over(ahead) for n, c in payloads.items()}
        if not self.split:
            return self.with_columns(cols)
        key = F.struct(*self.order)
        aggs, edge, names = [], [], {}
        earlier = self._block_window().rowsBetween(Window.unboundedPreceding, -1)
        later = Window.partitionBy(*self.keys).orderBy(F.desc(BLOCK)).rowsBetween(Window.unboundedPreceding, -1)
        for n, c in payloads.items():
            here = F.when(F.col(c).isNotNull(), key)
            aggs += [F.max_by(c, here).alias(f"_l_{n}"), F.min_by(c, here).alias(f"_f_{n}")]
            edge += [
                F.last(f"_l_{n}", True).over(earlier).alias(f"_ep_{n}"),
                F.last(f"_f_{n}", True).over(later).alias(f"_en_{n}"),
            ]
            names[f"{n}_prev"] = F.coalesce(f"{n}_prev", f"_ep_{n}")
            names[f"{n}_next"] = F.coalesce(f"{n}_next", f"_en_{n}")
        edges = self._blocks(*aggs).select(*self.part, *edge)
        out = self.df.withColumns(cols).join(edges, self.part, "left").withColumns(names)
        return self.with_df(out.drop(*[f"_{p}_{n}" for p in ("ep", "en") for n in payloads]))

    def framed(self, halo: int, fn: Callable[[DataFrame, WindowSpec], DataFrame]) -> Series:
        """Run ``fn`` under a window that sees ``halo`` rows on both sides of every row.

        Long series are cut into equal runs of rows; each run also receives copies of the ``halo``
        rows around it, which are dropped again afterwards."""
        if not self.split:
            return self.with_df(fn(self.df, self.window))
        size = max(self.max_rows // 2, 2 * halo, 1)
        pos = F.col("_blk_pos") - 1
        home = F.floor(pos / size)
        sent = self.number("_blk_pos").df.withColumn("_blk_home", home).withColumn(
            "_blk_run",
            F.explode(
                F.array_distinct(
                    F.array(F.floor(F.greatest(pos - halo, F.lit(0)) / size), home, F.floor((pos + halo) / size))
                )
            ),
        )
        w = Window.partitionBy(*self.keys, "_blk_run").orderBy("_blk_pos")
        out = fn(sent, w).where(F.col("_blk_run") == F.col("_blk_home"))
        return self.with_df(out.drop("_blk_pos", "_blk_home", "_blk_run"))


def _fits_one_task(df: DataFrame, keys: tuple[str, ...], limit: int, sized_by: Sequence[DataFrame]) -> bool:
    if sum(d.count() for d in sized_by) <= limit:
        return True
    rows = reduce(DataFrame.unionByName, [d.select(*keys) for d in sized_by])
    return rows.groupBy(*keys).count().where(F.col("count") > limit).limit(1).count() == 0


def open_series(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], max_rows: int | None = None,
    sized_by: Sequence[DataFrame] | None = None, largest: int | None = None,
) -> Series:
    """Check the largest series and cut the long ones into blocks of at most ``max_rows`` rows.

    ``sized_by`` names tables with the same keys whose rows together bound those of ``df`` per key;
    they are counted in place of a costly ``df``.  ``largest``, where known, bounds the rows of a key and spares
    the count unless it is over the limit.  Keys and the first order column must not be NULL,
    and ``order`` must be unique within a series."""
    keys, order = tuple(keys), tuple(order)
    limit = max_rows or max_series_rows(df.sparkSession)
    if (largest is not None and largest <= limit) or _fits_one_task(df, keys, limit, sized_by or [df]):
        return Series(df, keys, order, False, limit)
    return Series(_blocked(df, keys, order, limit), keys, order, True, limit)


def _blocked(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], limit: int) -> DataFrame:
    """Adds ``BLOCK``: contiguous runs of neighbouring cells, at most ``limit`` rows each."""
    placed = df.withColumn(CELL, F.array().cast("array<int>"))
    for column in order:
        while True:
            bounds = _cell_bounds(placed, keys, column, limit)
            if bounds is None:
                break
            placed = _place(placed, bounds, keys, column)
    upto = Window.partitionBy(*keys).orderBy(CELL).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_blk_n").over(upto), F.lit(0))
    cells = (
        placed.where(F.size(CELL) > 0)
        .groupBy(*keys, CELL)
        .agg(F.count(F.lit(1)).alias("_blk_n"))
        .select(*keys, CELL, F.floor(before / max(limit // 2, 1)).alias(BLOCK))
        .checkpoint()
    )
    blocked = placed.join(broadcast_if_small(cells), [*keys, CELL], "left")
    return blocked.withColumn(BLOCK, F.coalesce(BLOCK, F.lit(0))).drop(CELL)


def _cell_bounds(placed: DataFrame, keys: tuple[str, ...], column: str, limit: int) -> DataFrame | None:
    """(keys, cell, bounds): values of ``column`` at equal shares of each cell that is too full.

    A cell with one value has no bounds here; the next order column cuts it."""
    values, n = F.count(column), F.count(F.lit(1))
    room = F.when(F.size(CELL) == 0, F.lit(limit)).otherwise(F.lit(max(limit // 2, 1)))
    full = (
        placed.groupBy(*keys, CELL)
        .agg(
            n.alias("_blk_n"), values.alias("_blk_values"), F.min(column).alias("_blk_lo"), F.max(column).alias("_blk_hi"),
            F.percentile_approx(column, [k / SHARES for k in range(SHARES + 1)], ACCURACY).alias("_blk_bounds"),
        )
        .where(F.col("_blk_n") > room)
        .where((F.col("_blk_lo") < F.col("_blk_hi")) | F.col("_blk_values").between(1, F.col("_blk_n") - 1))
        .select(*keys, CELL, F.array_sort(F.array_distinct("_blk_bounds")).alias("_blk_bounds"))
    )
    # every later step must see the same bounds
    ensure_checkpoint_dir(placed.sparkSession)
    full = full.checkpoint()
    return None if full.isEmpty() else full


def _place(placed: DataFrame, bounds: DataFrame, keys: tuple[str, ...], column: str) -> DataFrame:
    """Extend the cell of each row: bounds are cells of their own, and so is what lies between two."""
    out = placed.join(broadcast_if_small(bounds), [*keys, CELL], "left")
    v = F.col(column)
    below = F.size(F.filter("_blk_bounds", lambda x: x < v))
    at = F.when(v.isNull(), -1).otherwise(2 * below + F.array_contains("_blk_bounds", v).cast("int"))
    cell = F.when(F.col("_blk_bounds").isNull(), F.col(CELL)).otherwise(F.array_append(CELL, at.cast("int")))
    return out.withColumn(CELL, cell).drop("_blk_bounds")


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, max_rows: int | None = None,
    sized_by: Sequence[DataFrame] | None = None,
) -> DataFrame:
    """Linear-interpolated quantile per key: (keys, value).

    Equal values are counted before they are ranked, so a value that fills a group is one row."""
    src = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    distinct = src.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    s = open_series(distinct, keys, ["_v"], max_rows, sized_by)
    upto = F.sum("_c").over(s.window.rowsBetween(Window.unboundedPreceding, 0))
    if s.split:
        earlier = F.sum("_blk_c").over(s._block_window().rowsBetween(Window.unboundedPreceding, -1))
        edges = s._blocks(F.sum("_c").alias("_blk_c")).select(*s.part, F.coalesce(earlier, F.lit(0)).alias("_blk_before"))
        s = s.with_df(s.df.withColumn("_r", upto).join(edges, s.part, "left"))
        s = s.with_columns({"_r": F.col("_r") + F.col("_blk_before")})
    else:
        s = s.with_columns({"_r": upto})
    # ranks from 0 of the rows a value stands for: _r - _c up to _r - 1
    ranked = s.totals({"_n": F.sum("_c")}).df
    at = (F.col("_n") - 1) * F.lit(float(q))
    lo, hi = F.floor(at), F.ceil(at)
    near = ranked.where((F.col("_r") > lo) & (F.col("_r") - F.col("_c") <= hi))
    g = near.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_b"), F.max(at - lo).alias("_w"))
    return g.select(*keys, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_w")).alias(value))
