"""Runs, bursts, groups and steps in ordered series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from contrail.operators import spacing as spacing_steps
from contrail.operators.series import BLOCK, Series
from contrail.session import broadcast_if_small, ensure_checkpoint_dir


@dataclass(frozen=True)
class Check:
    """One threshold over a series.  Violating rows at most ``gap`` rows apart form a group;
    groups shorter than ``min_duration`` (units of the order column) are dropped."""

    name: str
    when: Column
    value: Column
    min_duration: int = 0
    gap: int = 1
    aside: Column | None = None  # extra value, reported as of the first row of a group


def violation_groups(series: Series, checks: Sequence[Check]) -> DataFrame:
    """All checks over one pass: (keys, check, start, end, n, v_max, v_min, v_mean, v_first, aside).

    Row adjacency does not depend on the check, so rows are numbered once; only violating
    (row, check) pairs go further, partitioned as before."""
    ts = series.order[0]
    hits = [
        F.when(
            F.coalesce(c.when, F.lit(False)),
            F.struct(
                F.lit(i).alias("check"),
                c.value.cast("double").alias("v"),
                (F.lit(None) if c.aside is None else c.aside).cast("double").alias("aside"),
            ),
        )
        for i, c in enumerate(checks)
    ]
    numbered = series.number("_rn")
    rows = (
        numbered.df.select(*series.part, F.col(ts).alias("_ts"), "_rn", F.array_compact(F.array(*hits)).alias("_h"))
        .where(F.size("_h") > 0)
        .select(*series.part, "_ts", "_rn", F.explode("_h").alias("_h"))
        .select(*series.part, "_ts", "_rn", "_h.*")
    )
    gap_of = F.element_at(F.array(*[F.lit(c.gap) for c in checks]), F.col("check") + 1)
    groups = _merge_close(rows, series.part, gap_of).agg(
        F.min("_ts").alias("start"), F.max("_ts").alias("end"),
        F.min("_rn").alias("_a"), F.max("_rn").alias("_b"), F.count(F.lit(1)).alias("n"),
        F.max("v").alias("v_max"), F.min("v").alias("v_min"), F.sum("v").alias("v_sum"),
        F.count("v").alias("v_n"),
        # plain doubles keep this a hash aggregate; _new marks the first row of a group
        F.max(F.when(F.col("_new") == 1, F.col("v"))).alias("v_first"),
        F.max(F.when(F.col("_new") == 1, F.col("aside"))).alias("aside"),
    )
    if series.split:
        groups = _stitch(groups, series, gap_of, max(c.gap for c in checks))
    names = F.element_at(F.array(*[F.lit(c.name) for c in checks]), F.col("check") + 1)
    floor = F.element_at(F.array(*[F.lit(c.min_duration).cast("long") for c in checks]), F.col("check") + 1)
    return groups.where(F.col("end") - F.col("start") >= floor).select(
        *series.keys, names.alias("check"), "start", "end", "n", "v_max", "v_min",
        F.try_divide("v_sum", "v_n").alias("v_mean"),
        "v_first", "aside",
    )


def _merge_close(rows: DataFrame, part: Sequence[str], gap_of: Column):
    w = Window.partitionBy(*part, "check").orderBy("_rn")
    fresh = F.coalesce(F.col("_rn") - F.lag("_rn").over(w) > gap_of, F.lit(True))
    marked = rows.withColumn("_new", fresh.cast("int"))
    return marked.withColumn("_g", F.sum("_new").over(w)).groupBy(*part, "check", "_g")


def _stitch(groups: DataFrame, series: Series, gap_of: Column, widest: int) -> DataFrame:
    """Join groups that continue across a block edge.  Only groups within ``widest`` rows of an
    edge can, so at most a few per block are looked at again; the rest pass through."""
    placed = groups.join(series.offsets(), series.part, "left")
    near = (F.col("_a") <= F.col("_blk_before") + widest) | (F.col("_b") > F.col("_blk_before") + F.col("_blk_n") - widest)
    placed = placed.withColumn("_near", near)
    keep = [*series.keys, "check", "start", "end", "_a", "_b", "n", "v_max", "v_min", "v_sum", "v_n", "v_first", "aside"]
    w = Window.partitionBy(*series.keys, "check").orderBy("_a")
    fresh = F.coalesce(F.col("_a") - F.lag("_b").over(w) > gap_of, F.lit(True))
    edge = placed.where("_near").select(*keep).withColumn("_new", fresh.cast("int"))
    joined = (
        edge.withColumn("_g", F.sum("_new").over(w))
        .groupBy(*series.keys, "check", "_g")
        .agg(
            F.min("start").alias("start"), F.max("end").alias("end"),
            F.min("_a").alias("_a"), F.max("_b").alias("_b"), F.sum("n").alias("n"),
            F.max("v_max").alias("v_max"), F.min("v_min").alias("v_min"), F.sum("v_sum").alias("v_sum"),
            F.sum("v_n").alias("v_n"), F.min_by("v_first", "_a").alias("v_first"), F.min_by("aside", "_a").alias("aside"),
        )
        .drop("_g")
    )
    return placed.where(~F.col("_near")).select(*keep).unionByName(joined.select(*keep))


def burst_onsets(series: Series, flag: Column) -> DataFrame:
    """First row of each run of flagged rows."""
    s = series.with_columns({"_flag": F.coalesce(flag, F.lit(False))}).shift({"_was": "_flag"})
    out = s.df.where(F.col("_flag") & ~F.coalesce("_was", F.lit(False)))
    return s.with_df(out.drop("_flag", "_was")).result()


def transitions(series: Series, column: str, before: str = "before") -> DataFrame:
    """Rows whose value differs from the previous row; the old value is kept in ``before``."""
    s = series.shift({before: column})
    return s.with_df(s.df.where(F.col(column) != F.col(before))).result()


def steps(series: Series, columns: dict[str, str], max_dt: int) -> DataFrame:
    """Adjacent pairs with 0 < dt <= max_dt: previous values under the given names, plus ``dt``."""
    ts = series.order[0]
    s = series.shift({**columns, "_t0": ts})
    dt = F.col(ts) - F.col("_t0")
    return s.with_df(s.df.withColumn("dt", dt).where((dt > 0) & (dt <= max_dt)).drop("_t0")).result()


def gradient(series: Series, value: str, name: str = "gradient", unit: float = 1e-6) -> Series:
    """Central difference on an uneven grid; one-sided at the ends.  ``unit`` scales time."""
    ts = series.order[0]
    s = series.shift({"_t0": ts, "_v0": value}, {"_t1": ts, "_v1": value})
    h0 = (F.col(ts) - F.col("_t0")) * unit
    h1 = (F.col("_t1") - F.col(ts)) * unit
    v, v0, v1 = F.col(value), F.col("_v0"), F.col("_v1")
    inner = F.try_divide(h0 * h0 * v1 + (h1 * h1 - h0 * h0) * v - h1 * h1 * v0, h0 * h1 * (h0 + h1))
    g = (
        F.when(F.col("_t0").isNull() & F.col("_t1").isNull(), F.lit(None).cast("double"))
        .when(F.col("_t0").isNull(), F.try_divide(v1 - v, h1))
        .when(F.col("_t1").isNull(), F.try_divide(v - v0, h0))
        .otherwise(inner)
    )
    return s.with_df(s.df.withColumn(name, g).drop("_t0", "_v0", "_t1", "_v1"))


def rolling_mean_padded(series: Series, value: str, window: int, name: str) -> Series:
    """Centred moving mean divided by ``window`` throughout, so both ends lean to zero."""
    lo, hi = -(window // 2), (window - 1) - window // 2
    return series.framed(
        window, lambda d, w: d.withColumn(name, F.sum(value).over(w.rowsBetween(lo, hi)) / window)
    )


def every_nth(series: Series, max_points: int) -> DataFrame:
    """Thin each series by a fixed stride so that about ``max_points`` rows stay."""
    s = series.number("_rn").totals({"_all": F.count(F.lit(1))})
    stride = F.greatest(F.lit(1), F.when(F.col("_all") > max_points, F.floor(F.col("_all") / max_points)))
    return s.with_df(s.df.where((F.col("_rn") - 1) % stride == 0).drop("_rn", "_all")).result()


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int) -> DataFrame:
    """First ``n`` rows per key.  The row_number filter is pushed below the exchange as a
    group limit, so a long group sends at most ``n`` rows per map task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def spaced_events(series: Series, spacing: int) -> DataFrame:
    """Keep an event only when it comes more than ``spacing`` after the last kept one.

    Rows arrive sorted by series and time and are kept or dropped on the way, so a task holds one batch whatever the
    size of a series.  Where series are cut into blocks, each block first gives a map from the last kept time before
    it to the one after it; the maps of a series are followed in order, which tells each block where to begin."""
    ts, part, columns = series.order[0], series.part, [c for c in series.df.columns if c != BLOCK]
    rows, entry = series.df, None
    if series.split:
        rows, entry = rows.join(broadcast_if_small(_entries(series, spacing)), part, "left"), "_entry"
    fields = [series.df.schema[c] for c in columns]
    return _in_order(rows, part, series.order).mapInArrow(
        lambda batches: spacing_steps.keep_spaced(batches, part, ts, spacing, entry, columns), T.StructType(fields)
    )


def _in_order(df: DataFrame, part: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.repartition(*part).sortWithinPartitions(*part, *order)


def _entries(series: Series, spacing: int) -> DataFrame:
    """(keys, block, _entry): the last kept time before each block; NULL for the first one."""
    ts, keys, part = series.order[0], list(series.keys), series.part
    exact = not isinstance(series.df.schema[ts].dataType, T.FractionalType)
    number, kind = (T.LongType(), pa.int64()) if exact else (T.DoubleType(), pa.float64())
    ids = [T.StructField(f.name, f.dataType) for f in (series.df.schema[c] for c in part)]
    pieces = _in_order(series.df.select(*part, ts), part, [ts]).mapInArrow(
        lambda batches: spacing_steps.block_maps(batches, part, ts, spacing),
        T.StructType([*ids, T.StructField("_bound", number), T.StructField("_exit", number)]),
    )
    entries = _in_order(pieces, keys, [BLOCK, "_bound"]).mapInArrow(
        lambda batches: spacing_steps.block_entries(batches, part, kind), T.StructType([*ids, T.StructField("_entry", number)])
    )
    ensure_checkpoint_dir(series.df.sparkSession)
    return entries.checkpoint()
