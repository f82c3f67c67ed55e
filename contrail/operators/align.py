"""Joins along time: nearest, interpolated, following and containing rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.operators.series import BLOCK, Series, open_series


def _timeline(
    main: DataFrame,
    others: dict[str, tuple[DataFrame, Sequence[str]]],
    keys: Sequence[str],
    ts: str,
    seq: str,
    max_rows: int | None,
    main_first: bool = False,
    sized_by: Sequence[DataFrame] | None = None,
    largest: int | None = None,
) -> Series:
    """Main rows and the rows of every other table on one ordered line.

    Other rows sort before a main row of equal time unless ``main_first`` is set."""
    rank = 0 if main_first else 1
    all_rows = main.withColumns(
        {"_tag": F.lit(rank), "_tie": F.col(seq).cast("long"), "_own": F.lit(True)}
    )
    for name, (df, fields) in others.items():
        payload = F.struct(F.col(ts).alias("t"), *[F.col(f).alias(f) for f in fields])
        part = df.where(F.col(ts).isNotNull()).select(
            *keys, ts, F.col(seq).cast("long").alias("_tie"), F.lit(1 - rank).alias("_tag"),
            F.lit(False).alias("_own"), payload.alias(f"_p_{name}"),
        )
        all_rows = all_rows.unionByName(part, allowMissingColumns=True)
    s = open_series(all_rows, keys, [ts, "_tag", "_tie"], max_rows, sized_by, largest)
    return s.carry({name: f"_p_{name}" for name in others})


def nearest_join(
    main: DataFrame,
    others: dict[str, tuple[DataFrame, Sequence[str]]],
    keys: Sequence[str],
    ts: str = "timestamp_us",
    seq: str = "seq",
    tolerance: int = 100_000,
    max_rows: int | None = None,
) -> DataFrame:
    """Left join to the nearest row of each other table within ``tolerance``; the earlier row wins
    a tie.  Matched fields are named ``<table>_<field>``, the match time ``<table>_<ts>``."""
    s = _timeline(main, others, keys, ts, seq, max_rows)
    cols: list[Column] = []
    for name, (_, fields) in others.items():
        back, ahead = F.col(f"{name}_prev"), F.col(f"{name}_next")
        gap_b, gap_a = F.col(ts) - back["t"], ahead["t"] - F.col(ts)
        pick = F.when(gap_a.isNull() | (gap_b <= gap_a), back).otherwise(ahead)
        pick = F.when(F.abs(pick["t"] - F.col(ts)) <= tolerance, pick)
        cols += [pick["t"].alias(f"{name}_{ts}"), *[pick[f].alias(f"{name}_{f}") for f in fields]]
    return s.df.where("_own").select(*main.columns, *cols)


def lerp(ts: Column, back: Column, ahead: Column, field: str) -> Column:
    """Value at ``ts`` between two samples; the end samples hold beyond the ends."""
    frac = F.try_divide(ts - back["t"], ahead["t"] - back["t"])
    return (
        F.when(back["t"].isNull(), ahead[field])
        .when(ahead["t"].isNull() | (back["t"] == ts), back[field])
        .otherwise(back[field] + frac * (ahead[field] - back[field]))
    )


def interpolated_join(
    main: DataFrame,
    other: DataFrame,
    fields: Sequence[str],
    keys: Sequence[str],
    ts: str = "timestamp_us",
    seq: str = "seq",
    prefix: str = "",
    max_rows: int | None = None,
) -> DataFrame:
    """Add the linear interpolation of another table's fields at every main row."""
    s = _timeline(main, {"o": (other, fields)}, keys, ts, seq, max_rows)
    back, ahead = F.col("o_prev"), F.col("o_next")
    cols = [lerp(F.col(ts), back, ahead, f).alias(f"{prefix}{f}") for f in fields]
    return s.df.where("_own").select(*main.columns, *cols)


def following_join(
    main: DataFrame,
    others: dict[str, tuple[DataFrame, Sequence[str]]],
    keys: Sequence[str],
    within: int,
    ts: str = "timestamp_us",
    seq: str = "seq",
    max_rows: int | None = None,
) -> DataFrame:
    """First row of each other table in [ts, ts + within], as struct ``<table>`` (NULL when none).

    "None / any inside the window" questions need only this first row, so no pairs are formed."""
    s = _timeline(main, others, keys, ts, seq, max_rows, main_first=True)
    cols = []
    for name in others:
        ahead = F.col(f"{name}_next")
        cols.append(F.when(ahead["t"] <= F.col(ts) + within, ahead).alias(name))
    return s.df.where("_own").select(*main.columns, *cols)


def count_following(
    main: DataFrame, other: DataFrame, keys: Sequence[str], within: int,
    ts: str = "timestamp_us", seq: str = "seq", name: str = "n_within", max_rows: int | None = None,
) -> DataFrame:
    """Rows of ``other`` inside [ts, ts + within]: two positions on a running count."""
    s = open_series(other.select(*keys, ts, seq), keys, [ts, seq], max_rows)
    counted = s.number("_c").df.drop(BLOCK)
    start = _timeline(main, {"a": (counted, ["_c"])}, keys, ts, seq, max_rows, True, [main, other])
    lead = start.df.where("_own").select(
        *main.columns, F.coalesce(F.col("a_prev")["_c"], F.lit(0)).alias("_c0")
    )
    # the window's far end becomes the order column; the original time rides along
    far = lead.withColumn("_at", F.col(ts)).withColumn(ts, F.col(ts) + within)
    end = _timeline(far, {"b": (counted, ["_c"])}, keys, ts, seq, max_rows, sized_by=[main, other])
    n = F.coalesce(F.col("b_prev")["_c"], F.lit(0)) - F.col("_c0")
    return end.df.where("_own").select(
        *[F.col("_at").alias(ts) if c == ts else F.col(c) for c in main.columns], n.cast("long").alias(name)
    )


def assign_segment(
    rows: DataFrame,
    segments: DataFrame,
    fields: Sequence[str],
    keys: Sequence[str],
    ts: str = "timestamp_us",
    seq: str = "seq",
    start: str = "start_us",
    max_rows: int | None = None,
    sized_by: Sequence[DataFrame] | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Give each row the last segment that starts at or before it (struct ``segment``)."""
    seg = segments.select(*keys, F.col(start).alias(ts), F.lit(0).cast("long").alias(seq), *fields)
    s = _timeline(rows, {"segment": (seg, fields)}, keys, ts, seq, max_rows, sized_by=sized_by, largest=largest)
    return s.df.where("_own").select(*rows.columns, F.col("segment_prev").alias("segment"))


def sensor_disagreement(
    a: DataFrame, b: DataFrame, value: str, keys: Sequence[str], ts: str = "timestamp_us",
    min_samples: int = 10, max_rows: int | None = None,
) -> DataFrame:
    """RMS, largest and mean difference of two sensors on the union of their times, inside the
    span both cover.  Fewer than ``min_samples`` common times give NULL results."""
    keys = list(keys)

    def samples(df: DataFrame, tag: int, name: str) -> DataFrame:
        one = df.where(F.col(value).isNotNull()).groupBy(*keys, ts).agg(F.max(value).alias("v"))
        return one.select(*keys, ts, F.lit(tag).alias("_tag"), F.struct(F.col(ts).alias("t"), "v").alias(name))

    line = samples(a, 0, "_a").unionByName(samples(b, 1, "_b"), allowMissingColumns=True)
    s = open_series(line, keys, [ts, "_tag"], max_rows).carry({"a": "_a", "b": "_b"})
    t = F.col(ts)
    both_before = (F.col("a_prev").isNotNull() | (F.col("a_next")["t"] == t)) & (
        F.col("b_prev").isNotNull() | (F.col("b_next")["t"] == t)
    )
    both_after = (F.col("a_next").isNotNull() | (F.col("a_prev")["t"] == t)) & (
        F.col("b_next").isNotNull() | (F.col("b_prev")["t"] == t)
    )
    repeat = (F.col("_tag") == 1) & F.coalesce(F.col("a_prev")["t"] == t, F.lit(False))
    diff = lerp(t, F.col("a_prev"), F.col("a_next"), "v") - lerp(t, F.col("b_prev"), F.col("b_next"), "v")
    common = s.df.where(both_before & both_after & ~repeat).select(*keys, diff.alias("_d"))
    enough = F.count(F.lit(1)) >= min_samples
    stats = common.groupBy(*keys).agg(
        F.when(enough, F.sqrt(F.avg(F.col("_d") * F.col("_d")))).alias("rmse"),
        F.when(enough, F.max(F.abs("_d"))).alias("max_diff"),
        F.when(enough, F.avg("_d")).alias("mean_bias"),
        F.count(F.lit(1)).alias("n_samples"),
    )
    pairs = a.select(*keys).distinct().join(b.select(*keys).distinct(), keys)
    return pairs.join(stats, keys, "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


def fallback_source(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Per key, the primary table's rows, or the secondary's where the primary has none."""
    have = primary.select(key).distinct()
    return primary.unionByName(secondary.join(have, key, "left_anti"), allowMissingColumns=True)
