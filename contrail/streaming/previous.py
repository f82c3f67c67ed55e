"""Rules that need the row before, on streams: the rules themselves are those of batch tables.

``StreamTelemetry`` gives them a series whose order comes from state instead of a window."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from contrail.plans import timeline
from contrail.plans.rules import rows
from contrail.plans.rules.common import Telemetry
from contrail.schema import FLIGHT, ORDER, SERIES_KEYS

_STATE = "us array<long>, seq array<long>, row array<string>, kept array<string>, last string, upto long"


def with_previous(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], previous: dict[str, str],
    delay: str = "10 minutes", idle_ms: int = 3_600_000,
) -> DataFrame:
    """Every row of the stream with values of the row before it: {new column: source column}.

    ``order`` is (microseconds, sequence number).  A row waits until the watermark has passed it and is then handed on
    in order, so rows that come out of order, but within ``delay``, give what a window over the whole table gives.
    Rows behind the watermark are late and dropped.  A key that falls silent still hands on what it holds once the
    watermark passes; ``idle_ms`` of event time later its state ends, and a row that comes after that has no row before.
    Rows without a time or a key are dropped.  The state of a key is the rows of one ``delay``.  Values travel as
    JSON texts made and read by Spark, so that no type changes on the way; columns must be scalars."""
    names, (ts, seq) = stream.columns, order
    before = T.StructType([T.StructField(n, stream.schema[c].dataType) for n, c in previous.items()])
    sent = (
        stream.where(F.col(ts).isNotNull() & F.forall(F.array(*[F.col(k).isNull() for k in keys]), lambda x: ~x))
        .select(
            *[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.timestamp_micros(ts).alias("_at"),
            F.col(ts).cast("long").alias("_us"), F.coalesce(F.col(seq).cast("long"), F.lit(-1).cast("long")).alias("_seq"),
            F.to_json(F.struct(*names)).alias("_row"),
            F.to_json(F.struct(*[F.col(c).alias(n) for n, c in previous.items()])).alias("_kept"),
        )
        .withWatermark("_at", delay)
    )

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        line = state.getCurrentWatermarkMs() * 1000
        us, nr, row, kept, last, upto = state.get if state.exists else ([], [], [], [], None, None)
        held = pd.DataFrame({"_us": us, "_seq": nr, "_row": row, "_kept": kept})
        if state.hasTimedOut and held.empty:
            state.remove()
            return
        if not state.hasTimedOut:
            new = pd.concat(list(frames))[list(held.columns)]
            held = pd.concat([held, new if upto is None else new[new["_us"] > upto]]).astype({"_us": "int64", "_seq": "int64"})
        held = held.sort_values(["_us", "_seq", "_row"])
        ready = held["_us"] <= line
        out, held = held[ready], held[~ready]
        if len(out):
            yield pd.DataFrame({"row": out["_row"], "before": out["_kept"].shift(1, fill_value=None).where(lambda s: s.notna(), last)})
            last, upto = out["_kept"].iloc[-1], int(out["_us"].iloc[-1])
        upto = line if upto is None else max(line, upto)
        state.update((
            held["_us"].astype(int).tolist(), held["_seq"].astype(int).tolist(), held["_row"].tolist(), held["_kept"].tolist(), last, upto,
        ))
        wake = int(held["_us"].iloc[0]) // 1000 if len(held) else line // 1000 + idle_ms
        state.setTimeoutTimestamp(max(wake, line // 1000 + 1))

    shifted = sent.groupBy(*[f"_key{i}" for i in range(len(keys))]).applyInPandasWithState(
        step, "row string, before string", _STATE, "append", GroupStateTimeout.EventTimeTimeout,
    )
    return shifted.select(
        F.from_json("row", stream.schema).alias("r"), F.from_json("before", before).alias("b"),
    ).select("r.*", *[F.col("b")[n].alias(n) for n in previous])


@dataclass(frozen=True)
class StreamSeries:
    """What rules on adjacent rows use of a series, for a stream."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    delay: str
    idle_ms: int

    def with_df(self, df: DataFrame) -> StreamSeries:
        return replace(self, df=df)

    def with_columns(self, cols: dict[str, Column]) -> StreamSeries:
        return self.with_df(self.df.withColumns(cols)) if cols else self

    def shift(self, prev: dict[str, str] | None = None, nxt: dict[str, str] | None = None) -> StreamSeries:
        if nxt:
            raise ValueError("the row after is not known on a stream")
        return self.with_df(with_previous(self.df, self.keys, self.order, prev or {}, self.delay, self.idle_ms))

    def totals(self, aggs: dict[str, Column]) -> StreamSeries:
        raise ValueError("totals of a whole series are not known on a stream")

    def result(self) -> DataFrame:
        return self.df


class StreamTelemetry(Telemetry):
    """Streams by message type; a table named with a fallback must come from one of the two."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], delay: str = "10 minutes", idle_ms: int = 3_600_000):
        super().__init__(spark, tables)
        self.delay, self.idle_ms = delay, idle_ms

    def _table(self, name: str) -> DataFrame:
        if "|" in name and all(n in self._raw for n in name.split("|")):
            raise ValueError(f"which of {name} serves a flight is not known on a stream; give one of them")
        return super()._table(name)

    def _series(self, name: str) -> StreamSeries:
        return StreamSeries(self.table(name), tuple(SERIES_KEYS), tuple(ORDER), self.delay, self.idle_ms)

    def flight_series(self, df: DataFrame, table: str | None = None) -> StreamSeries:
        return StreamSeries(df, (FLIGHT,), tuple(ORDER), self.delay, self.idle_ms)


def adjacent_anomalies(t: StreamTelemetry) -> dict[str, DataFrame]:
    """Lane errors and moves, satellite drops and signs of false signals, where their tables are given.

    Each is a query of its own, as Spark allows one operator with state of this kind in a query.  Rules that
    also need totals of a whole flight (position glitches, lost commutation) are for batch tables only."""
    parts = {
        "lane_errors": ("ERR", rows.ekf_lane_errors), "lane_moves": ("NKF4|XKF4", rows.ekf_lane_moves),
        "satellite_drop": ("GPS", rows.gps_satellite_drop), "spoofing_indicator": ("GPS", rows.gps_spoofing_indicator),
    }
    return {n: rule(t) for n, (table, rule) in parts.items() if t.has(table)}


def adjacent_events(t: StreamTelemetry) -> dict[str, DataFrame]:
    """Changes of mode and arming; changes of fix, satellites and dilution; each a query of its own."""
    parts = {"mode": ("MODE", timeline.mode_events), "gps": ("GPS", timeline.gps_events)}
    return {n: events(t) for n, (table, events) in parts.items() if t.has(table)}
