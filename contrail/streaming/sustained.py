"""Sustained violations on a stream, with one open run per series as state."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_RUN = ["start", "end", "n", "values", "v_max", "v_sum"]
_STATE = "start long, end long, n long, values long, v_max double, v_sum double, seen long"


def _join_runs(run: list, batch: pd.DataFrame) -> tuple[pd.DataFrame, list]:
    """Runs that are over after the ordered rows of ``batch``, and the one still open."""
    us, hit = batch["us"].to_numpy(), batch["hit"].to_numpy(dtype=bool)
    v = batch["v"].to_numpy(dtype=float)
    edges = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    first, last = edges[0::2], edges[1::2]
    at = edges[edges < len(us)]  # every other stretch between edges is a run
    pieces = pd.DataFrame({
        "start": us[first], "end": us[last - 1], "n": last - first,
        "values": np.add.reduceat(~np.isnan(v), at, dtype=np.int64)[::2] if len(at) else 0,
        "v_max": np.fmax.reduceat(v, at)[::2] if len(at) else np.nan,
        "v_sum": np.add.reduceat(np.nan_to_num(v), at)[::2] if len(at) else 0.0,
    })
    if run[2] and len(first) and first[0] == 0:  # the open run goes on
        p = pieces.iloc[0]
        pieces.loc[0] = [run[0], p["end"], run[2] + p["n"], run[3] + p["values"], np.fmax(run[4], p["v_max"]), run[5] + p["v_sum"]]
    elif run[2]:
        pieces = pd.concat([pd.DataFrame([run], columns=_RUN), pieces], ignore_index=True)
    still_open = hit[-1] if len(hit) else bool(run[2])
    done = pieces.iloc[:-1] if still_open else pieces
    return done.astype({c: "int64" for c in _RUN[:4]}), pieces.iloc[-1].tolist() if still_open else [0, 0, 0, 0, np.nan, 0.0]


def sustained_stream(
    stream: DataFrame, key: str, event_time: str, seq: str, when: Column, value: Column, min_duration_us: int,
    delay: str = "10 minutes", idle_ms: int = 600_000,
) -> DataFrame:
    """(key, start, end, n, v_max, v_mean) of runs of rows that satisfy ``when``.

    A run ends with the first row that does not, or when its series stays silent for ``idle_ms``
    of event time, which also ends its state.  NULL values count in ``n`` only.  Rows older than what
    a series has already consumed, or than the watermark where it has no state, are late and dropped."""
    rows = stream.withWatermark(event_time, delay).select(
        F.col(key).alias("key"), F.col(event_time).alias("at"), F.unix_micros(event_time).alias("us"),
        F.col(seq).alias("seq"), F.coalesce(when, F.lit(False)).alias("hit"), value.cast("double").alias("v"),
    )
    key_type = rows.schema["key"].dataType.simpleString()

    def step(keys: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """An open run is (start, end, n, values, v_max, v_sum); n is 0 when none is open."""
        now = state.getCurrentWatermarkMs()
        *run, seen = state.get if state.exists else (0, 0, 0, 0, np.nan, 0.0, now * 1000)
        if state.hasTimedOut:
            state.remove()
            runs = pd.DataFrame([run], columns=_RUN)
        else:
            # one micro-batch of one series; its size is bounded by the trigger
            batch = pd.concat(list(frames)).sort_values(["us", "seq"])
            batch = batch[batch["us"] >= seen]
            runs, run = _join_runs(run, batch)
            seen = int(batch["us"].iloc[-1]) if len(batch) else seen
            state.update((*(int(x) for x in run[:4]), float(run[4]), float(run[5]), int(seen)))
            state.setTimeoutTimestamp(max(int(seen // 1000), now) + idle_ms)
        runs = runs[(runs["n"] > 0) & (runs["end"] - runs["start"] >= min_duration_us)]
        if len(runs):
            mean = (runs["v_sum"] / runs["values"]).where(runs["values"] > 0)
            yield runs.assign(key=keys[0], v_mean=mean)[["key", "start", "end", "n", "v_max", "v_mean"]]

    return rows.groupBy("key").applyInPandasWithState(
        step, f"key {key_type}, start long, end long, n long, v_max double, v_mean double", _STATE, "append",
        GroupStateTimeout.EventTimeTimeout,
    ).withColumnRenamed("key", key)
