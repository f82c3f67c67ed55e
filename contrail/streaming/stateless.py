"""Row rules and quota windows on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.plans.rules import rows
from contrail.plans.rules.common import Telemetry
from contrail.plans.timeline import error_events

# Fixed values: (limit, window seconds) per action.
QUOTAS = {"investigations": (50, 86_400), "uploads": (100, 3_600)}


def point_anomalies(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Rules that look at one row at a time; the same code serves batch tables and streams."""
    t = Telemetry(spark, tables)
    out = None
    for name, rule in (("IMU", rows.imu_extreme), ("NKF3", rows.ekf_velocity_spike)):
        if name in tables:
            found = rule(t)
            out = found if out is None else out.unionByName(found)
    return out


def error_stream(spark: SparkSession, err: DataFrame) -> DataFrame:
    return error_events(Telemetry(spark, {"ERR": err}))


def window_start(ts_us: Column, width_s: int) -> Column:
    """Start of the fixed window a time falls into, in microseconds."""
    return F.floor(ts_us / (width_s * 1_000_000)) * (width_s * 1_000_000)


def over_quota(events: DataFrame, key: str, action: str, ts_us: str, limit: int, width_s: int) -> DataFrame:
    """(key, action, window_start_us, n) for windows with more than ``limit`` events."""
    start = window_start(F.col(ts_us), width_s).alias("window_start_us")
    return events.groupBy(key, action, start).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)


def over_quota_stream(events: DataFrame, key: str, action: str, ts: str, limit: int, width_s: int, delay: str = "10 minutes") -> DataFrame:
    """The same on a stream with event-time windows; windows close behind the watermark."""
    counted = events.withWatermark(ts, delay).groupBy(F.window(ts, f"{width_s} seconds"), key, action).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > limit).select(key, action, F.unix_micros("window.start").alias("window_start_us"), "n")
