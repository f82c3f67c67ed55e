"""Loading the test tables and turning events into telemetry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.operators.series import Series, open_series
from contrail.plans.rules.common import Telemetry
from contrail.schema import FLIGHT_MODES

HOUR, DAY = 3_600_000_000, 86_400_000_000
EPOCH_US = 1_704_067_200_000_000  # first day of the events table
ORDER = ["ts_us", "event_id"]
USER = ["user_id"]


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None  # None: rows-only check, the tests compare with brute force


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def micros(column: str) -> Column:
    """Microseconds of a zone-less timestamp, whatever zone the session has."""
    return F.unix_micros(F.from_utc_timestamp(F.col(column).cast("timestamp"), F.current_timezone()))


def events(spark: SparkSession, sf: str) -> DataFrame:
    """user_id, ts_us, event_id, event_type, value, k."""
    return load(spark, sf, "events").select(
        "user_id", micros("ts").alias("ts_us"), "event_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


EV = """ev AS (SELECT user_id, epoch_us(ts) AS ts_us, event_id, event_type, value,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""


def event_series(spark: SparkSession, sf: str, where: str | None = None) -> Series:
    df = events(spark, sf)
    return open_series(df.where(where) if where else df, USER, ORDER)


def rounded(column: str | Column, digits: int = 8) -> Column:
    return F.round(column, digits)


# -- telemetry derived from events -----------------------------------------------------------------
# Times are scaled so that a month of events becomes a few minutes of flight.  The expressions are
# plain arithmetic understood by Spark and by the checking engine alike.

_PARAMS = ["EK3_CHECK_SCALE", "GPS_HDOP_GOOD", "BATT_LOW_VOLT", "BATT_CRT_VOLT", "FS_THR_ENABLE", "INS_GYRO_FILTER",
           "FS_GCS_ENABLE", "FS_EKF_ACTION", "FENCE_ENABLE", "INS_ACCEL_FILTER"]


def _case(code: str, names: dict[int, str], other: str) -> str:
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"


_MODES = {k: v for k, v in FLIGHT_MODES.items() if k < 10} | {8: "INITIALISING"}
# Literals carry an exponent so that both engines read them as doubles.
TELEMETRY: dict[str, tuple[str, dict[str, str]]] = {
    "NKF4": ("event_type <> 'signup'", {
        "var_ratio_vel": "value / 80", "var_ratio_pos": "value / 60", "var_ratio_hgt": "value / 50",
        "offset_n": "(k - 50) / 6e0", "offset_e": "value / 20", "lane": "CAST(floor(k / 40) AS INT)"}),
    "NKF3": ("true", {"innov_heading": "(k - 50) / 8e1", "innov_vel_n": "(value - 50) / 60", "innov_vel_e": "(k - 50) / 22e0",
                      "innov_vel_d": "value / 100"}),
    "GPS": ("true", {"hdop": "value / 25", "num_sats": "CAST(4 + k % 13 AS INT)", "fix_type": "CAST(k % 5 AS INT)",
                     "lat_deg": "-35 + k * 1e-4", "lng_deg": "149 + value * 1e-6", "gnd_speed_m_s": "k / 1e1",
                     "alt_rel_m": "value / 4", "speed_acc_m_s": "k / 5e1"}),
    "BAT": ("true", {"voltage_v": "10 + k * 7e-2", "current_a": "value", "remaining_pct": "k * 1e0", "consumed_mah": "k * 1e1"}),
    "VIBE": ("true", {"vibe_x": "value / 3", "vibe_y": "k / 4e0", "vibe_z": "value / 2", "clip0": "CAST(k * k AS INT)",
                      "clip1": "CAST(k * 3 AS INT)", "clip2": "CAST(0 AS INT)"}),
    "IMU": ("true", {"acc_x_m_s2": "value / 5", "acc_y_m_s2": "k / 1e1", "acc_z_m_s2": "981e-2 + value / 50"}),
    "RCOU": ("true", {"ch1_us": "1000 + value * 10", "ch2_us": "1000 + k * 1e1", "ch3_us": "1930 + k * 0e0", "ch4_us": "2100 - k * 1e1"}),
    "ATT": ("value < 60 or value > 130", {"roll_deg": "(k - 50) * (k - 50) * (k - 50) / 2e3", "pitch_deg": "(value - 50) / 6"}),
    "ESC": ("true", {"rpm": "400 + k * 6e1"}),
    "MODE": ("event_type <> 'error'", {"mode_num": "CAST(k % 10 AS INT)", "mode_name": _case("k % 10", _MODES, "'UNKNOWN'"),
                                       "reason": "CAST(k % 12 AS INT)"}),
    "ERR": ("event_type = 'error'", {"subsys": "CAST(k % 25 AS INT)", "ecode": "CAST(k % 3 AS INT)"}),
    "PARM": ("event_type = 'signup'", {"name": _case("k % 10", dict(enumerate(_PARAMS)), "''"), "value": "value / 8"}),
    "CMD": ("event_type = 'purchase'", {"cmd_num": "CAST(k AS INT)"}),
}
FLIGHT_KEYS = {"user": "user_id", "type": "event_type"}


def telemetry(spark: SparkSession, sf: str, by: str = "user") -> Telemetry:
    """Every event row becomes a row of each table; a flight is a user or an event type."""
    base = events(spark, sf)
    head = [f"CAST({FLIGHT_KEYS[by]} AS STRING) AS flight_id", f"(ts_us - {EPOCH_US}) div 10000 AS timestamp_us", "event_id AS seq"]
    tables = {
        t: base.where(cond).selectExpr(*head, *[f"{x} AS {n}" for n, x in cols.items()])
        for t, (cond, cols) in TELEMETRY.items()
    }
    return Telemetry(spark, tables)


def telemetry_sql(*tables: str, by: str = "user") -> str:
    """The same tables as common table expressions."""
    parts = [EV]
    for t in tables:
        cond, cols = TELEMETRY[t]
        exprs = ", ".join(f"{x} AS {n}" for n, x in cols.items())
        parts.append(
            f"{t} AS (SELECT CAST({FLIGHT_KEYS[by]} AS VARCHAR) AS flight_id, (ts_us - {EPOCH_US}) // 10000 AS timestamp_us, "
            f"event_id AS seq, {exprs} FROM ev WHERE {cond})"
        )
    return "WITH " + ",\n".join(parts)


def groups_sql(src: str, cond: str, value: str, key: str = "flight_id", ts: str = "timestamp_us", seq: str = "seq",
               min_duration: int = 0, gap: int = 1, aside: str = "NULL") -> str:
    """Groups of rows that meet ``cond`` and lie at most ``gap`` rows apart."""
    return f"""(SELECT {key}, min({ts}) AS start_us, max({ts}) AS end_us, count(*) AS n, max({value}) AS v_max, min({value}) AS v_min,
        avg({value}) AS v_mean, arg_min({aside}, rn) AS aside
      FROM (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY rn) AS grp
        FROM (SELECT *, CASE WHEN rn - lag(rn) OVER (PARTITION BY {key} ORDER BY rn) <= {gap} THEN 0 ELSE 1 END AS fresh
          FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {ts}, {seq}) AS rn FROM {src}) WHERE {cond}))
      GROUP BY {key}, grp HAVING max({ts}) - min({ts}) >= {min_duration})"""
