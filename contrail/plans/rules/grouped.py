"""Rules on groups of violating rows.  All rules of one table run in one pass over it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.operators.runs import Check, gradient, rolling_mean_padded, violation_groups
from contrail.operators.series import Series
from contrail.plans.rules.common import Telemetry, emit, fmt
from contrail.schema import TS

SECOND = 1_000_000
MIN_CELL_V = 3.3
FULL_CELL_V = 4.2
SPIKE_FACTOR, SPIKE_WINDOW = 2.5, 20


@dataclass(frozen=True)
class GroupRule:
    """One threshold of a rule.  ``text`` is a printf format filled from ``args``, names out of
    mean, max, seconds, worst, peak, aside, ratio, cells."""

    rule: str
    category: str
    table: str
    field: str
    when: Callable[[], Column]
    severity: str
    text: str
    args: tuple[str, ...] = ()
    min_us: int = 0
    gap: int = 1
    aside: str | None = None
    raw: str = "level"  # level: max and mean of the field; worst / peak: the extreme value
    hint: str = ""


def _above(field: str, limit: float) -> Callable[[], Column]:
    return lambda: F.col(field) > limit


def _below(field: str, limit: float) -> Callable[[], Column]:
    return lambda: F.col(field) < limit


def _beyond(field: str, limit: float) -> Callable[[], Column]:
    return lambda: F.abs(field) > limit


_SAG_HINT = "Compare throttle outputs and current at the same time"
_CLIP_HINT = "State estimates of this interval rest on cut-off accelerations"

# Rule names, thresholds, durations and severities.
GROUP_RULES: list[GroupRule] = [
    GroupRule("EKF_INNOV_VEL", "EKF", "NKF4|XKF4", "var_ratio_vel", _above("var_ratio_vel", 0.5), "WARNING",
              "Velocity test ratio averaged %.2f over %.1f s (limit 0.5)",
              ("mean", "seconds"), 5 * SECOND),
    GroupRule("EKF_INNOV_VEL", "EKF", "NKF4|XKF4", "var_ratio_vel", _above("var_ratio_vel", 1.0), "CRITICAL",
              "Velocity test ratio reached %.2f within %.1f s above 1.0; velocity updates are refused",
              ("max", "seconds"), 2 * SECOND),
    GroupRule("EKF_INNOV_POS", "EKF", "NKF4|XKF4", "var_ratio_pos", _above("var_ratio_pos", 1.0), "CRITICAL",
              "Position test ratio reached %.2f within %.1f s above 1.0", ("max", "seconds"), 2 * SECOND),
    GroupRule("EKF_HEIGHT_INNOV", "EKF", "NKF4|XKF4", "var_ratio_hgt", _above("var_ratio_hgt", 1.0), "WARNING",
              "Height test ratio stayed above 1.0 during %.1f s; the height sources differ",
              ("seconds",), 3 * SECOND),
    *[
        GroupRule("EKF_POS_OFFSET_GROWTH", "EKF", "NKF4|XKF4", c, _beyond(c, 5.0), "WARNING",
                  f"{c} stayed beyond 5 m during %.1f s", ("seconds",), 2 * SECOND)
        for c in ("offset_n", "offset_e")
    ],
    GroupRule("EKF_MAG_INNOV", "EKF", "NKF3|XKF3", "innov_heading", _beyond("innov_heading", 0.3), "WARNING",
              "Heading residual averaged %.3f rad over %.1f s (limit 0.3)",
              ("mean", "seconds"), 5 * SECOND),
    GroupRule("GPS_HDOP_DEGRADATION", "GPS", "GPS", "hdop", _above("hdop", 2.0), "WARNING",
              "Horizontal dilution averaged %.2f over %.1f s (limit 2)",
              ("mean", "seconds"), 10 * SECOND),
    GroupRule("GPS_HDOP_DEGRADATION", "GPS", "GPS", "hdop", _above("hdop", 5.0), "CRITICAL",
              "Horizontal dilution reached %.2f within %.1f s above 5",
              ("max", "seconds"), 5 * SECOND),
    GroupRule("GPS_LOW_SAT_COUNT", "GPS", "GPS", "num_sats", _below("num_sats", 8), "WARNING",
              "On average %.1f satellites during %.1f s, fewer than 8 throughout", ("mean", "seconds"), 15 * SECOND),
    GroupRule("GPS_FIX_DROP", "GPS", "GPS", "fix_type", _below("fix_type", 3), "CRITICAL",
              "No 3-D fix (type %.0f) during %.1f s",
              ("mean", "seconds"), 3 * SECOND),
    GroupRule("BAT_LOW_CAPACITY", "POWER", "BAT", "remaining_pct", _below("remaining_pct", 20.0), "WARNING",
              "Remaining charge averaged %.1f %% over %.1f s (limit 20 %%)", ("mean", "seconds"), 5 * SECOND),
    GroupRule("BAT_LOW_CAPACITY", "POWER", "BAT", "remaining_pct", _below("remaining_pct", 10.0), "CRITICAL",
              "Remaining charge averaged %.1f %% over %.1f s (limit 10 %%)", ("mean", "seconds"), 2 * SECOND),
    *[
        rule
        for c, axis in (("vibe_x", "X"), ("vibe_y", "Y"), ("vibe_z", "Z"))
        for rule in (
            GroupRule("VIBE_HIGH_RMS", "VIBRATION", "VIBE", c, _above(c, 15.0), "WARNING",
                      f"Vibration along {axis} averaged %.1f m/s² over %.1f s (limit 15)",
                      ("mean", "seconds"), 5 * SECOND),
            GroupRule("VIBE_HIGH_RMS", "VIBRATION", "VIBE", c, _above(c, 30.0), "CRITICAL",
                      f"Vibration along {axis} reached %.1f m/s² within %.1f s above 30",
                      ("max", "seconds"), 3 * SECOND),
        )
    ],
    *[
        GroupRule("MOTOR_OUTPUT_SATURATION", "MOTOR", "RCOU", c, _above(c, 1950), "CRITICAL",
                  f"Output {c} held above 1950 µs during %.1f s, nothing left to correct with",
                  ("seconds",), 2 * SECOND)
        for c in ("ch1_us", "ch2_us", "ch3_us", "ch4_us")
    ],
    *[
        rule
        for c in ("clip0", "clip1", "clip2")
        for rule in (
            GroupRule("IMU_CLIPPING", "VIBRATION", "VIBE", f"{c}_rate", _above(f"{c}_rate", 100), "CRITICAL",
                      f"{c} counts %.0f clipped samples a second (limit 100)",
                      ("peak",), gap=5, raw="peak", hint=_CLIP_HINT),
            GroupRule("IMU_CLIPPING", "VIBRATION", "VIBE", f"{c}_rate",
                      lambda c=c: (F.col(f"{c}_rate") > 50) & (F.col(f"{c}_rate") <= 100), "WARNING",
                      f"{c} counts %.0f clipped samples a second (limit 50)",
                      ("peak",), gap=5, raw="peak", hint=_CLIP_HINT),
        )
    ],
    GroupRule("BAT_VOLTAGE_SAG", "POWER", "BAT|CURR", "dv_dt", _below("dv_dt", -1.0), "WARNING",
              "Voltage changes by %.2f V a second (limit -1)", ("worst",), gap=3, raw="worst", hint=_SAG_HINT),
    GroupRule("BAT_VOLTAGE_SAG", "POWER", "BAT|CURR", "dv_dt", _below("dv_dt", -3.0), "CRITICAL",
              "Voltage changes by %.2f V a second (limit -3)", ("worst",), gap=3, raw="worst", hint=_SAG_HINT),
    GroupRule("BAT_BROWNOUT", "POWER", "BAT|CURR", "voltage_v",
              lambda: F.col("voltage_v") < F.col("cells") * MIN_CELL_V, "CRITICAL",
              "Voltage under %.1f V, the least for %.0f cells, during %.1f s",
              ("floor", "aside", "seconds"), SECOND // 2, aside="cells",
              hint="Look for outputs or estimates that fail at the same time"),
    GroupRule("BAT_CURRENT_SPIKE", "POWER", "BAT|CURR", "current_a",
              lambda: (F.col("_rows") >= 2 * SPIKE_WINDOW) & (F.col("current_a") > F.col("baseline_a") * SPIKE_FACTOR),
              "WARNING",
              "Current of %.1f A is %.1f times its moving mean of %.1f A",
              ("peak", "ratio", "aside"), gap=5, aside="baseline_a", raw="peak",
              hint="Find the output or speed controller that draws it"),
]


def _clip_rates(s: Series) -> Series:
    s = s.shift({"_t0": TS}, {"_t1": TS})
    dt = F.greatest(F.coalesce(F.col(TS) - F.col("_t0"), F.col("_t1") - F.col(TS)) / 1e6, F.lit(0.001))
    dt = F.when(F.col("_t0").isNotNull() | F.col("_t1").isNotNull(), dt)
    return s.with_columns({f"{c}_rate": F.col(c) / dt for c in ("clip0", "clip1", "clip2")})


def _battery(s: Series, rules: set[str]) -> Series:
    s = s.totals({"_rows": F.count(F.lit(1)), "_vmax": F.max("voltage_v")})
    s = s.with_columns({"cells": F.greatest(F.lit(1.0), F.bround(F.col("_vmax") / FULL_CELL_V))})
    if "BAT_VOLTAGE_SAG" in rules:
        s = gradient(s, "voltage_v", "dv_dt")
        s = s.with_columns({"dv_dt": F.when(F.col("_rows") >= 3, F.col("dv_dt"))})
    if "BAT_CURRENT_SPIKE" in rules:
        s = rolling_mean_padded(s, "current_a", SPIKE_WINDOW, "baseline_a")
        s = s.with_columns({"baseline_a": F.greatest(F.col("baseline_a"), F.lit(1.0))})
    return s


def _prepare(t: Telemetry, table: str, rules: set[str]) -> Series:
    s = t.series(table)
    if table == "VIBE" and "IMU_CLIPPING" in rules:
        return _clip_rates(s)
    return _battery(s, rules) if table == "BAT|CURR" else s


def grouped_anomalies(t: Telemetry, wanted: Iterable[str] | None = None) -> list[DataFrame]:
    """One DataFrame per input table; every wanted rule of the table shares its pass."""
    wanted = set(wanted) if wanted is not None else {r.rule for r in GROUP_RULES}
    out = []
    for table in dict.fromkeys(r.table for r in GROUP_RULES):
        rules = [r for r in GROUP_RULES if r.table == table and r.rule in wanted]
        if not rules or not t.has(table):
            continue
        s = _prepare(t, table, {r.rule for r in rules})
        checks = [
            Check(str(i), r.when(), F.col(r.field), r.min_us, r.gap, F.col(r.aside) if r.aside else None)
            for i, r in enumerate(rules)
        ]
        out.append(_to_anomalies(violation_groups(s, checks), rules))
    return out


def _to_anomalies(groups: DataFrame, rules: list[GroupRule]) -> DataFrame:
    peak = F.col("v_max")
    values = {
        "mean": F.col("v_mean"), "max": peak, "peak": peak, "worst": F.col("v_min"), "aside": F.col("aside"),
        "ratio": F.try_divide(peak, F.col("aside")), "floor": F.col("aside") * MIN_CELL_V,
        "seconds": (F.col("end") - F.col("start")) / 1e6,
    }

    def per_rule(pick: Callable[[GroupRule], Column]) -> Column:
        picked = None
        for i, r in enumerate(rules):
            hit = F.col("check") == str(i)
            picked = F.when(hit, pick(r)) if picked is None else picked.when(hit, pick(r))
        return picked

    def raw(r: GroupRule) -> Column:
        items = {
            "level": {f"{r.field}_max": peak, f"{r.field}_mean": F.col("v_mean")},
            "worst": {f"{r.field}_worst": F.col("v_min")},
            "peak": {"peak": peak, **({r.aside: F.col("aside")} if r.aside else {})},
        }[r.raw]
        return F.map_from_arrays(F.array(*[F.lit(k) for k in items]), F.array(*[v.cast("double") for v in items.values()]))

    return emit(
        groups,
        per_rule(lambda r: F.lit(r.rule)), per_rule(lambda r: F.lit(r.category)), per_rule(lambda r: F.lit(r.severity)),
        per_rule(lambda r: fmt(r.text, *[values[a] for a in r.args])),
        ts="start", end=F.col("end"), channel=per_rule(lambda r: F.lit(r.field.removesuffix("_rate"))),
        raw=per_rule(raw), hint=per_rule(lambda r: F.lit(r.hint)),
    )
