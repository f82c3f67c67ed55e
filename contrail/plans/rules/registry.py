"""The rule list and how to run it over a fleet."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.plans.rules import mission, rows
from contrail.plans.rules.common import Telemetry
from contrail.plans.rules.grouped import GROUP_RULES, grouped_anomalies
from contrail.schema import ANOMALY, TS, severity_rank

# rule name -> (function, tables it needs)
ROW_RULES: dict[str, tuple[Callable[[Telemetry], DataFrame], tuple[str, ...]]] = {
    "EKF_LANE_SWITCH": (rows.ekf_lane_switch, ("ERR|NKF4|XKF4",)),
    "EKF_VEL_INNOV_SPIKE": (rows.ekf_velocity_spike, ("NKF3|XKF3",)),
    "GPS_SAT_COUNT_DROP": (rows.gps_satellite_drop, ("GPS",)),
    "GPS_POSITION_GLITCH": (rows.gps_position_glitch, ("GPS",)),
    "GPS_SPOOF_INDICATOR": (rows.gps_spoofing_indicator, ("GPS",)),
    "BAT_HIGH_R_INT": (rows.battery_internal_resistance, ("BAT|CURR",)),
    "IMU_RAW_EXTREME": (rows.imu_extreme, ("IMU",)),
    "MOTOR_IMBALANCE": (rows.motor_imbalance, ("RCOU", "ATT")),
    "ESC_DESYNC": (rows.esc_desync, ("ESC",)),
    "MOTOR_OUTPUT_DROP": (rows.motor_output_drop, ("RCOU",)),
    "FAILSAFE_VERIFY": (mission.failsafe_response, ("ERR", "MODE")),
    "UNEXPECTED_MODE_CHANGE": (mission.unexpected_mode_change, ("MODE",)),
    "RTL_BEHAVIOR": (mission.rtl_behavior, ("MODE", "GPS")),
    "UNSAFE_ARM": (mission.unsafe_arm, ("MODE", "GPS")),
}
RULE_NAMES = (*dict.fromkeys(r.rule for r in GROUP_RULES), *ROW_RULES)


def run_rules(t: Telemetry, wanted: Iterable[str] | None = None) -> DataFrame:
    """Anomalies of the wanted rules (all by default).  A rule whose tables are absent yields none."""
    names = set(RULE_NAMES if wanted is None else wanted)
    if unknown := names - set(RULE_NAMES):
        raise ValueError(f"unknown rules: {sorted(unknown)}")
    found = grouped_anomalies(t, names)
    for name, (rule, needs) in ROW_RULES.items():
        if name in names and all(t.has(n) for n in needs):
            found.append(rule(t))
    return reduce(DataFrame.unionByName, found, t.spark.createDataFrame([], ANOMALY))


def in_report_order(anomalies: DataFrame) -> DataFrame:
    """Sorted by time, then severity."""
    return anomalies.orderBy(F.col(TS), severity_rank(), "flight_id", "rule_name", "channel")
