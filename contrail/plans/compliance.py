"""Parameter checks and data-gap flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.plans.metrics import last_values
from contrail.plans.rules.common import Telemetry, emit, fmt
from contrail.schema import FLIGHT, SEQ, TS

DUMP_US = 30_000_000

# Accepted parameter ranges, and the parameters whose breach is critical.
PARAMETER_RANGES = {
    "EK3_CHECK_SCALE": (0.1, 2.0), "GPS_HDOP_GOOD": (1.0, 2.5), "BATT_LOW_VOLT": (13.0, 14.4),
    "BATT_CRT_VOLT": (12.4, 13.6), "FS_THR_ENABLE": (1.0, 3.0), "INS_GYRO_FILTER": (10.0, 50.0),
    "INS_ACCEL_FILTER": (10.0, 50.0),
}
CRITICAL_PARAMETERS = ["BATT_LOW_VOLT", "BATT_CRT_VOLT", "FS_THR_ENABLE"]

# Safety checks (parameter, required value, kind); the wording is ours.
SAFETY_CHECKS = [
    ("FS_THR_ENABLE", 1.0, "eq", "loss of throttle signal is handled"),
    ("FS_GCS_ENABLE", 1.0, "eq", "loss of the ground station is handled"),
    ("FS_EKF_ACTION", None, "nonzero", "a failing estimator has an action"),
    ("GPS_HDOP_GOOD", 2.5, "lte", "accepted dilution is 2.5 or less"),
    ("FENCE_ENABLE", None, "any", "fence setting is logged"),
    ("BATT_LOW_VOLT", None, "nonzero", "first voltage alarm has a level"),
    ("BATT_CRT_VOLT", None, "nonzero", "last voltage alarm has a level"),
    ("EK3_CHECK_SCALE", 1.0, "gte", "estimator checks are not tightened below scale 1"),
]

# Vehicle profile baselines (expected, warning delta, critical delta).
PROFILE_BASELINES = {
    "ardupilot_quad": {
        "EK3_CHECK_SCALE": (1.0, 0.3, 0.5), "GPS_HDOP_GOOD": (2.5, 1.0, 2.0), "BATT_LOW_VOLT": (14.4, 0.8, 1.5),
        "BATT_CRT_VOLT": (13.8, 0.8, 1.5), "FS_THR_ENABLE": (1.0, 0.0, 0.0), "INS_GYRO_FILTER": (20.0, 5.0, 10.0),
        "INS_ACCEL_FILTER": (20.0, 5.0, 10.0), "PILOT_SPEED_UP": (250.0, 100.0, 200.0),
        "WPNAV_SPEED": (500.0, 200.0, 400.0), "RTL_ALT": (1500.0, 500.0, 1000.0),
    },
    "ardupilot_fixedwing": {
        "EK3_CHECK_SCALE": (1.0, 0.3, 0.5), "GPS_HDOP_GOOD": (2.5, 1.0, 2.0), "BATT_LOW_VOLT": (10.5, 0.5, 1.0),
        "BATT_CRT_VOLT": (10.0, 0.5, 1.0), "FS_THR_ENABLE": (1.0, 0.0, 0.0), "INS_GYRO_FILTER": (20.0, 5.0, 10.0),
        "INS_ACCEL_FILTER": (20.0, 5.0, 10.0), "STALL_PREVENTION": (1.0, 0.0, 0.0),
        "NAVL1_PERIOD": (17.0, 5.0, 10.0), "TECS_CLMB_MAX": (5.0, 2.0, 4.0),
    },
}


def initial_parameters(t: Telemetry) -> DataFrame:
    """(flight, name, value, start): last value of each parameter in the first 30 seconds."""
    parm = t.table("PARM").where("name is not null")
    s = t.flight_series(parm, "PARM").totals({"_t0": F.min(TS)})
    early = s.df.where(F.col(TS) <= F.col("_t0") + DUMP_US)
    return last_values(early, [FLIGHT, "name", "_t0"], "value", (TS, SEQ)).withColumnRenamed("_t0", "start_us")


def range_violations(values: DataFrame, flights: DataFrame, ranges=PARAMETER_RANGES, critical=CRITICAL_PARAMETERS, key=FLIGHT) -> DataFrame:
    """(flight, param, issue, severity, actual): missing and out-of-range parameters.

    ``flights`` lists the flights that logged parameters; the range table rides along as literals."""
    specs = F.array(*[
        F.struct(F.lit(n).alias("param"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
        for n, (lo, hi) in ranges.items()
    ])
    wanted = flights.select(key, F.explode(specs).alias("p")).select(key, "p.*")
    have = values.select(key, F.col("name").alias("param"), F.col("value").alias("actual"))
    out = wanted.join(have, [key, "param"], "left")
    issue = F.when(F.col("actual").isNull(), "MISSING").when(~F.col("actual").between(F.col("lo"), F.col("hi")), "OUT_OF_RANGE")
    sev = F.when(F.col("actual").isNull(), "INFO").when(F.col("param").isin(critical), "CRITICAL").otherwise("WARNING")
    return out.withColumns({"issue": issue, "severity": sev}).where("issue is not null").select(
        key, "param", "issue", "severity", "actual", "lo", "hi"
    )


def parameter_drift(t: Telemetry) -> DataFrame:
    """PARAM_OUT_OF_RANGE anomalies at the start of the parameter dump."""
    values = initial_parameters(t)
    starts = values.groupBy(FLIGHT).agg(F.min("start_us").alias("start_us"))
    bad = range_violations(values, starts).where("issue = 'OUT_OF_RANGE'").join(starts, FLIGHT)
    actual = F.col("actual").cast("string")
    return emit(
        bad, "PARAM_OUT_OF_RANGE", "PARAMETERS", F.col("severity"),
        fmt("%s is set to %s, outside %s to %s", "param", actual, F.col("lo").cast("string"), F.col("hi").cast("string")),
        ts="start_us", channel=F.col("param"), raw={"value": F.col("actual")}, labels={"param": F.col("param")},
    )


def safety_results(values: DataFrame, flights: DataFrame, checks=SAFETY_CHECKS, key=FLIGHT) -> DataFrame:
    """(flight, parameter, result, ...): violation, warning (not logged) or compliant per check."""
    specs = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(p).alias("parameter"), F.lit(r).cast("double").alias("required"),
                 F.lit(k).alias("check"), F.lit(d).alias("description"))
        for i, (p, r, k, d) in enumerate(checks)
    ])
    wanted = flights.select(key, F.explode(specs).alias("c")).select(key, "c.*")
    have = values.select(key, F.col("name").alias("parameter"), F.col("value").alias("actual"))
    actual, required, kind = F.col("actual"), F.col("required"), F.col("check")
    passed = (
        F.when(kind == "nonzero", actual != 0).when(kind == "eq", actual == required)
        .when(kind == "lte", actual <= required).when(kind == "gte", actual >= required).otherwise(F.lit(True))
    )
    result = F.when(actual.isNull(), "warning").when(passed, "compliant").otherwise("violation")
    return wanted.join(have, [key, "parameter"], "left").withColumn("result", result)


def safety_audit(t: Telemetry) -> DataFrame:
    """Safety checks on the last value of each parameter in the whole log."""
    values = last_values(t.table("PARM").where("name <> ''"), [FLIGHT, "name"], "value")
    return safety_results(values, values.select(FLIGHT).distinct())


def profile_deviation(values: DataFrame, profile: str, key: str = FLIGHT) -> DataFrame:
    """Parameters that differ from the vehicle profile by more than a delta."""
    base = PROFILE_BASELINES[profile]
    listed = F.create_map(*[
        c for n, (e, w, k) in base.items()
        for c in (F.lit(n), F.struct(F.lit(e).alias("expected"), F.lit(w).alias("warn"), F.lit(k).alias("crit")))
    ])
    spec = F.try_element_at(listed, F.col("name"))
    rows = values.select(key, "name", "value", spec.alias("spec")).where("spec is not null")
    off = F.abs(F.col("value") - F.col("spec.expected"))
    sev = F.when(off > F.col("spec.crit"), "CRITICAL").when(off > F.col("spec.warn"), "WARNING")
    return rows.select(key, "name", "value", F.col("spec.expected").alias("expected"), sev.alias("severity")).where("severity is not null")


def data_gaps(t: Telemetry, flights: DataFrame) -> DataFrame:
    """Which flights carry motor and parameter data, and the confidence that leaves."""
    def flag(table: str, name: str) -> DataFrame:
        return t.table(table).select(FLIGHT).distinct().withColumn(name, F.lit(True))

    out = flights.select(FLIGHT).distinct()
    for table, name in (("ESC", "has_esc_telemetry"), ("PARM", "has_parameters")):
        out = out.join(flag(table, name), FLIGHT, "left").fillna({name: False})
    return out.withColumns({
        "esc_confidence": F.when(F.col("has_esc_telemetry"), 0.80).otherwise(0.40),
        "parameter_confidence": F.when(F.col("has_parameters"), 0.85).otherwise(0.20),
        "esc_data_gap": F.when(~F.col("has_esc_telemetry"), "no rows of speed controllers"),
        "parameter_data_gap": F.when(~F.col("has_parameters"), "no parameter rows"),
    })
