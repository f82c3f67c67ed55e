"""Rules on failsafe responses, mode changes, return flight and arming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.operators.align import following_join
from contrail.operators.runs import first_rows
from contrail.plans.rules.common import Telemetry, emit, fmt
from contrail.schema import FLIGHT, ORDER, SEQ, TS, code_name
from contrail.session import broadcast_if_small

# Failsafe codes and the modes each should lead to.
FAILSAFES = {5: "FAILSAFE_RADIO", 6: "FAILSAFE_BATT", 7: "FAILSAFE_GPS", 8: "FAILSAFE_GCS", 9: "FAILSAFE_FENCE"}
EXPECTED_MODES = {5: [6, 9], 6: [6, 9], 7: [6], 8: [6], 9: [6, 9]}
AUTONOMOUS_REASONS = [4, 5, 6, 7, 8, 9, 10, 11]


def failsafe_response(t: Telemetry) -> DataFrame:
    """A failsafe error must be followed by a mode row, and by an expected one, within 3 s.

    Only the first row and the first expected row after the error matter, so no pairs are formed."""
    mode = t.table("MODE").where("mode_num is not null")
    logged = broadcast_if_small(mode.select(FLIGHT).distinct())
    err = t.table("ERR").where(F.col("subsys").isin(list(FAILSAFES))).join(logged, FLIGHT, "left_semi")
    others = {"any": (mode, ["mode_num"])}
    for modes in {tuple(m) for m in EXPECTED_MODES.values()}:
        others["to_" + "_".join(map(str, modes))] = (mode.where(F.col("mode_num").isin(list(modes))), ["mode_num"])
    rows = following_join(
        err.select(FLIGHT, *ORDER, "subsys", "ecode"), others, [FLIGHT], 3_000_000, max_rows=t.max_rows
    )
    name = code_name(F.col("subsys"), FAILSAFES, F.concat(F.lit("FAILSAFE_"), F.col("subsys").cast("string")))
    good = F.coalesce(*[
        F.when(F.col("subsys") == k, F.col("to_" + "_".join(map(str, m))).isNotNull()) for k, m in EXPECTED_MODES.items()
    ])
    wanted = F.coalesce(*[F.when(F.col("subsys") == k, F.lit(", ".join(map(str, m)))) for k, m in EXPECTED_MODES.items()])
    silent = emit(
        rows.where(F.col("any").isNull()), "FAILSAFE_VERIFY", "FAILSAFE", "CRITICAL",
        fmt("No mode row follows %s within 3 s", name),
        raw={"subsys": F.col("subsys"), "ecode": F.col("ecode")},
    )
    odd = emit(
        rows.where(F.col("any").isNotNull() & ~good), "FAILSAFE_VERIFY", "FAILSAFE", "WARNING",
        fmt("After %s came mode %d, none of %s", name, "any.mode_num", wanted),
        raw={"subsys": F.col("subsys"), "response_mode": F.col("any.mode_num"), "ecode": F.col("ecode")},
    )
    return silent.unionByName(odd)


def unexpected_mode_change(t: Telemetry) -> DataFrame:
    s = t.flight_series(t.table("MODE"), "MODE").shift({"_mode0": "mode_num"})
    name = F.coalesce("mode_name", F.concat(F.lit("MODE_"), F.col("mode_num").cast("string")))
    return emit(
        s.df.where(F.col("_mode0").isNotNull() & F.col("reason").isin(AUTONOMOUS_REASONS)),
        "UNEXPECTED_MODE_CHANGE", "FAILSAFE", "INFO",
        fmt("Vehicle itself chose %s (reason %d)", name, "reason"),
        raw={"mode": F.col("mode_num"), "prev_mode": F.col("_mode0"), "reason": F.col("reason")},
    )


def rtl_behavior(t: Telemetry) -> DataFrame:
    """Altitude over the first ten fixes after the first RTL mode row."""
    start = t.table("MODE").where("mode_name = 'RTL'").groupBy(FLIGHT).agg(F.min(TS).alias("_rtl"))
    gps = t.table("GPS").where("alt_rel_m is not null").select(FLIGHT, TS, SEQ, "alt_rel_m")
    near = gps.join(broadcast_if_small(start), FLIGHT).where(
        (F.col(TS) >= F.col("_rtl")) & (F.col(TS) <= F.col("_rtl") + 30_000_000)
    )
    g = first_rows(near, [FLIGHT, "_rtl"], [TS, SEQ], 10).groupBy(FLIGHT, "_rtl").agg(
        F.count(F.lit(1)).alias("_n"), F.min_by("alt_rel_m", F.struct(TS, SEQ)).alias("_alt0"),
        F.min("alt_rel_m").alias("_low"),
    )
    bad = g.where((F.col("_n") > 5) & (F.col("_alt0") > 5.0) & (F.col("_low") < F.col("_alt0") * 0.7))
    return emit(
        bad, "RTL_BEHAVIOR", "FAILSAFE", "CRITICAL",
        fmt("Height fell from %.1f m to %.1f m as the return began", "_alt0", "_low"),
        ts="_rtl", raw={"initial_alt_m": F.col("_alt0"), "min_alt_m": F.col("_low")},
        hint="A wrong home or position estimate leads the return astray",
    )


def unsafe_arm(t: Telemetry) -> DataFrame:
    """Fix quality from 5 s before to 2 s after the first mode row past initialising."""
    arm = t.table("MODE").where("mode_name is not null and mode_name <> 'INITIALISING'").groupBy(FLIGHT).agg(
        F.min(TS).alias("_arm")
    )
    g = t.table("GPS").select(FLIGHT, TS, "fix_type").join(broadcast_if_small(arm), FLIGHT).where(
        F.col(TS).between(F.col("_arm") - 5_000_000, F.col("_arm") + 2_000_000)
    )
    low = g.groupBy(FLIGHT, "_arm").agg(F.min("fix_type").alias("_fix")).where("_fix < 3")
    return emit(
        low, "UNSAFE_ARM", "FAILSAFE", "WARNING",
        fmt("Left initialising with fix type %d, below 3", "_fix"),
        ts="_arm", raw={"fix_type_at_arm": F.col("_fix")},
    )
