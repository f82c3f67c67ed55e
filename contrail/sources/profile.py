"""Log profiles: what each flight's log holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.functions.text import names_firmware, vehicle_class_in
from contrail.schema import CRITICAL_TYPES, FLIGHT


def type_profile(messages: DataFrame, ts: str, mtype: str = "msg_type", key: str = FLIGHT) -> DataFrame:
    """Long form: (flight, type, n, rate_hz); rate is n over the duration of the whole log."""
    per_type = messages.where(F.col(mtype) != "BAD_DATA").groupBy(key, mtype).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi")
    )
    span = per_type.groupBy(key).agg((F.max("_hi") - F.min("_lo")).alias("_span"))
    rate = F.when(F.col("_span") > 0, F.col("n") / (F.col("_span") / 1e6))
    return per_type.join(span, key).select(key, mtype, "n", rate.alias("rate_hz"))


def log_profile(messages: DataFrame, ts: str, text: str | None = None, autopilot: str = "ardupilot",
                mtype: str = "msg_type", key: str = FLIGHT, seq: str = "seq", parameter_type: str = "PARM",
                text_type: str = "MSG") -> DataFrame:
    """One row per flight.  Messages collapse to one row per type before anything is gathered."""
    rows = messages.where(F.col(mtype) != "BAD_DATA")
    note = F.col(text) if text else F.lit(None).cast("string")
    named = (F.col(mtype) == text_type) & names_firmware(note)
    order = F.struct(ts, seq)
    per_type = rows.groupBy(key, mtype).agg(
        F.count(F.lit(1)).alias("n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"),
        F.max_by(note, F.when(named, order)).alias("_fw"),
        F.max_by(vehicle_class_in(note), F.when(named & vehicle_class_in(note).isNotNull(), order)).alias("_vc"),
    )
    entry = F.struct(F.col(mtype), F.col("n"))
    out = per_type.groupBy(key).agg(
        F.coalesce(F.min("_lo"), F.lit(0)).alias("log_start_us"), F.coalesce(F.max("_hi"), F.lit(0)).alias("log_end_us"),
        F.sort_array(F.collect_list(mtype)).alias("message_types"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("message_counts"),
        F.coalesce(F.max(F.when(F.col(mtype) == parameter_type, F.col("n"))), F.lit(0)).alias("parameter_count"),
        F.trim(F.max("_fw")).alias("firmware_version"), F.coalesce(F.max("_vc"), F.lit("unknown")).alias("vehicle_class"),
    )
    span = F.col("log_end_us") - F.col("log_start_us")
    wanted = F.array(*[F.lit(t) for t in CRITICAL_TYPES.get(autopilot, [])]).cast("array<string>")
    return out.withColumns({
        "duration_us": span, "autopilot": F.lit(autopilot),
        "sample_rates_hz": F.when(span > 0, F.transform_values("message_counts", lambda _, n: n / (span / 1e6)))
        .otherwise(F.create_map().cast("map<string,double>")),
        "missing_critical": F.array_except(wanted, F.col("message_types")),
    })
