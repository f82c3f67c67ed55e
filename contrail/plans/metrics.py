"""Per-flight metrics, summaries and comparison with a baseline population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.plans.rules.common import Telemetry
from contrail.schema import FLIGHT, SEQ, TS, severity_rank


def gps_metrics(t: Telemetry) -> DataFrame:
    return t.table("GPS").groupBy(FLIGHT).agg(
        F.avg("hdop").alias("hdop_mean"), F.max("hdop").alias("hdop_max"), F.min("hdop").alias("hdop_min"),
        F.min("num_sats").alias("sat_count_min"), F.avg("num_sats").alias("sat_count_mean"),
        F.min("fix_type").alias("fix_type_min"), F.max("speed_acc_m_s").alias("speed_acc_max"),
    )


def power_metrics(t: Telemetry) -> DataFrame:
    return t.table("BAT|CURR").groupBy(FLIGHT).agg(
        F.min("voltage_v").alias("voltage_min"), F.max("voltage_v").alias("voltage_max"),
        F.avg("voltage_v").alias("voltage_mean"), F.max("current_a").alias("current_max"),
        F.avg("current_a").alias("current_mean"), F.min("remaining_pct").alias("remaining_min_pct"),
        F.max("consumed_mah").alias("consumed_mah_total"),
    )


def filter_metrics(t: Telemetry) -> DataFrame:
    s = t.series("NKF4|XKF4").shift({"_lane0": "lane"})
    ratios = s.df.groupBy(FLIGHT).agg(
        F.max("var_ratio_vel").alias("max_vel_ivr"), F.avg("var_ratio_vel").alias("mean_vel_ivr"),
        F.max("var_ratio_pos").alias("max_pos_ivr"), F.max("var_ratio_hgt").alias("max_hgt_ivr"),
        F.coalesce(F.sum(F.abs(F.col("lane") - F.col("_lane0"))), F.lit(0)).alias("lane_switches"),
    )
    heading = t.table("NKF3|XKF3").groupBy(FLIGHT).agg(F.max(F.abs("innov_heading")).alias("max_heading_innov_rad"))
    out = ratios.join(heading, FLIGHT, "full")
    return out.withColumn("lane_switches", F.coalesce("lane_switches", F.lit(0)))


def anomaly_counts(anomalies: DataFrame, key: str = FLIGHT) -> DataFrame:
    """Long form: (flight, dimension, item, n) for categories and severities, from one pass."""
    both = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).alias("item")) for d in ("category", "severity")
    ])
    rows = anomalies.select(key, F.explode(both).alias("d")).select(key, "d.*")
    return rows.groupBy(key, "dimension", "item").agg(F.count(F.lit(1)).alias("n"))


def anomaly_summary(anomalies: DataFrame, key: str = FLIGHT) -> DataFrame:
    """Total, first critical time, fatal flag and both count maps, one row per flight.

    Counts are aggregated before they are gathered, so each map has one entry per category."""
    heads = anomalies.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.min(F.when(F.col("severity").isin("CRITICAL", "FATAL"), F.col(TS))).alias("first_critical_us"),
        F.max(F.col("severity") == "FATAL").alias("has_fatal"),
    )
    counts = anomaly_counts(anomalies, key)

    def as_map(dimension: str) -> DataFrame:
        entries = F.collect_list(F.struct("item", "n"))
        return counts.where(F.col("dimension") == dimension).groupBy(key).agg(
            F.map_from_entries(F.sort_array(entries)).alias(f"by_{dimension}")
        )

    return heads.join(as_map("category"), key, "left").join(as_map("severity"), key, "left")


def dedupe(anomalies: DataFrame, keys: Sequence[str] = (FLIGHT, "rule_name", TS), tie: Sequence[str] = ("channel",)) -> DataFrame:
    """One anomaly per (flight, rule, time): the most severe, then the first by ``tie``.

    Written as an aggregate, not a window, so duplicates collapse before the exchange."""
    rest = [c for c in anomalies.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(severity_rank(), *tie)).alias("_best")
    return anomalies.groupBy(*keys).agg(best).select(*keys, "_best.*").select(*anomalies.columns)


def last_values(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str] = (TS, SEQ)) -> DataFrame:
    """Latest non-NULL value per key."""
    rows = df.where(F.col(value).isNotNull())
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def command_counts(t: Telemetry) -> DataFrame:
    return t.table("CMD").groupBy(FLIGHT).agg(F.count(F.lit(1)).alias("cmd_count"))


def feature_vector(t: Telemetry, vibration: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Comparison metrics per flight as a map without NULL entries.

    ``vibration`` brings (flight_id, rms_z), ``scores`` (flight_id, gps_integrity_score)."""
    rows = (
        power_metrics(t).select(FLIGHT, F.col("voltage_min").alias("battery_voltage_min"), F.col("current_max").alias("current_max_a"))
        .join(gps_metrics(t).select(FLIGHT, F.col("hdop_max").alias("gps_hdop_max")), FLIGHT, "full")
        .join(filter_metrics(t).select(FLIGHT, F.col("max_vel_ivr").alias("ekf_var_ratio_max")), FLIGHT, "full")
    )
    if vibration is not None:
        rows = rows.join(vibration.select(FLIGHT, F.col("rms_z").alias("vibration_rms_z")), FLIGHT, "full")
    if scores is not None:
        rows = rows.join(scores.select(FLIGHT, "gps_integrity_score"), FLIGHT, "full")
    names = [c for c in rows.columns if c != FLIGHT]
    entries = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(n).cast("double") for n in names]))
    return rows.select(FLIGHT, F.map_filter(entries, lambda _, v: v.isNotNull()).alias("metrics"))


def baseline_deviation(current: DataFrame, neighbours: DataFrame, key: str = "query_id", threshold: float = 2.5) -> DataFrame:
    """How far each metric lies from the matched baselines.

    ``current``: (key, metrics map).  ``neighbours``: (key, metrics map of one matched baseline).
    Rows come with z, the anomalous flag and HIGH / LOW; a query without baselines yields one row
    with ``error`` set."""
    values = neighbours.select(key, F.explode("metrics").alias("metric", "v")).where("v is not null")
    stats = values.groupBy(key, "metric").agg(F.avg("v").alias("baseline_mean"), F.stddev_pop("v").alias("baseline_std"))
    mine = current.select(key, F.explode("metrics").alias("metric", "current_value")).where("current_value is not null")
    z = (F.col("current_value") - F.col("baseline_mean")) / (F.col("baseline_std") + 1e-10)
    found = mine.join(stats, [key, "metric"]).withColumn("z_score", z)
    found = found.withColumns({
        "is_anomalous": F.abs("z_score") > threshold,
        "direction": F.when(F.col("z_score") > 0, "HIGH").otherwise("LOW"),
        "error": F.lit(None).cast("string"),
    })
    alone = current.select(key).join(neighbours.select(key).distinct(), key, "left_anti").withColumn(
        "error", F.lit("no matched baseline")
    )
    return found.unionByName(alone, allowMissingColumns=True)
