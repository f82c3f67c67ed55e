"""Report tables: registry, phase list, classification, causal order, domain evidence, hypotheses."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.plans.grounding import starts_with_any
from contrail.plans.metrics import dedupe
from contrail.schema import FLIGHT, TS, severity_rank

# Rules that by themselves can carry a CRASH verdict.
CRASH_RULES = [
    "EKF_LANE_SWITCH", "EKF_VEL_INNOV_SPIKE", "EKF_POS_OFFSET_GROWTH", "IMU_RAW_EXTREME", "MOTOR_OUTPUT_DROP",
    "ESC_DESYNC", "FAILSAFE_VERIFY", "UNSAFE_ARM",
]
# Domains of the evidence matrix, their rule prefixes and agents.
EVIDENCE_MATRIX = {
    "GPS": (["GPS_"], ["GPSIntegrityAgent"]), "EKF": (["EKF_"], ["EKFDiagnosticsAgent"]),
    "Power/Battery": (["BAT_"], ["PowerSystemAgent"]), "Vibration/IMU": (["VIBE_", "IMU_"], ["VibrationAnalysisAgent"]),
    "Motor/ESC": (["MOTOR_", "ESC_"], ["ESCMotorAgent"]), "Failsafe": (["FAILSAFE_"], []),
}
SEVERE = ["CRITICAL", "FATAL"]


def anomaly_registry(anomalies: DataFrame) -> DataFrame:
    """First anomaly per (flight, rule, time) by severity; read with ``registry_order``."""
    return dedupe(anomalies).select(
        FLIGHT, TS, F.coalesce("category", F.lit("UNKNOWN")).alias("subsystem"), "severity", "description", "rule_name", "raw_values",
    )


def registry_order() -> list[Column]:
    return [F.col(FLIGHT), severity_rank(), F.col(TS)]


def phase_timeline(phases: DataFrame) -> DataFrame:
    fill = {"name": "UNKNOWN", "start_us": 0, "end_us": 0, "mode_name": "UNKNOWN", "notes": ""}
    return phases.select(FLIGHT, *fill).fillna(fill)


def merge_findings(*parts: DataFrame) -> DataFrame:
    """Anomalies of several detectors, one per (flight, rule, time)."""
    return dedupe(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))


def classification_signals(anomalies: DataFrame, key: str = FLIGHT) -> DataFrame:
    """What the guards need: any anomaly, any FATAL one, any crash-class rule."""
    return anomalies.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_anomalies"),
        F.max(F.col("severity") == "FATAL").alias("has_fatal"),
        F.max(F.col("rule_name").isin(CRASH_RULES)).alias("has_crash_rule"),
    )


def base_classification(crash: Column, anomalies: Column) -> Column:
    return F.when(crash, "CRASH").when(anomalies > 0, "ANOMALY").otherwise("REVIEW")


def guarded_classification(proposed: Column, crash: Column, fatal: Column, crash_rule: Column) -> Column:
    """A crash signal forces CRASH; a proposed CRASH without crash-class evidence becomes ANOMALY."""
    lone = (proposed == "CRASH") & ~fatal & ~crash_rule
    return F.when(crash, "CRASH").when(lone, "ANOMALY").otherwise(proposed)


def classify(flights: DataFrame, anomalies: DataFrame, key: str = FLIGHT) -> DataFrame:
    """``flights``: (key, crash_detected, proposed or NULL).  Adds base and final classification."""
    out = flights.join(classification_signals(anomalies, key), key, "left").fillna(
        {"n_anomalies": 0, "has_fatal": False, "has_crash_rule": False}
    )
    base = base_classification(F.col("crash_detected"), F.col("n_anomalies"))
    proposed = F.coalesce("proposed", base)
    return out.withColumns({
        "base_classification": base,
        "classification": guarded_classification(proposed, F.col("crash_detected"), F.col("has_fatal"), F.col("has_crash_rule")),
    })


def causal_bounds(anomalies: DataFrame, key: str = FLIGHT) -> DataFrame:
    """Earliest (candidate cause) and latest (likely symptom) CRITICAL or FATAL anomaly."""
    severe = anomalies.where(F.col("severity").isin(SEVERE))
    order = F.struct(TS, "rule_name")
    return severe.groupBy(key).agg(
        F.min_by("rule_name", order).alias("earliest_rule"), F.min(TS).alias("earliest_us"),
        F.max_by("rule_name", order).alias("latest_rule"), F.max(TS).alias("latest_us"), F.count(F.lit(1)).alias("n_critical"),
    )


def report_evidence(anomalies: DataFrame, key: str = FLIGHT) -> DataFrame:
    """All anomalies by section: critical, other, and once more the parameter ones.

    ``report_order`` is the order to show them in; what is left off is up to the reader."""
    section = F.when(F.col("severity").isin(SEVERE), "critical").otherwise("other")
    rows = anomalies.withColumn("section", section)
    return rows.unionByName(rows.where(F.col("rule_name").startswith("PARAM_")).withColumn("section", F.lit("parameter")))


def report_order(key: str = FLIGHT) -> list[Column]:
    return [F.col(key), F.col("section"), F.col(TS), F.col("rule_name")]


def anchor(anomalies: DataFrame, key: str = FLIGHT, tie: Sequence[str] = ("rule_name",)) -> DataFrame:
    """Most severe, then latest anomaly of each flight, and the sentence that cites it."""
    rest = [c for c in anomalies.columns if c != key]
    top = anomalies.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(-severity_rank(), F.col(TS), *tie)).alias("_t"))
    return top.select(key, "_t.*")


def anchored_cause() -> Column:
    return F.format_string(
        "%s (shown by %s at %.1f s; the proposed cause had no evidence)",
        F.col("description"), F.col("rule_name"), F.col(TS) / 1e6,
    )


def domain_matrix(evidence: DataFrame, flights: DataFrame, key: str = FLIGHT, column: str = "evidence_id") -> DataFrame:
    """(flight, domain, n_rules, n_agents, available) for the six domains of every flight."""
    ids = evidence.select(key, column).distinct()
    hits = F.array_compact(F.array(*[
        F.when(starts_with_any(F.col(column), rules) | F.col(column).isin(agents),
               F.struct(F.lit(d).alias("domain"), F.col(column).isin(agents).alias("agent")))
        for d, (rules, agents) in EVIDENCE_MATRIX.items()
    ]))
    found = ids.select(key, F.explode(hits).alias("h")).groupBy(key, F.col("h.domain").alias("domain")).agg(
        F.count_if(~F.col("h.agent")).alias("n_rules"), F.count_if(F.col("h.agent")).alias("n_agents")
    )
    grid = flights.select(key).distinct().withColumn("domain", F.explode(F.array(*[F.lit(d) for d in EVIDENCE_MATRIX])))
    out = grid.join(found, [key, "domain"], "left").fillna({"n_rules": 0, "n_agents": 0})
    return out.withColumn("available", (F.col("n_rules") + F.col("n_agents")) > 0)


def ordered_union(*lists: Column) -> Column:
    """Concatenate, keeping the first occurrence of each entry."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(c, empty) for c in lists]))


def hypothesis(df: DataFrame, title: Column, description: Column, source: str, confidence: Column | float, status: str = "forming",
               evidence_for: Column | None = None, missing: list[str] | None = None) -> DataFrame:
    none = F.array().cast("array<string>")
    return df.select(
        FLIGHT, F.concat_ws("_", F.lit(source), F.col(FLIGHT)).alias("id"), title.alias("title"), description.alias("description"),
        F.lit(source).alias("agent_source"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"),
        F.lit(status).alias("status"), (none if evidence_for is None else evidence_for).alias("evidence_for"),
        none.alias("evidence_against"), (F.array(*[F.lit(m) for m in missing]) if missing else none).alias("missing_evidence"),
    )


def gps_hypotheses(scores: DataFrame, anomalies: DataFrame) -> DataFrame:
    """``scores``: (flight, integrity_score, confidence, summary, causal_to_ekf_failure).

    ``evidence_for`` holds the first critical line of each rule; every line is in
    ``gps_hypothesis_evidence``, as rows."""
    crit = anomalies.where("category = 'GPS' and severity = 'CRITICAL'")
    per_rule = crit.groupBy(FLIGHT, "rule_name").agg(
        F.min(TS).alias("_t"), F.min_by("description", F.struct(TS, "channel")).alias("_d")
    )
    lines = per_rule.groupBy(FLIGHT).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_t", "rule_name", "_d"))), lambda x: x["_d"]).alias("_for")
    )
    bad = _doubtful(scores).join(lines, FLIGHT, "left")
    return hypothesis(
        bad, F.format_string("Satellite positioning is doubtful, score %.0f of 100", "integrity_score"), F.col("summary"), "GPSIntegrityAgent",
        F.col("confidence"), "supported", F.coalesce("_for", F.array().cast("array<string>")),
    )


def gps_hypothesis_evidence(scores: DataFrame, anomalies: DataFrame) -> DataFrame:
    """(flight, timestamp_us, rule_name, description) of all critical GPS anomalies behind a hypothesis."""
    crit = anomalies.where("category = 'GPS' and severity = 'CRITICAL'")
    return crit.join(_doubtful(scores).select(FLIGHT), FLIGHT, "left_semi").select(FLIGHT, TS, "rule_name", "description")


def _doubtful(scores: DataFrame) -> DataFrame:
    return scores.where((F.col("integrity_score") < 50) | F.col("causal_to_ekf_failure"))


def filter_hypotheses(health: DataFrame) -> DataFrame:
    """``health``: (flight, filter_health, confidence, summary, evidence)."""
    bad = health.where(F.col("filter_health").isin("DEGRADED", "FAILED"))
    return hypothesis(bad, F.format_string("State estimator was %s", "filter_health"), F.col("summary"),
                      "EKFDiagnosticsAgent", F.col("confidence"), "supported", F.col("evidence"))


def safety_hypotheses(audit: DataFrame) -> DataFrame:
    """One hypothesis per flight with a safety violation, titled by the first failed check."""
    bad = audit.where("result = 'violation'").groupBy(FLIGHT).agg(
        F.min_by(F.struct("parameter", "actual", "check", "required"), "rank").alias("v"), F.count(F.lit(1)).alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "description"))), lambda x: x["description"]).alias("_for"),
    )
    text = F.format_string("%s is %s, check: %s %s; failed checks: %d", "v.parameter", F.col("v.actual").cast("string"),
                           "v.check", F.coalesce(F.col("v.required").cast("string"), F.lit("None")), "n")
    return hypothesis(bad, F.concat(F.lit("Failed safety check on "), F.col("v.parameter")), text, "SafetyComplianceAgent",
                      0.60, "forming", F.col("_for"), ["later values of the parameters"])
