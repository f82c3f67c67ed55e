"""A hand-made flight: arm, climb, return, crash; and a flight without mode rows."""

import pytest

from contrail.catalogue import base
from contrail.plans import compliance, metrics, timeline
from contrail.plans.rules.common import Telemetry
from contrail.plans.rules.registry import run_rules

S = 1_000_000


@pytest.fixture(scope="module")
def flight(spark):
    def table(ddl, rows):
        return spark.createDataFrame([("f1", t, i, *r) for i, (t, *r) in enumerate(rows)],
                                     "flight_id string, timestamp_us long, seq long, " + ddl)

    att = table("roll_deg double, pitch_deg double", [(i * S, 70.0 if i == 40 else 5.0, 25.0 if i == 12 else 0.0) for i in range(45)])
    extra = spark.createDataFrame([("f2", 5, 0, 1.0, 1.0), ("f2", 9, 1, 1.0, 1.0)], att.schema)
    return Telemetry(spark, {
        "MODE": table("mode_num int, mode_name string, reason int", [
            (0, 0, "INITIALISING", 0), (5 * S, 5, "LOITER", 1), (20 * S, 5, "LOITER", 2), (30 * S, 6, "RTL", 4)]),
        "ERR": table("subsys int, ecode int", [(31 * S, 16, 2), (33 * S, 16, 0), (34 * S, 99, 1)]),
        "GPS": table("fix_type int, num_sats int, hdop double, alt_rel_m double", [
            (i * S, 1 if i == 25 else 3, 9 if i == 26 else 14, 2.5 if i == 27 else 1.0, min(i, 15) * 2.0) for i in range(42)]),
        "ATT": att.unionByName(extra),
        "PARM": table("name string, value double", [
            (0, "FS_THR_ENABLE", 0.0), (1 * S, "GPS_HDOP_GOOD", 2.0), (2 * S, "GPS_HDOP_GOOD", 2.2),
            (3 * S, "BATT_LOW_VOLT", 14.0), (35 * S, "BATT_LOW_VOLT", 9.0)]),
        "CMD": table("cmd_num int", [(1, 1), (2, 2)]),
    })


def test_events(flight):
    got = timeline.timeline(flight).orderBy("timestamp_us").collect()
    seen = [(e.timestamp_us // S, e.event_type, e.severity) for e in got if e.flight_id == "f1"]
    assert (5, "ARM", "INFO") in seen and (5, "MODE_CHANGE", "INFO") in seen and (30, "MODE_CHANGE", "WARNING") in seen
    assert (25, "GPS_FIX_DEGRADED", "CRITICAL") in seen and (26, "GPS_SAT_DROP", "CRITICAL") in seen
    assert (27, "GPS_HDOP_SPIKE", "WARNING") in seen and (40, "CRASH_DETECTED", "FATAL") in seen
    assert (35, "PARAM_CHANGE", "INFO") in seen
    assert [x for x in seen if x[1] == "ERROR"] == [(31, "ERROR", "CRITICAL"), (33, "ERROR", "INFO"), (34, "ERROR", "WARNING")]
    assert not [x for x in seen if x[1] == "DISARM"]
    desc = {e.event_type: e.description for e in got}
    assert desc["MODE_CHANGE"] == "From mode LOITER to RTL, reason 4"
    h = timeline.event_horizon(timeline.timeline(flight)).collect()
    assert [(r.flight_id, r.event_horizon_us) for r in h] == [("f1", 5 * S)]
    n = timeline.timeline_counts(timeline.timeline(flight)).first()
    assert (n.critical_events, n.fatal_events) == (3, 1)


def test_phases(flight):
    got = {(r.flight_id, r.start_us): r for r in timeline.phases(flight).collect()}
    f1 = [(got[k].name, k[1] // S, got[k].end_us // S) for k in sorted(got) if k[0] == "f1"]
    assert f1 == [("PRE_ARM", 0, 5), ("TAKEOFF", 5, 20), ("HOVER", 20, 30), ("RTL", 30, 40), ("CRASH", 40, 45)]
    assert got[("f1", 5 * S)].notes == "height 10.0 to 30.0 m; tilted up to 5° roll and 25° pitch"
    # the row on the shared boundary belongs to both neighbours
    assert got[("f1", 30 * S)].notes == "height 30.0 to 30.0 m; tilted up to 70° roll and 0° pitch"
    assert (got[("f2", 5)].name, got[("f2", 5)].end_us) == ("UNKNOWN", 9)
    summary = {r.flight_id: r for r in timeline.flight_summary(timeline.timeline(flight), timeline.phases(flight)).collect()}
    s = summary["f1"]
    assert (s.phases, s.duration_s, s.arm_timestamp_us, s.crash_timestamp_us) == (5, 45.0, 5 * S, 40 * S)
    assert s.crash_detected and not summary["f2"].crash_detected


def test_metrics_and_parameters(flight):
    g = metrics.gps_metrics(flight).first()
    assert (g.hdop_max, g.sat_count_min, g.fix_type_min) == (2.5, 9, 1)
    assert metrics.command_counts(flight).first().cmd_count == 2
    drift = compliance.parameter_drift(flight).collect()
    assert [(a.channel, a.severity) for a in drift] == [("FS_THR_ENABLE", "CRITICAL")]
    audit = {r.parameter: r.result for r in compliance.safety_audit(flight).collect()}
    assert audit["FS_THR_ENABLE"] == "violation" and audit["GPS_HDOP_GOOD"] == "compliant"
    assert audit["FENCE_ENABLE"] == "warning" and audit["BATT_LOW_VOLT"] == "compliant"
    initial = {r.name: r.value for r in compliance.initial_parameters(flight).collect()}
    assert initial["GPS_HDOP_GOOD"] == 2.2 and initial["BATT_LOW_VOLT"] == 14.0
    prof = {r.name: r.severity for r in compliance.profile_deviation(compliance.initial_parameters(flight), "ardupilot_quad").collect()}
    assert prof == {"FS_THR_ENABLE": "CRITICAL"}
    gaps = compliance.data_gaps(flight, flight.table("ATT")).where("flight_id = 'f1'").first()
    assert (gaps.esc_confidence, gaps.parameter_confidence) == (0.40, 0.85)


def test_summary_and_dedupe(flight, spark):
    found = run_rules(flight)
    s = metrics.anomaly_summary(found).first()
    assert s.total == sum(s.by_severity.values()) == sum(s.by_category.values())
    rows = spark.createDataFrame([("f", "R", 1, "WARNING", "b"), ("f", "R", 1, "CRITICAL", "c"), ("f", "R", 1, "CRITICAL", "a"),
                                  ("f", "R", 2, "INFO", "z")], "flight_id string, rule_name string, timestamp_us long, severity string, channel string")
    got = sorted((r.timestamp_us, r.severity, r.channel) for r in metrics.dedupe(rows).collect())
    assert got == [(1, "CRITICAL", "a"), (2, "INFO", "z")]
    vec = metrics.feature_vector(flight).where("flight_id = 'f1'").first().metrics
    assert vec == {"gps_hdop_max": 2.5}


def test_baseline_deviation(spark):
    cur = spark.createDataFrame([(1, {"a": 10.0, "b": 1.0}), (2, {"a": 1.0})], "query_id long, metrics map<string,double>")
    near = spark.createDataFrame([(1, {"a": 1.0, "b": 1.0}), (1, {"a": 3.0, "b": 2.0})], "query_id long, metrics map<string,double>")
    got = {(r.query_id, r.metric): r for r in metrics.baseline_deviation(cur, near).collect()}
    assert got[(1, "a")].z_score == pytest.approx(8.0) and got[(1, "a")].is_anomalous and got[(1, "a")].direction == "HIGH"
    assert got[(1, "b")].z_score == pytest.approx(-1.0) and not got[(1, "b")].is_anomalous
    assert got[(2, None)].error


def test_timeline_and_phases_shuffle_each_table_once(spark):
    """An ordered pass for modes, GPS and parameters and an aggregate of attitudes; phases add one line of segments."""
    tables = {n: base.telemetry(spark, "/root/testdata/sf0.001").table(n) for n in ("MODE", "GPS", "ATT", "PARM", "ERR")}
    t = Telemetry(spark, tables)

    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert exchanges(timeline.timeline(t)) <= 4
    assert exchanges(timeline.phases(t)) <= 8
