"""Grounding, narrative, report and evaluation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from contrail.plans import evaluation, grounding, report


def factors(spark, rows):
    return spark.createDataFrame([(f"f{i}", *r) for i, r in enumerate(rows)], "factor_id string, factor string, supporting_evidence array<string>")


@pytest.mark.parametrize("text,ids,ok", [
    ("GPS satellite count drop", ["GPS_SAT_COUNT_DROP"], True),
    ("EKF innovation ratio exceeding thresholds causing navigation failure", ["BAT_LOW_CAPACITY", "PowerSystemAgent"], False),
    ("GPS signal degradation due to motor interference", ["MOTOR_IMBALANCE", "ESCMotorAgent"], False),
    ("Vibration-induced IMU contamination", ["BAT_LOW_CAPACITY"], False),
    ("GPS integrity collapse causing EKF divergence", ["GPS_SAT_COUNT_DROP", "EKF_LANE_SWITCH", "GPSIntegrityAgent"], True),
    ("GPS collapse causing EKF failure", ["GPS_SAT_COUNT_DROP"], False),
    ("Rapid descent before impact", ["BAT_LOW_CAPACITY"], True),
    ("Battery depleted early", [], True),
])
def test_factor_domain(spark, text, ids, ok):
    r = grounding.check_factors(factors(spark, [(text, ids)])).first()
    assert r.admissible is ok
    assert (r.reason in ("ok", "no known subject")) is ok


def test_reason_text(spark):
    r = grounding.check_factors(factors(spark, [("gps failed", ["BAT_X"])])).first()
    assert r.reason == "speaks of GPSIntegrityAgent/GPS_, which none of its evidence (BAT_X) supports"


def test_split_factors(spark):
    f = factors(spark, [("Battery low", ["BAT_LOW_CAPACITY", "MADE_UP"]), ("GPS lost", ["BAT_LOW_CAPACITY"]), ("Anything", ["MADE_UP"]), ("Nothing", [])])
    f = f.withColumn("flight_id", F.lit("x"))
    ev = spark.createDataFrame([("x", "BAT_LOW_CAPACITY"), ("y", "MADE_UP")], "flight_id string, evidence_id string")
    got = {r.factor_id: r for r in grounding.split_factors(f, ev).collect()}
    assert [got[k].grounded for k in sorted(got)] == [True, False, False, False]
    assert got["f0"].supporting_evidence == ["BAT_LOW_CAPACITY"]
    assert got["f1"].rejected_because == "domain" and "[unsupported: speaks of" in got["f1"].factor
    assert got["f2"].rejected_because == "evidence" and got["f2"].supporting_evidence == ["MADE_UP"]


def test_claim_warnings_and_words(spark):
    d = spark.createDataFrame([("x", "The escape and descent were fine"), ("x", "The ESC failed, then the GPS fix"), ("z", "motor jam")], "flight_id string, claim string")
    ev = spark.createDataFrame([("x", "ESC_DESYNC"), ("z", "GPS_FIX_DROP")], "flight_id string, evidence_id string")
    got = sorted((r.flight_id, r.domain, r.keyword) for r in grounding.claim_warnings(d, ev).collect())
    assert got == [("x", "GPS", "gps"), ("z", "MOTOR", "motor")]
    uni = spark.createDataFrame([("éesc",), ("esc_1",), ("(esc)",)], "t string")
    assert [r.t for r in grounding.text_claims(uni, "t", grounding.FACTOR_DOMAINS).collect()] == ["(esc)"]


def test_narrative_gate(spark):
    reports = spark.createDataFrame([
        ("a", "EKF divergence from GPS degradation", "Battery sag then descent", "Battery depleted", ["Low pack [evidence: BAT_X] (HIGH)"], "ANOMALY", "HIGH"),
        ("b", "Battery depleted in flight", "", "Battery", [], "ANOMALY", "LOW"),
    ], "flight_id string, executive_summary string, causal_chain string, root_cause_determination string, contributing_factors array<string>, classification string, confidence_level string")
    an = spark.createDataFrame([("a", "BAT_LOW_CAPACITY"), ("b", "BAT_BROWNOUT")], "flight_id string, rule_name string")
    fi = spark.createDataFrame([("b", "GPSIntegrityAgent"), ("b", "SomethingElse")], "flight_id string, agent string")
    got = {r.flight_id: r for r in grounding.narrative_gate(reports, grounding.evidence_ids(an, fi)).collect()}
    a = got["a"]
    assert not a.narrative_valid and a.allowed_domains == ["POWER"]
    assert {(v.field, v.domain) for v in a.violations} == {("executive_summary", "EKF"), ("executive_summary", "GPS")}
    assert a.executive_summary == "ANOMALY, confidence HIGH: Battery depleted. With it: Low pack (HIGH). Evidence covers: POWER."
    assert a.causal_chain == "Battery sag then descent"
    assert got["b"].narrative_valid and got["b"].allowed_domains == ["GPS", "POWER"]


ANOM = "flight_id string, rule_name string, category string, severity string, timestamp_us long, channel string, description string, raw_values map<string,double>"


def test_registry_classification_and_order(spark):
    rows = [("a", "GPS_FIX_DROP", "GPS", "WARNING", 5, "x", "w", {}), ("a", "GPS_FIX_DROP", "GPS", "CRITICAL", 5, "y", "c", {"k": 1.0}),
            ("a", "BAT_BROWNOUT", "POWER", "CRITICAL", 3, "", "b", {}), ("b", "BAT_BROWNOUT", "POWER", "INFO", 1, "", "i", {}),
            ("a", "PARAM_OUT_OF_RANGE", "PARAMETERS", "WARNING", 0, "p", "p", {})]
    an = spark.createDataFrame(rows, ANOM)
    reg = report.anomaly_registry(an).orderBy(*report.registry_order()).collect()
    assert [(r.flight_id, r.rule_name, r.severity) for r in reg] == [
        ("a", "BAT_BROWNOUT", "CRITICAL"), ("a", "GPS_FIX_DROP", "CRITICAL"), ("a", "PARAM_OUT_OF_RANGE", "WARNING"), ("b", "BAT_BROWNOUT", "INFO")]
    assert reg[1].raw_values == {"k": 1.0}
    fl = spark.createDataFrame([("a", False, "CRASH"), ("b", True, "REVIEW"), ("c", False, None)], "flight_id string, crash_detected boolean, proposed string")
    cls = {r.flight_id: (r.base_classification, r.classification) for r in report.classify(fl, an).collect()}
    assert cls == {"a": ("ANOMALY", "ANOMALY"), "b": ("CRASH", "CRASH"), "c": ("REVIEW", "REVIEW")}
    keep = spark.createDataFrame([("a", "UNSAFE_ARM", "FAILSAFE", "WARNING", 5, "", "", {})], ANOM)
    assert report.classify(fl, keep).where("flight_id = 'a'").first().classification == "CRASH"
    top = {r.flight_id: r.rule_name for r in report.anchor(an).collect()}
    assert top["a"] == "GPS_FIX_DROP"
    b = report.causal_bounds(an).first()
    assert (b.earliest_rule, b.latest_us, b.n_critical) == ("BAT_BROWNOUT", 5, 2)
    sections = sorted((r.section, r.rule_name) for r in report.report_evidence(an).where("flight_id = 'a'").collect())
    assert ("parameter", "PARAM_OUT_OF_RANGE") in sections and len(sections) == 5
    m = report.domain_matrix(grounding.evidence_ids(an), fl).where("available").collect()
    assert sorted((r.flight_id, r.domain) for r in m) == [("a", "GPS"), ("a", "Power/Battery"), ("b", "Power/Battery")]
    q = spark.range(1).select(report.ordered_union(F.array(F.lit("b"), F.lit("a")), F.array(F.lit("a"), F.lit("c"))).alias("q")).first().q
    assert q == ["b", "a", "c"]
    assert report.merge_findings(an, an).count() == 4


def test_hypotheses(spark):
    audit = spark.createDataFrame([("f", 0, "FS_THR_ENABLE", 0.0, "eq", 1.0, "must", "violation"), ("f", 3, "X", 1.0, "eq", 1.0, "d", "compliant")],
                                  "flight_id string, rank int, parameter string, actual double, check string, required double, description string, result string")
    h = report.safety_hypotheses(audit).first()
    assert h.title == "Failed safety check on FS_THR_ENABLE" and h.status == "forming" and h.evidence_for == ["must"]
    sc = spark.createDataFrame([("f", 40.0, 0.8, "bad", False), ("g", 90.0, 0.8, "ok", False)], "flight_id string, integrity_score double, confidence double, summary string, causal_to_ekf_failure boolean")
    an = spark.createDataFrame([("f", "GPS_FIX_DROP", "GPS", "CRITICAL", 5, "y", "lost fix", {})], ANOM)
    got = report.gps_hypotheses(sc, an).collect()
    assert report.gps_hypothesis_evidence(sc, an).count() == 1
    assert [(r.title, r.evidence_for) for r in got] == [("Satellite positioning is doubtful, score 40 of 100", ["lost fix"])]


REP = "case_id string, classification string, confidence_level string, root_cause string, rule_names array<string>, contributing_factors array<string>, errors array<string>"
SPEC = "case_id string, expected_classification string, min_confidence string, required_rules array<string>, keywords array<string>, required_evidence array<string>, forbidden_terms array<string>"


def test_scoring(spark):
    reps = spark.createDataFrame([
        ("a", "CRASH", "HIGH", "GPS lost", ["R1", "R2"], ["x [evidence: R1, R9] (HIGH)"], []),
        ("b", "CRASH", "MEDIUM", "wind", [], ["Pilot Error"], ["boom"]),
        ("c", "ANOMALY", None, None, ["R1"], None, []),
    ], REP)
    specs = spark.createDataFrame([
        ("a", "CRASH", "HIGH", ["R1"], ["gps"], ["R9"], ["wind"]), ("b", "ANOMALY", "HIGH", ["R1"], ["gps"], ["R9"], ["pilot error"]),
        ("c", "CRASH", "LOW", [], [], [], [])], SPEC)
    s = evaluation.score_cases(reps, specs)
    got = {r.case_id: r for r in s.collect()}
    assert got["a"].passed and got["a"].score == 1.0 and len(got["a"].criteria) == 6
    assert got["b"].score == 0.0 and [c.name for c in got["c"].criteria] == ["classification_match", "confidence_sufficient", "required_rules_present"]
    m = evaluation.benchmark_metrics(s).first()
    assert (m.total_cases, m.passed_cases, m.error_cases) == (3, 1, 1)
    assert m.classification_accuracy == pytest.approx(1 / 3) and m.false_positive_rate == 1.0 and m.false_negative_rate == 0.5
    assert m.fabricated_evidence_rate == pytest.approx(1 / 3) and not m.passes_exit_criteria and len(m.failures) == 3
    assert (m.mean_conf_correct, m.mean_conf_incorrect) == (2.0, 0.5)
    cm = {r.label: r for r in evaluation.class_metrics(s, F.col("expected_classification"), F.col("classification")).collect()}
    assert (cm["CRASH"].tp, cm["CRASH"].fp, cm["CRASH"].fn, cm["CRASH"].f1) == (1, 1, 1, 0.5)
    assert cm["ANOMALY"].precision == 0.0 and cm["ANOMALY"].f1 is None
    cr = {r.criterion: r.pass_rate for r in evaluation.criteria_rates(s).collect()}
    assert cr["classification_match"] == pytest.approx(1 / 3)
    empty = evaluation.benchmark_metrics(s.where("false")).first()
    assert (empty.total_cases, empty.classification_accuracy, empty.overall_pass_rate) == (0, 0.0, 0.0)


def test_keyword_tables_match_keyword_lists(spark):
    """100,000 keywords by joins give what one test a keyword gives; odd phrases, texts and repeated rows included."""
    rng = random.Random(2)
    syllables = ["ka", "lo", "é", "x", "mi", "tor", "😀", "9"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))

    own = {f"d{i % 7}": set() for i in range(7)}
    for i in range(300):
        own[f"d{i % 7}"].add(" ".join(word() for _ in range(rng.choice([1, 1, 2, 3]))))
    own["d0"] |= {" ka", "lo ", " ", "ka  lo", "x\nlo mi", "ka-lo"}
    docs = [(i, rng.choice([" ", ", ", "  "]).join(word().title() for _ in range(rng.randint(0, 12)))) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "Ka LO x\nlo mi"), (1002, "Ka LO x\nlo mi"), (1003, "tor " * 20_000)]
    d = spark.createDataFrame(docs, "id long, text string")
    rows = [(n, k) for n, ks in own.items() for k in ks]
    big = [("far", f"zz{i}" if i % 2 else f"zz{i} qq") for i in range(100_000)]
    table = spark.createDataFrame(rows + rows[:20] + [("d1", None)] + big, "domain string, keyword string")
    got = grounding.text_claims(d, "text", table)
    want = []
    for i, text in docs:
        low = (text or "").lower()
        words = set(re.split(r"[^\w]+", low)) if text is not None else set()
        for n, ks in own.items():
            hits = sorted((k for k in ks if (k in low if " " in k else k in words)), key=lambda k: k.encode())
            if hits and text is not None:
                want.append((i, n, hits[0]))
    assert sorted((r.id, r.domain, r.keyword) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert grounding.text_claims(d, "text", table.limit(0)).count() == 0
    assert grounding.text_claims(d.limit(0), "text", table).count() == 0
