"""Headline queries, timed end to end (planning included); prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from contrail.catalogue import CATALOGUE  # noqa: E402
from contrail.session import build_session  # noqa: E402

HEADLINE = [
    "sustained_violation", "fused_threshold_rules", "tolerant_groups", "spaced_events", "step_drop", "voltage_sag",
    "current_spike", "rolling_zscore", "internal_resistance", "vector_magnitude", "downsample", "nearest_join",
    "interp_join", "response_window", "phase_stats", "sensor_disagreement", "great_circle", "timeline", "phases",
    "rule_ekf_innov_vel", "rule_vibe_high_rms", "rule_gps_position_glitch", "rule_motor_imbalance",
    "rule_failsafe_verify", "gps_metrics", "safety_audit", "registry_dedupe", "classify_guarded", "similar_topk",
    "baseline_deviation", "changepoints", "xcorr_lag", "welch_psd", "spectral_peaks", "isolation_scores",
    "keyword_claims", "unbacked_claims", "class_metrics", "flight_profile", "dataflash_tables",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cores)
    CATALOGUE["instant_violation"].run(spark, sf).write.format("noop").mode("overwrite").save()  # start the JVM's readers
    times = {}
    for name in names:
        start = time.perf_counter()
        CATALOGUE[name].run(spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
