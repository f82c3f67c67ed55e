"""Rules on adjacent rows: a stream gives what the whole table gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.plans import timeline
from contrail.plans.rules import rows
from contrail.plans.rules.common import Telemetry
from contrail.streaming.previous import StreamTelemetry, adjacent_anomalies, adjacent_events, with_previous

S = 1_000_000
GPS = "flight_id string, instance int, timestamp_us long, seq long, num_sats int, fix_type int, hdop double, lat_deg double, lng_deg double"
SPARE = ("zz", 0, 10**12, 0, 9, 3, 1.0, 0.0, 0.0)


def _feed(spark, path, batches, schema):
    """One file a micro-batch, in the order given."""
    for i, rows_ in enumerate(batches):
        spark.createDataFrame(rows_, schema).coalesce(1).write.parquet(f"{path}/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def _run(spark, stream, path, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option(
        "checkpointLocation", str(path / f"ck_{name}")).start()
    q.awaitTermination(240)
    return spark.table(name)


def _gps():
    rng = np.random.default_rng(5)
    out = []
    for k in range(3):
        t = 1000 * S
        for i in range(120):
            t += int(rng.integers(0, 3)) * S  # times repeat; the sequence number decides
            sats = None if rng.random() < 0.1 else int(rng.integers(3, 14))
            fix = None if rng.random() < 0.1 else int(rng.integers(1, 4))
            hdop = None if rng.random() < 0.1 else float(rng.uniform(0.5, 4))
            out.append((f"k{k}", k % 2, t, i, sats, fix, hdop, float(rng.normal(50, 1e-3)), float(rng.normal(8, 1e-3))))
    return out


def _texts(df):
    cols = [F.to_json(F.map_from_entries(F.array_sort(F.map_entries(c)))).alias(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes]
    return sorted(map(str, df.where("flight_id <> 'zz'").select(*cols).collect()))


def test_adjacent_rules_on_streams(spark, tmp_path):
    data = _gps()
    idle = [("idle", 0, (1000 + i) * S, i, 12 - 5 * (i % 2), 3, 1.0, 50.0, 8.0) for i in range(6)]  # silent after the first batch
    rng = np.random.default_rng(1)
    by_time = sorted(data, key=lambda r: r[2] + int(rng.integers(0, 20)) * S)  # out of order, but within the delay
    cut = [by_time[i::1][:90] for i in range(0, len(by_time), 90)]
    late = ("k0", 0, 1001 * S, 999, 0, 0, 99.0, 0.0, 0.0)  # far behind the watermark when it comes
    batches = [cut[0] + idle, *cut[1:], [SPARE], [late]]
    stream = _feed(spark, str(tmp_path / "gps"), batches, GPS)
    t = StreamTelemetry(spark, {"GPS": stream}, delay="30 seconds")
    whole = Telemetry(spark, {"GPS": spark.createDataFrame(data + idle, GPS)})
    found = adjacent_anomalies(t)
    assert set(found) == {"satellite_drop", "spoofing_indicator"}
    drops, fakes = _texts(rows.gps_satellite_drop(whole)), _texts(rows.gps_spoofing_indicator(whole))
    assert _texts(_run(spark, found["satellite_drop"], tmp_path, "drops")) == drops
    assert _texts(_run(spark, found["spoofing_indicator"], tmp_path, "fakes")) == fakes
    assert any("idle" in w for w in drops) and fakes
    assert _texts(_run(spark, adjacent_events(t)["gps"], tmp_path, "ev")) == _texts(timeline.gps_events(whole))


def test_lane_and_mode_on_streams(spark, tmp_path):
    lanes = [("a", i * S, i, [0, None, 1, 1, 0][i % 5]) for i in range(1, 40)]
    errs = [("a", 5 * S, 0, 16, 1), ("b", 6 * S, 1, 3, 1), ("b", 7 * S, 2, 24, 0)]
    modes = [("a", i * 3 * S, i, i % 4 - 1, [None, "LOITER", "INITIALISING", "RTL"][i % 4], i % 3) for i in range(1, 30)]
    far = 10**12
    schema = {
        "NKF4": "flight_id string, timestamp_us long, seq long, lane int",
        "ERR": "flight_id string, timestamp_us long, seq long, subsys int, ecode int",
        "MODE": "flight_id string, timestamp_us long, seq long, mode_num int, mode_name string, reason int",
    }
    data = {"NKF4": lanes, "ERR": errs, "MODE": modes}
    spare = {"NKF4": ("zz", far, 0, 0), "ERR": ("zz", far, 0, 0, 0), "MODE": ("zz", far, 0, 0, "RTL", 0)}
    feeds = {n: _feed(spark, str(tmp_path / n), [r[: len(r) // 2], r[len(r) // 2 :], [spare[n]]], schema[n]) for n, r in data.items()}
    t = StreamTelemetry(spark, feeds, delay="1 minute")
    whole = Telemetry(spark, {n: spark.createDataFrame(r, schema[n]) for n, r in data.items()})
    found = adjacent_anomalies(t)
    got = _run(spark, found["lane_moves"], tmp_path, "moves").unionByName(_run(spark, found["lane_errors"], tmp_path, "lanes"))
    assert _texts(got) == _texts(rows.ekf_lane_switch(whole)) and got.count() > 4
    assert _texts(_run(spark, adjacent_events(t)["mode"], tmp_path, "modes")) == _texts(timeline.mode_events(whole))


def test_state_ends_and_limits(spark, tmp_path):
    schema = "k string, us long, s long, v long"
    big = 2**60 + 1  # too large for a double
    batches = [[("a", 1 * S, 0, big), ("a", 2 * S, 1, None)], [("b", 400 * S, 0, 1)], [("b", 800 * S, 1, 2)], [("a", 810 * S, 2, 3), ("b", 811 * S, 2, 4)],
               [("b", 2000 * S, 3, 5)]]
    stream = _feed(spark, str(tmp_path / "in"), batches, schema)
    got = _run(spark, with_previous(stream, ["k"], ["us", "s"], {"p": "v"}, "10 seconds", 100_000), tmp_path, "ends")
    found = {(r.k, r.s): (r.v, r.p) for r in got.collect()}
    assert found[("a", 0)] == (big, None) and found[("a", 1)] == (None, big)
    assert found[("a", 2)] == (3, None)  # its state had ended
    assert found[("b", 2)] == (4, 2)
    t = StreamTelemetry(spark, {"GPS": stream, "NKF4": stream, "XKF4": stream})
    with pytest.raises(ValueError):
        t.table("NKF4|XKF4")
    with pytest.raises(ValueError):
        t.flight_series(stream.withColumnRenamed("k", "flight_id")).shift({}, {"n": "us"})
    assert not adjacent_events(StreamTelemetry(spark, {})) and not adjacent_anomalies(StreamTelemetry(spark, {}))
