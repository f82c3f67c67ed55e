"""Files, mapping, store, catalog, similarity and streams, on temporary folders."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from contrail.operators import runs, similarity
from contrail.operators.series import open_series
from contrail.sources import manifest, mapping, profile, tabular
from contrail.sources.catalog import Catalog
from contrail.sources.store import TelemetryStore
from contrail.streaming import stateless
from contrail.streaming.sustained import _join_runs, sustained_stream


def test_manifest(spark, tmp_path):
    files = {"a.bin": b"\xa3\x95\x80\x80data", "copy.bin": b"\xa3\x95\x80\x80data", "b.ulg": b"ULog\x01rest", "c.csv": b"t,v\n1,2\n",
             "d.json": b' {"t": 1}', "e.bin": b"nope", "f.exe": b"MZ", "g.tlog": b"\x00" * 8 + b"\xfd123", "h.csv": b""}
    for n, b in files.items():
        (tmp_path / n).write_bytes(b)
    m = manifest.file_manifest(spark, str(tmp_path))
    got = {r.filename: r for r in m.collect()}
    assert {n: got[n].format for n in ("a.bin", "b.ulg", "c.csv", "d.json", "g.tlog")} == {
        "a.bin": "ardupilot_bin", "b.ulg": "px4_ulog", "c.csv": "csv", "d.json": "json", "g.tlog": "mavlink_tlog"}
    assert got["a.bin"].sha256 == hashlib.sha256(files["a.bin"]).hexdigest()
    known = spark.createDataFrame([(got["b.ulg"].sha256,)], "sha256 string")
    ok, bad = manifest.admit(m, 100, known)
    assert sorted(r.filename for r in ok.collect()) == ["a.bin", "c.csv", "g.tlog"]
    assert {r.filename: r.reject_reason for r in bad.collect()} == {
        "copy.bin": "duplicate", "b.ulg": "duplicate", "d.json": "header does not match extension", "e.bin": "header does not match extension",
        "f.exe": "unsupported extension"}
    # the reader does not list empty files; one listed elsewhere is turned away
    none = m.where("filename = 'c.csv'").withColumn("length", F.lit(0))
    assert [r.reject_reason for r in manifest.admit(none, 100)[1].collect()] == ["empty file"]


def raw(spark, rows):
    return spark.createDataFrame([("f", i, m, {k: str(v) for k, v in d.items()}) for i, (m, d) in enumerate(rows)],
                                 "flight_id string, seq long, msg_type string, fields map<string,string>")


def test_mapping(spark):
    t = mapping.from_dataflash(raw(spark, [
        ("BAT", {"TimeUS": 1, "Volt": 12.0, "VoltR": 12.5}), ("BAT", {"TimeUS": 2, "Volt": 11.0}), ("BAT", {"Volt": 11.0}),
        ("MODE", {"TimeUS": 3, "Mode": 6, "Rsn": 4}), ("MODE", {"TimeUS": 4, "Mode": 99}), ("ERR", {"TimeUS": 5, "Subsys": 16, "ECode": 2}),
        ("IMU2", {"TimeUS": 6, "AccX": 1.5}), ("BAD_DATA", {"TimeUS": 7}), ("PARM", {"TimeUS": 8, "Name": "X", "Value": "2.5"})]))
    assert [r.voltage_v for r in t["BAT"].orderBy("timestamp_us").collect()] == [12.5, 11.0]
    assert [r.mode_name for r in t["MODE"].orderBy("timestamp_us").collect()] == ["RTL", "UNKNOWN_99"]
    assert t["ERR"].first().subsys_name == "EKFCHECK" and t["IMU2"].first().instance == 1 and t["PARM"].first().value == 2.5
    s = math.sqrt(0.5)
    u = mapping.from_ulog(raw(spark, [
        ("vehicle_attitude", {"timestamp": 1, "q[0]": s, "q[1]": s, "q[2]": 0, "q[3]": 0, "rollspeed": math.pi}),
        ("vehicle_gps_position", {"timestamp": 2, "lat": 473977418, "alt": 488000, "hdop": 90}),
        ("battery_status", {"timestamp": 3, "remaining": 0.5}), ("vehicle_status", {"timestamp": 4, "nav_state": 5})]))
    assert u["ATT"].first().roll_deg == pytest.approx(90) and u["ATT"].first().roll_rate_deg_s == pytest.approx(180)
    assert u["GPS"].first().lat_deg == pytest.approx(47.3977418) and u["GPS"].first().alt_msl_m == pytest.approx(488)
    assert u["BAT"].first().remaining_pct == 50 and u["MODE"].first().mode_name == "AUTO_RTL"
    v = mapping.from_mavlink(raw(spark, [("SYS_STATUS", {"_timestamp": 1.5, "voltage_battery": 12600, "current_battery": 150}),
                                         ("ATTITUDE", {"_timestamp": 2, "roll": math.pi / 2})]))
    assert v["BAT_SYS"].first()[:4] == ("f", 1_500_000, 0, 0) and v["BAT_SYS"].first().voltage_v == pytest.approx(12.6)
    assert v["ATT"].first().roll_deg == pytest.approx(90)


def test_tabular(spark, tmp_path):
    (tmp_path / "s.csv").write_text("time,v\n1.5,1\n2.5,2\n")
    got = tabular.normalize_time(tabular.read_csv(spark, str(tmp_path / "s.csv")))
    assert sorted(r.timestamp_us for r in got.collect()) == [1_500_000, 2_500_000]
    (tmp_path / "us.csv").write_text("timestamp_us,v\n5,1\n")
    assert tabular.normalize_time(tabular.read_csv(spark, str(tmp_path / "us.csv"))).first().timestamp_us == 5
    (tmp_path / "r.json").write_text('[{"timestamp": "2024-01-01T00:00:01Z", "v": 1}, {"timestamp": "2024-01-01T00:00:02Z", "v": 2}]')
    j = tabular.normalize_time(tabular.read_json(spark, str(tmp_path / "r.json")))
    p = tabular.tabular_profile(j).first()
    assert (p.rows, p.log_start_us, p.duration_us) == (2, 1704067201000000, 1_000_000)


def test_profile(spark):
    rows = [("f", 0, "ATT", 0, None), ("f", 1, "ATT", 1_000_000, None), ("f", 2, "MSG", 5, "ArduCopter V4.1 "), ("f", 3, "MSG", 9, "ArduPilot x"),
            ("f", 4, "PARM", 10, None), ("f", 5, "BAD_DATA", 9_000_000, None)]
    df = spark.createDataFrame(rows, "flight_id string, seq long, msg_type string, ts long, text string")
    p = profile.log_profile(df, "ts", "text").first()
    assert p.message_counts == {"ATT": 2, "MSG": 2, "PARM": 1} and p.sample_rates_hz["ATT"] == 2.0 and p.parameter_count == 1
    assert p.firmware_version == "ArduPilot x" and p.vehicle_class == "multirotor"
    assert p.missing_critical == ["GPS", "IMU", "BAT", "RCOU", "MODE", "ERR"] and p.duration_us == 1_000_000


def test_store(spark, tmp_path):
    st = TelemetryStore(spark, str(tmp_path / "t"), buckets=4)
    att = spark.createDataFrame([(f, t * 10, t, float(t)) for f in ("a", "b") for t in range(100)], "flight_id string, timestamp_us long, seq long, roll_deg double")
    st.write("ATT", att.where("timestamp_us < 500"))
    st.write("ATT", att.where("timestamp_us >= 500"))
    st.write("BAT", att.select("flight_id", (F.col("timestamp_us") + 3).alias("timestamp_us"), "seq", F.col("roll_deg").alias("voltage_v")))
    assert st.available_types() == ["ATT", "BAT"]
    got = st.load("ATT", "a", ["timestamp_us", "roll_deg"], 100, 200)
    assert got.count() == 11 and got.columns == ["timestamp_us", "roll_deg"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(flight_bucket" in plan or "PartitionFilters: [flight_bucket" in plan
    assert "GreaterThanOrEqual(timestam" in plan
    assert st.load("GPS", "a").count() == 0 and st.load("ATT", "a", ["nope"]).count() == 0
    assert {r.flight_id: (r.start_us, r.end_us) for r in st.time_range("ATT", ["a", "zz"]).collect()} == {"a": (0, 990), "zz": (0, 0)}
    pts = st.plot_channels(["ATT.roll_deg", "BAT.voltage_v", "bad", "ATT.none"], "a", max_points=10)
    assert {(r.channel, r["count"]) for r in pts.groupBy("channel").count().collect()} == {("ATT.roll_deg", 10), ("BAT.voltage_v", 10)}
    assert st.query("select count(*) n from ATT join BAT using (flight_id, seq)").first().n == 200
    al = st.aligned("ATT", ["BAT"], {"ATT": ["roll_deg"], "BAT": ["voltage_v"]}, 5, "a", 0, 50).orderBy("timestamp_us").collect()
    assert [r.BAT_voltage_v for r in al] == [0, 1, 2, 3, 4, 5] and al[0].ATT_roll_deg == 0
    st.write_derived("events", att.select("flight_id", "roll_deg"))
    assert st.read_derived("events", "b").count() == 100
    st.export_json("events", str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 200


def test_catalog(spark, tmp_path):
    c = Catalog(spark, str(tmp_path))
    c.append("flights", spark.createDataFrame([("f1", "h1", "a.bin", "2024-01-01", "junk"), ("f2", "h2", "b.bin", "2024-01-02", "junk")],
                                              "flight_id string, sha256 string, filename string, uploaded_at string, odd string"))
    c.append("investigations", spark.createDataFrame([("i1", "f1", "why")], "investigation_id string, flight_id string, query string"))
    c.append("hypotheses", spark.createDataFrame([("h1", "i1", "gps")], "hypothesis_id string, investigation_id string, text string"))
    c.append("anomalies", spark.createDataFrame([("f1", 5, "CRITICAL", "GPS"), ("f1", 2, "WARNING", "GPS"), ("f1", 1, "CRITICAL", "EKF")],
                                                "flight_id string, timestamp_us long, severity string, category string"))
    assert [r.flight_id for r in c.list_flights(1, 1).collect()] == ["f1"]
    c.update("flights", "f1", status="ready", message_types=["ATT"], nothing=1)
    f = c.flight_by_hash("h1").first()
    assert f.status == "ready" and f.message_types == ["ATT"] and f.filename == "a.bin"
    assert [r.timestamp_us for r in c.anomalies("f1", ["CRITICAL"]).collect()] == [1, 5]
    assert [r.timestamp_us for r in c.anomalies("f1", category="GPS").collect()] == [2, 5]
    assert {(r.flight_id, r.text) for r in c.investigation_tree().collect()} == {("f1", "gps"), ("f2", None)}
    c.delete_flight("f1")
    assert [c.read(t).count() for t in ("flights", "investigations", "hypotheses", "anomalies")] == [1, 0, 0, 0]
    c.compact(str(tmp_path / "new"))
    assert Catalog(spark, str(tmp_path / "new")).read("flights").count() == 1


def test_top_k(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (200, 8)).astype(np.float32)
    base = spark.createDataFrame([(i, v.tolist(), i % 2 == 0) for i, v in enumerate(x)], "id long, embedding array<float>, ok boolean").repartition(4)
    q = base.where("id < 12").withColumnRenamed("id", "query_id")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, r + 1): int(j) for i in range(12) for r, j in enumerate([k for k in np.argsort(-(u @ u[i])) if k % 2 == 0][:5])}
    for limit in (4096, 3):
        got = {(r.query_id, r["rank"]): r.id for r in similarity.top_k(q, base, 5, where=F.col("ok"), query_limit=limit).collect()}
        assert got == want


def test_streams(spark, tmp_path):
    rows, t = [], 0
    rng = np.random.default_rng(2)
    for i in range(300):
        t += int(rng.integers(1, 20)) * 1_000_000
        rows.append((f"k{i % 3}", t, i, float(rng.uniform(0, 100))))
    df = spark.createDataFrame(rows, "flight_id string, us long, s long, v double").withColumn("at", F.timestamp_micros("us"))
    for i in range(3):
        df.where(F.col("s").between(i * 100, i * 100 + 99)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))

    def run(stream, name, mode="append"):
        query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option(
            "checkpointLocation", str(tmp_path / ("ck_" + name))).start()
        query.awaitTermination(240)
        return spark.table(name)

    # series end with an unsatisfied row so that every run is closed by data
    last = df.groupBy("flight_id").agg(F.max("us").alias("us")).collect()
    s = open_series(df, ["flight_id"], ["us", "s"])
    batch = runs.violation_groups(s, [runs.Check("c", F.col("v") > 40, F.col("v"), 20_000_000)])
    ends = {r.flight_id: r.us for r in last}
    want = sorted((r.flight_id, r.start, r.end, r.n) for r in batch.collect() if r.end < ends[r.flight_id])
    got = run(sustained_stream(src, "flight_id", "at", "s", F.col("v") > 40, F.col("v"), 20_000_000), "sus")
    assert sorted((r.flight_id, r.start, r.end, r.n) for r in got.collect() if r.end < ends[r.flight_id]) == want

    acted = src.withColumn("action", F.lit("uploads"))
    quota = run(stateless.over_quota_stream(acted, "flight_id", "action", "at", 20, 600, "1 minute"), "quota", "update")
    top = {(r.flight_id, r.window_start_us): r.n for r in quota.groupBy("flight_id", "window_start_us").agg(F.max("n").alias("n")).collect()}
    b = stateless.over_quota(df.withColumn("action", F.lit("uploads")), "flight_id", "action", "us", 20, 600)
    assert top == {(r.flight_id, r.window_start_us): r.n for r in b.collect()} and top

    imu = src.select("flight_id", F.col("us").alias("timestamp_us"), F.col("s").alias("seq"), F.col("v").alias("acc_x_m_s2"),
                     F.lit(0.0).alias("acc_y_m_s2"), F.lit(0.0).alias("acc_z_m_s2"))
    assert run(stateless.point_anomalies(spark, {"IMU": imu}), "pts").count() == df.where("abs(v - 9.81) > 20").count()
    err = src.select("flight_id", F.col("us").alias("timestamp_us"), F.col("s").alias("seq"), F.lit(16).alias("subsys"), F.lit(1).alias("ecode"))
    assert run(stateless.error_stream(spark, err), "errs").where("severity = 'CRITICAL'").count() == 300


def test_ingest(spark, tmp_path):
    from contrail.plans.ingest import ingest

    S = 1_000_000
    rows = [("MODE", {"TimeUS": 0, "Mode": 5, "Rsn": 1}), ("MODE", {"TimeUS": 5 * S, "Mode": 6, "Rsn": 4}), ("ERR", {"TimeUS": 6 * S, "Subsys": 16, "ECode": 2})]
    rows += [("GPS", {"TimeUS": i * S // 5, "HDop": 6.0, "NSats": 12, "Status": 3, "RelAlt": 10}) for i in range(60)]
    st = TelemetryStore(spark, str(tmp_path / "store"), 4)
    assert "GPS" in ingest(raw(spark, rows), "ardupilot_bin", st)
    assert {r.rule_name for r in st.read_derived("anomalies").collect()} == {"GPS_HDOP_DEGRADATION", "EKF_LANE_SWITCH", "UNEXPECTED_MODE_CHANGE"}
    assert {r.name for r in st.read_derived("phases").collect()} == {"HOVER", "RTL"}
    assert {r.event_type for r in st.read_derived("events").collect()} == {"ARM", "MODE_CHANGE", "ERROR"}
    assert st.load("GPS").count() == 60
    derived = {n: sorted(map(str, st.read_derived(n).collect())) for n in ("events", "phases", "anomalies")}
    ingest(raw(spark, rows), "ardupilot_bin", st)  # again: the same rows
    assert st.load("GPS").count() == 60
    assert derived == {n: sorted(map(str, st.read_derived(n).collect())) for n in derived}
    plan = st.load("GPS", buckets=[1, 2])._jdf.queryExecution().executedPlan().toString()
    assert "flight_bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_a_flight_in_two_batches_is_read_once(spark, tmp_path):
    """The newest batch that holds a flight counts, in tables, derived rows, sizes and time ranges."""
    from contrail.plans.ingest import ingest

    S = 1_000_000
    st = TelemetryStore(spark, str(tmp_path / "store"), 4)

    def flight(name, n, fix=3):
        rows = [("MODE", {"TimeUS": 0, "Mode": 5, "Rsn": 1})] + [("GPS", {"TimeUS": i * S // 5, "HDop": 1.0, "NSats": 12, "Status": fix, "RelAlt": 10}) for i in range(n)]
        return raw(spark, rows).withColumn("flight_id", F.lit(name))

    ingest(flight("f1", 60).unionByName(flight("f2", 40)), "ardupilot_bin", st)
    ingest(flight("f1", 25).unionByName(flight("f3", 10)), "ardupilot_bin", st, "2024")
    sizes = {"f1": 25, "f2": 40, "f3": 10}
    assert {r.flight_id: r["count"] for r in st.load("GPS").groupBy("flight_id").count().collect()} == sizes
    assert {r.flight_id: r.rows for r in st.stats("GPS").collect()} == sizes and st.largest_series(["GPS", "BAT"]) == {"GPS": 40, "BAT": 0}
    assert st.load("GPS", "f1").count() == 25 and st.load("GPS", ["f1", "f2"], start_us=4 * S).count() == 5 + 20
    assert {r.flight_id: r.end_us for r in st.time_range("GPS", ["f1", "f2", "no"]).collect()} == {"f1": 24 * S // 5, "f2": 39 * S // 5, "no": 0}
    assert {r.flight_id: r["count"] for r in st.read_derived("phases").groupBy("flight_id").count().collect()} == {"f1": 1, "f2": 1, "f3": 1}
    assert [r.flight_id for r in st.replaced().collect()] == ["f1"]
    assert "GPS" in st.available_types() and not {"flight_index", "series_stats", "derived"} & set(st.available_types())


def test_sizes_from_the_store_spare_the_count(spark, tmp_path, monkeypatch):
    from contrail.operators import series
    from contrail.plans import timeline
    from contrail.plans.rules.common import Telemetry

    st = TelemetryStore(spark, str(tmp_path / "t"), buckets=2)
    mode = spark.createDataFrame([("a", t, t, t % 3) for t in range(30)], "flight_id string, timestamp_us long, seq long, mode_num int")
    st.write("MODE", mode)
    st.write("PARM", mode.select("flight_id", "timestamp_us", "seq", F.lit("x").alias("name"), F.lit(1.0).alias("value")))
    tables = st.load_many(["MODE", "PARM"])
    want = sorted(map(str, timeline.timeline(Telemetry(spark, tables)).collect()))
    counted = []
    monkeypatch.setattr(series, "_fits_one_task", lambda *a: counted.append(a) or True)
    known = Telemetry(spark, tables, largest=st.largest_series(["MODE", "PARM"]))
    assert sorted(map(str, timeline.timeline(known).collect())) == want and not counted
    monkeypatch.undo()
    short = Telemetry(spark, tables, max_rows=7, largest=st.largest_series(["MODE", "PARM"]))  # over the limit: blocks, same rows
    assert sorted(map(str, timeline.timeline(short).collect())) == want


def test_unreadable_is_not_empty(spark, tmp_path):
    store, c = TelemetryStore(spark, str(tmp_path / "s")), Catalog(spark, str(tmp_path / "c"))
    assert store.load("GPS").count() == 0 and c.read("flights").count() == 0
    assert store.load("GPS", columns=["hdop", "nope"]).columns == ["hdop", "nope"]
    for folder in (tmp_path / "s" / "GPS", tmp_path / "c" / "tombstones"):
        folder.mkdir(parents=True)
        (folder / "part-0.parquet").write_bytes(b"not a table")
    with pytest.raises(Exception, match="part-0|FAILED_READ|CANNOT_READ"):
        store.load("GPS").count()
    with pytest.raises(Exception, match="part-0|FAILED_READ|CANNOT_READ"):
        c.read("flights").count()


@pytest.mark.parametrize("seed", range(20))
def test_runs_over_batches(seed):
    """Runs found batch by batch equal those of all rows at once, whatever the batches and NULL values."""
    rng = np.random.default_rng(seed)
    n = int(rng.integers(1, 60))
    rows = pd.DataFrame({"us": np.arange(n) * 7, "hit": rng.random(n) < 0.6, "v": np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))})
    want, at = [], None
    for i in range(n + 1):
        inside = i < n and rows.hit[i]
        if inside and at is None:
            at = i
        if not inside and at is not None:
            part = rows[at:i]
            want.append((part.us.iloc[0], part.us.iloc[-1], len(part), part.v.count(), part.v.max(), part.v.sum()))
            at = None
    run, got = [0, 0, 0, 0, np.nan, 0.0], []
    cuts = [0, *sorted(rng.integers(0, n + 1, 4)), n]
    for a, b in zip(cuts, cuts[1:]):
        done, run = _join_runs(run, rows[a:b])
        got += done.values.tolist()
    got += [run] if run[2] else []
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g == pytest.approx(w, nan_ok=True)
