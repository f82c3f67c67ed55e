"""Each rule: nominal input gives nothing, a violating flight gives the expected anomaly."""

import pytest
from pyspark.sql import functions as F

from contrail.plans.rules.common import Telemetry
from contrail.plans.rules.registry import RULE_NAMES, in_report_order, run_rules


def frame(spark, n, step, flight="f1", t0=0, **cols):
    data, names = [], ["flight_id", "timestamp_us", "seq", *cols]
    for i in range(n):
        data.append((flight, t0 + i * step, i, *[v[i] if isinstance(v, list) else v for v in cols.values()]))
    return spark.createDataFrame(data, names)


def fire(spark, rule, limit=None, **tables):
    got = run_rules(Telemetry(spark, tables, limit), [rule]).collect()
    assert all(a.rule_name == rule for a in got)
    return got


def severities(got):
    return sorted({a.severity for a in got})


def test_all_rules_are_registered():
    assert len(RULE_NAMES) == 29


def ekf(spark, vals, **extra):
    return frame(spark, len(vals), 100_000, var_ratio_vel=vals, var_ratio_pos=0.1, **extra)


@pytest.mark.parametrize("limit", [None, 20])
def test_velocity_innovation(spark, limit):
    rule = "EKF_INNOV_VEL"
    assert fire(spark, rule, limit, NKF4=ekf(spark, [0.2] * 60)) == []
    warn = fire(spark, rule, limit, NKF4=ekf(spark, [0.7] * 60))
    assert severities(warn) == ["WARNING"]
    assert warn[0].timestamp_us == 0 and warn[0].end_timestamp_us == 5_900_000
    assert warn[0].description == (
        "Velocity test ratio averaged 0.70 over 5.9 s (limit 0.5)"
    )
    assert warn[0].raw_values["var_ratio_vel_max"] == pytest.approx(0.7)
    assert "CRITICAL" in severities(fire(spark, rule, limit, NKF4=ekf(spark, [1.5] * 30)))
    assert "CRITICAL" in severities(fire(spark, rule, limit, XKF4=ekf(spark, [1.5] * 30)))
    assert "CRITICAL" not in severities(fire(spark, rule, limit, NKF4=ekf(spark, [0.1] * 10 + [1.5] + [0.1] * 10)))


def test_fallback_is_per_flight(spark):
    first = ekf(spark, [0.2] * 30)
    second = ekf(spark, [1.5] * 30).unionByName(frame(spark, 30, 100_000, "f2", var_ratio_vel=1.5, var_ratio_pos=0.1))
    got = fire(spark, "EKF_INNOV_VEL", NKF4=first, XKF4=second)
    assert {a.flight_id for a in got} == {"f2"}


def test_other_ekf_rules(spark):
    base = {"var_ratio_vel": 0.1}
    assert severities(fire(spark, "EKF_INNOV_POS", NKF4=frame(spark, 30, 100_000, var_ratio_pos=1.5))) == ["CRITICAL"]
    assert severities(fire(spark, "EKF_HEIGHT_INNOV", NKF4=frame(spark, 40, 100_000, var_ratio_hgt=1.5))) == ["WARNING"]
    assert len(fire(spark, "EKF_POS_OFFSET_GROWTH", NKF4=frame(spark, 30, 100_000, offset_n=8.0, offset_e=-9.0))) == 2
    assert severities(fire(spark, "EKF_MAG_INNOV", NKF3=frame(spark, 60, 100_000, innov_heading=-0.5))) == ["WARNING"]
    spike = fire(spark, "EKF_VEL_INNOV_SPIKE", XKF3=frame(spark, 3, 1, innov_vel_n=[0.0, -3.0, 0.0], innov_vel_e=[5.0, 0.0, 0.0]))
    assert sorted((a.channel, a.timestamp_us) for a in spike) == [("innov_vel_e", 0), ("innov_vel_n", 1)]
    lane = fire(spark, "EKF_LANE_SWITCH", NKF4=frame(spark, 4, 1, lane=[0, 0, 1, 1], **base),
                ERR=frame(spark, 2, 1, t0=50, subsys=[16, 3], ecode=[1, 1], subsys_name=["EKFCHECK", "COMPASS"]))
    assert sorted(a.timestamp_us for a in lane) == [2, 50]


def gps(spark, n=60, **cols):
    base = {"hdop": 1.2, "num_sats": 14, "lat_deg": -35.0, "lng_deg": 149.0, "fix_type": 3, "gnd_speed_m_s": 0.0}
    return frame(spark, n, 200_000, **(base | cols))


def test_gps_rules(spark):
    ok = gps(spark)
    for rule in [r for r in RULE_NAMES if r.startswith("GPS_")]:
        assert fire(spark, rule, GPS=ok) == []
    assert severities(fire(spark, "GPS_HDOP_DEGRADATION", GPS=gps(spark, hdop=3.0))) == ["WARNING"]
    assert severities(fire(spark, "GPS_HDOP_DEGRADATION", GPS=gps(spark, hdop=6.0))) == ["CRITICAL", "WARNING"]
    drop = fire(spark, "GPS_SAT_COUNT_DROP", GPS=gps(spark, num_sats=[14] * 10 + [8] * 50))
    assert severities(drop) == ["CRITICAL"] and drop[0].raw_values["drop"] == 6
    assert severities(fire(spark, "GPS_LOW_SAT_COUNT", GPS=gps(spark, 90, num_sats=5))) == ["WARNING"]
    assert severities(fire(spark, "GPS_FIX_DROP", GPS=gps(spark, fix_type=[3] * 20 + [1] * 40))) == ["CRITICAL"]
    jump = gps(spark, lat_deg=[-35.0] * 30 + [-35.001] + [-35.0] * 29)
    assert len(fire(spark, "GPS_POSITION_GLITCH", GPS=jump)) == 2
    # a no-fix placeholder position is not a jump
    lost = gps(spark, lat_deg=[-35.0] * 30 + [0.0] + [-35.0] * 29, fix_type=[3] * 30 + [0] + [3] * 29)
    assert fire(spark, "GPS_POSITION_GLITCH", GPS=lost) == []
    spoof = gps(spark, lat_deg=[-35.0] * 30 + [-35.001] * 30, hdop=[1.5] * 30 + [0.9] * 30)
    assert severities(fire(spark, "GPS_SPOOF_INDICATOR", GPS=spoof)) == ["WARNING"]


def bat(spark, volts, **cols):
    base = {"current_a": 10.0, "remaining_pct": 80.0}
    return frame(spark, len(volts), 200_000, voltage_v=volts, **(base | cols))


def test_power_rules(spark):
    flat = bat(spark, [16.8] * 50)
    for rule in [r for r in RULE_NAMES if r.startswith("BAT_")]:
        assert fire(spark, rule, BAT=flat) == []
    sag = [16.8] * 5 + [12.8] + [16.8] * 5
    assert severities(fire(spark, "BAT_VOLTAGE_SAG", BAT=bat(spark, sag))) == ["CRITICAL", "WARNING"]
    assert fire(spark, "BAT_VOLTAGE_SAG", CURR=bat(spark, sag))
    brown = fire(spark, "BAT_BROWNOUT", BAT=bat(spark, [16.8] + [12.8] * 10))
    assert severities(brown) == ["CRITICAL"]
    assert "under 13.2 V, the least for 4 cells" in brown[0].description
    assert severities(fire(spark, "BAT_LOW_CAPACITY", BAT=bat(spark, [16.8] * 30, remaining_pct=15.0))) == ["WARNING"]
    assert "CRITICAL" in severities(fire(spark, "BAT_LOW_CAPACITY", BAT=bat(spark, [16.8] * 15, remaining_pct=8.0)))
    assert fire(spark, "BAT_LOW_CAPACITY", CURR=bat(spark, [16.8] * 30, remaining_pct=8.0)) == []
    spike = fire(spark, "BAT_CURRENT_SPIKE", BAT=bat(spark, [16.8] * 60, current_a=[10.0] * 30 + [90.0] + [10.0] * 29))
    assert [a.timestamp_us for a in spike] == [6_000_000]
    assert spike[0].raw_values["baseline_a"] == pytest.approx(14.0)
    assert fire(spark, "BAT_CURRENT_SPIKE", BAT=bat(spark, [16.8] * 39, current_a=[10.0] * 30 + [90.0] + [10.0] * 8)) == []
    r = fire(spark, "BAT_HIGH_R_INT", BAT=bat(spark, [16.0, 15.0] * 8, current_a=[0.0, 10.0] * 8))
    assert severities(r) == ["WARNING"] and r[0].raw_values["r_int_ohm"] == pytest.approx(0.1)
    assert severities(fire(spark, "BAT_HIGH_R_INT", BAT=bat(spark, [16.0, 14.0] * 8, current_a=[0.0, 10.0] * 8))) == ["CRITICAL"]


def test_vibration_rules(spark):
    calm = frame(spark, 60, 100_000, vibe_x=3.0, vibe_y=3.0, vibe_z=3.0, clip0=0, clip1=0, clip2=0)
    assert fire(spark, "VIBE_HIGH_RMS", VIBE=calm) == [] == fire(spark, "IMU_CLIPPING", VIBE=calm)
    rough = frame(spark, 60, 100_000, vibe_x=20.0, vibe_y=3.0, vibe_z=40.0, clip0=[0] * 30 + [20] + [0] * 29, clip1=7, clip2=0)
    got = fire(spark, "VIBE_HIGH_RMS", VIBE=rough)
    assert sorted((a.channel, a.severity) for a in got) == [("vibe_x", "WARNING"), ("vibe_z", "CRITICAL"), ("vibe_z", "WARNING")]
    clip = fire(spark, "IMU_CLIPPING", VIBE=rough)
    assert sorted((a.channel, a.severity, round(a.raw_values["peak"])) for a in clip) == [("clip0", "CRITICAL", 200), ("clip1", "WARNING", 70)]
    imu = fire(spark, "IMU_RAW_EXTREME", IMU=frame(spark, 3, 1, acc_x_m_s2=[0.0, 40.0, 0.0], acc_y_m_s2=0.0, acc_z_m_s2=9.81))
    assert [a.timestamp_us for a in imu] == [1]


def test_motor_rules(spark):
    n = 150
    level = frame(spark, n, 100_000, roll_deg=1.0, pitch_deg=-1.0)
    even = frame(spark, n, 100_000, ch1_us=1500.0, ch2_us=1500.0, ch3_us=1500.0, ch4_us=1500.0)
    odd = frame(spark, n, 100_000, ch1_us=1500.0, ch2_us=1500.0, ch3_us=1500.0, ch4_us=1100.0)
    assert fire(spark, "MOTOR_IMBALANCE", RCOU=even, ATT=level) == []
    got = fire(spark, "MOTOR_IMBALANCE", RCOU=odd, ATT=level)
    assert severities(got) == ["WARNING"] and got[0].labels == {"highest": "ch1_us", "lowest": "ch4_us"}
    tilted = frame(spark, n, 100_000, roll_deg=20.0, pitch_deg=0.0)
    assert fire(spark, "MOTOR_IMBALANCE", RCOU=odd, ATT=tilted) == []
    sat = frame(spark, 30, 100_000, ch1_us=1980.0, ch2_us=1500.0, ch3_us=1500.0, ch4_us=1500.0)
    assert [a.channel for a in fire(spark, "MOTOR_OUTPUT_SATURATION", RCOU=sat)] == ["ch1_us"]
    drop = frame(spark, 120, 100_000, t0=100_000, ch1_us=1000.0, ch2_us=1600.0, ch3_us=1600.0, ch4_us=1600.0)
    assert [a.timestamp_us for a in sorted(fire(spark, "MOTOR_OUTPUT_DROP", RCOU=drop))] == [100_000, 5_200_000, 10_300_000]
    esc = frame(spark, 6, 100_000, rpm=[5000.0, 5000.0, 2000.0, 2000.0, 2000.0, 400.0], instance=2)
    assert [a.timestamp_us for a in sorted(fire(spark, "ESC_DESYNC", ESC=esc), key=lambda a: a.timestamp_us)] == [200_000, 500_000]


def mode(spark, rows):
    return spark.createDataFrame([("f1", t, i, m, n, r) for i, (t, m, n, r) in enumerate(rows)],
                                 "flight_id string, timestamp_us long, seq long, mode_num int, mode_name string, reason int")


def test_mission_rules(spark):
    S = 1_000_000
    err = frame(spark, 3, 10 * S, t0=10 * S, subsys=[5, 7, 6], ecode=1)
    m = mode(spark, [(0, 5, "LOITER", 1), (11 * S, 6, "RTL", 4), (22 * S, 9, "LAND", 5)])
    got = fire(spark, "FAILSAFE_VERIFY", ERR=err, MODE=m)
    assert sorted((a.timestamp_us // S, a.severity) for a in got) == [(20, "WARNING"), (30, "CRITICAL")]
    assert fire(spark, "FAILSAFE_VERIFY", ERR=err, MODE=m.where("false")) == []
    got = fire(spark, "UNEXPECTED_MODE_CHANGE", MODE=m)
    assert sorted(a.timestamp_us // S for a in got) == [11, 22]
    g = frame(spark, 20, S, t0=11 * S, alt_rel_m=[50.0 - 4 * i for i in range(20)], fix_type=3)
    assert severities(fire(spark, "RTL_BEHAVIOR", MODE=m, GPS=g)) == ["CRITICAL"]
    assert fire(spark, "RTL_BEHAVIOR", MODE=m, GPS=frame(spark, 20, S, t0=11 * S, alt_rel_m=50.0)) == []
    bad = frame(spark, 5, S, fix_type=[3, 2, 3, 3, 3])
    assert severities(fire(spark, "UNSAFE_ARM", MODE=m, GPS=bad)) == ["WARNING"]
    assert fire(spark, "UNSAFE_ARM", MODE=m, GPS=frame(spark, 5, S, fix_type=3)) == []


def test_absent_tables_columns_and_order(spark):
    assert run_rules(Telemetry(spark, {})).count() == 0
    assert fire(spark, "GPS_HDOP_DEGRADATION", GPS=frame(spark, 5, 1, num_sats=3)) == []
    got = in_report_order(run_rules(Telemetry(spark, {"GPS": gps(spark, hdop=6.0), "NKF4": ekf(spark, [1.5] * 60)}))).collect()
    assert [a.severity for a in got][:3] == ["CRITICAL", "CRITICAL", "WARNING"]
    nan = gps(spark).withColumn("hdop", F.lit(float("nan")))
    assert fire(spark, "GPS_HDOP_DEGRADATION", GPS=nan) == []
