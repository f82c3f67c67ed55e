"""Every rule, the timeline, phases and metrics over telemetry derived from all events."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.catalogue.base import Query, groups_sql, rounded, telemetry, telemetry_sql
from contrail.operators.stats import STANDARD_CHANNELS, STANDARD_WINDOW, standard_channel_checks
from contrail.plans import compliance, metrics, timeline
from contrail.plans.rules import rows
from contrail.plans.rules.registry import run_rules

S = 1_000_000
_OUT = "flight_id, severity, channel, timestamp_us, end_timestamp_us, value"
_W = "OVER (PARTITION BY flight_id ORDER BY timestamp_us, seq)"


def _project(anomalies, *raw_keys, digits=6):
    value = F.coalesce(*[F.try_element_at("raw_values", F.lit(k)) for k in raw_keys])
    return anomalies.select("flight_id", "severity", "channel", "timestamp_us", "end_timestamp_us", rounded(value, digits).alias("value"))


def _rule(name, keys, sql, by="user", sources=(), digits=6):
    def run(spark, sf):
        return _project(run_rules(telemetry(spark, sf, by), [name]), *keys, digits=digits)

    return Query(f"rule_{name.lower()}", run, telemetry_sql(*sources, by=by) + sql)


def _grouped(name, table, parts, pick, keys, prefix="", src=None, digits=6):
    """parts: (severity, channel, condition, value, minimum duration, gap)."""
    sql = prefix + " UNION ALL ".join(
        f"SELECT flight_id, '{sev}' AS severity, '{ch}' AS channel, start_us AS timestamp_us, end_us AS end_timestamp_us, round({pick}, {digits}) AS value "
        f"FROM {groups_sql(src or table, cond, val, min_duration=dur, gap=gap)}"
        for sev, ch, cond, val, dur, gap in parts
    )
    return _rule(name, keys, sql, sources=(table,), digits=digits)


def _level(name, table, *limits):
    parts = [(sev, f, cond, f, dur * S, 1) for sev, f, cond, dur in limits]
    return _grouped(name, table, parts, "v_mean", [f"{f}_mean" for f in dict.fromkeys(p[1] for p in parts)], prefix=" ", digits=9)


_SAG = """, p AS (SELECT *, timestamp_us - lag(timestamp_us) OVER w AS d0, lead(timestamp_us) OVER w - timestamp_us AS d1, lag(voltage_v) OVER w AS v0,
  lead(voltage_v) OVER w AS v1, count(*) OVER (PARTITION BY flight_id) AS n_all FROM BAT WINDOW w AS (PARTITION BY flight_id ORDER BY timestamp_us, seq)),
h AS (SELECT *, d0 * 1e-6::DOUBLE AS h0, d1 * 1e-6::DOUBLE AS h1 FROM p),
g AS (SELECT *, CASE WHEN n_all < 3 THEN NULL WHEN d0 IS NULL THEN (v1 - voltage_v) / nullif(h1, 0) WHEN d1 IS NULL THEN (voltage_v - v0) / nullif(h0, 0)
  ELSE (h0*h0*v1 + (h1*h1 - h0*h0)*voltage_v - h1*h1*v0) / nullif(h0*h1*(h0+h1), 0) END AS dv_dt FROM h) """
_BROWN = """, c AS (SELECT *, greatest(1.0::DOUBLE, round_even(max(voltage_v) OVER (PARTITION BY flight_id) / 4.2, 0)) AS cells FROM BAT) """
_SPIKE = """, b AS (SELECT *, greatest(sum(current_a) OVER (PARTITION BY flight_id ORDER BY timestamp_us, seq ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) / 20, 1.0) AS base,
  count(*) OVER (PARTITION BY flight_id) AS n_all FROM BAT) """
_CLIPS = f""", d AS (SELECT *, greatest(coalesce(timestamp_us - lag(timestamp_us) {_W}, lead(timestamp_us) {_W} - timestamp_us) / 1e6, 0.001) AS dt FROM VIBE),
r AS (SELECT *, clip0 / dt AS r0, clip1 / dt AS r1, clip2 / dt AS r2 FROM d) """

_GROUPED = [
    _level("EKF_INNOV_VEL", "NKF4", ("WARNING", "var_ratio_vel", "var_ratio_vel > 0.5", 5), ("CRITICAL", "var_ratio_vel", "var_ratio_vel > 1.0", 2)),
    _level("EKF_INNOV_POS", "NKF4", ("CRITICAL", "var_ratio_pos", "var_ratio_pos > 1.0", 2)),
    _level("EKF_HEIGHT_INNOV", "NKF4", ("WARNING", "var_ratio_hgt", "var_ratio_hgt > 1.0", 3)),
    _level("EKF_POS_OFFSET_GROWTH", "NKF4", *[("WARNING", c, f"abs({c}) > 5.0", 2) for c in ("offset_n", "offset_e")]),
    _level("EKF_MAG_INNOV", "NKF3", ("WARNING", "innov_heading", "abs(innov_heading) > 0.3", 5)),
    _level("GPS_HDOP_DEGRADATION", "GPS", ("WARNING", "hdop", "hdop > 2.0", 10), ("CRITICAL", "hdop", "hdop > 5.0", 5)),
    _level("GPS_LOW_SAT_COUNT", "GPS", ("WARNING", "num_sats", "num_sats < 8", 15)),
    _level("GPS_FIX_DROP", "GPS", ("CRITICAL", "fix_type", "fix_type < 3", 3)),
    _level("BAT_LOW_CAPACITY", "BAT", ("WARNING", "remaining_pct", "remaining_pct < 20", 5), ("CRITICAL", "remaining_pct", "remaining_pct < 10", 2)),
    _level("VIBE_HIGH_RMS", "VIBE", *[(s, f"vibe_{a}", f"vibe_{a} > {v}", d) for a in "xyz" for s, v, d in (("WARNING", 15, 5), ("CRITICAL", 30, 3))]),
    _level("MOTOR_OUTPUT_SATURATION", "RCOU", *[("CRITICAL", f"ch{i}_us", f"ch{i}_us > 1950", 2) for i in (1, 2, 3, 4)]),
    _grouped("IMU_CLIPPING", "VIBE", [(s, f"clip{i}", c.replace("r", f"r{i}"), f"r{i}", 0, 5) for i in (0, 1, 2)
                                      for s, c in (("CRITICAL", "r > 100"), ("WARNING", "r > 50 AND r <= 100".replace("AND r", "AND r")))],
             "v_max", ["peak"], _CLIPS, "r"),
    _grouped("BAT_VOLTAGE_SAG", "BAT", [(s, "dv_dt", f"dv_dt < {t}", "dv_dt", 0, 3) for s, t in (("WARNING", -1.0), ("CRITICAL", -3.0))],
             "v_min", ["dv_dt_worst"], _SAG, "g"),
    _grouped("BAT_BROWNOUT", "BAT", [("CRITICAL", "voltage_v", "voltage_v < cells * 3.3::DOUBLE", "voltage_v", S // 2, 1)], "v_mean", ["voltage_v_mean"], _BROWN, "c", 9),
    _grouped("BAT_CURRENT_SPIKE", "BAT", [("WARNING", "current_a", "n_all >= 40 AND current_a > base * 2.5", "current_a", 0, 5)], "v_max", ["peak"], _SPIKE, "b"),
]


def _rows_sql(select, frm):
    return f" SELECT flight_id, {select} {frm}"


def _point(sev, value, channel="NULL", ts="timestamp_us", digits=6):
    return f"{sev} AS severity, {channel} AS channel, {ts} AS timestamp_us, CAST(NULL AS BIGINT) AS end_timestamp_us, round(CAST({value} AS DOUBLE), {digits}) AS value"


def _hav(lat0, lng0, lat, lng):
    a = (f"pow(sin(radians({lat} - {lat0}) / 2), 2) + cos(radians({lat0})) * cos(radians({lat})) * pow(sin(radians({lng} - {lng0}) / 2), 2)")
    return f"12742000.0::DOUBLE * atan2(sqrt({a}), sqrt(1 - ({a})))"


_JUMP = _hav("lat0", "lng0", "lat_deg", "lng_deg")
_ROWS = [
    _rule("EKF_LANE_SWITCH", ["lane_diff", "ecode"],
          f""", l AS (SELECT *, lane - lag(lane) {_W} AS diff FROM NKF4)
SELECT flight_id, {_point("'CRITICAL'", "ecode")} FROM ERR WHERE subsys IN (16, 17, 24)
UNION ALL SELECT flight_id, {_point("'CRITICAL'", "diff")} FROM l WHERE abs(diff) > 0""", sources=("NKF4", "ERR")),
    _rule("EKF_VEL_INNOV_SPIKE", ["innov_vel_n", "innov_vel_e", "innov_vel_d"],
          " " + " UNION ALL ".join(f"SELECT flight_id, {_point(chr(39) + 'CRITICAL' + chr(39), c, chr(39) + c + chr(39))} FROM NKF3 WHERE abs({c}) > 2.0"
                                   for c in ("innov_vel_n", "innov_vel_e", "innov_vel_d")), sources=("NKF3",)),
    _rule("GPS_SAT_COUNT_DROP", ["drop"],
          f""", p AS (SELECT *, lag(num_sats) {_W} - num_sats AS drop_, timestamp_us - lag(timestamp_us) {_W} AS dt FROM GPS)
SELECT flight_id, {_point("CASE WHEN drop_ >= 6 THEN 'CRITICAL' ELSE 'WARNING' END", "drop_")} FROM p WHERE dt > 0 AND dt <= 10000000 AND drop_ >= 4""", sources=("GPS",)),
    _rule("GPS_POSITION_GLITCH", ["jump_m"],
          f""", f AS (SELECT *, lag(lat_deg) {_W} AS lat0, lag(lng_deg) {_W} AS lng0, (timestamp_us - lag(timestamp_us) {_W}) / 1e6 AS dt FROM GPS WHERE fix_type >= 3),
j AS (SELECT *, {_JUMP} AS jump FROM f WHERE dt > 0 AND dt <= 5.0)
SELECT flight_id, {_point("'CRITICAL'", "jump", digits=3)} FROM j WHERE jump > 5.0 AND jump > greatest(gnd_speed_m_s, 0.1) * dt * 3.0""", sources=("GPS",), digits=3),
    _rule("GPS_SPOOF_INDICATOR", ["jump_m"],
          f""", f AS (SELECT *, lag(lat_deg) {_W} AS lat0, lag(lng_deg) {_W} AS lng0, lag(hdop) {_W} - hdop AS gain, (timestamp_us - lag(timestamp_us) {_W}) / 1e6 AS dt FROM GPS),
j AS (SELECT *, {_JUMP} AS jump FROM f WHERE dt > 0 AND dt <= 2.0)
SELECT flight_id, {_point("'WARNING'", "jump", digits=3)} FROM j WHERE jump > 10.0 AND gain > 0.3""", sources=("GPS",), digits=3),
    _rule("BAT_HIGH_R_INT", ["r_int_ohm"],
          f""", d AS (SELECT *, -(voltage_v - lag(voltage_v) {_W}) / nullif(current_a - lag(current_a) {_W}, 0) AS r, abs(current_a - lag(current_a) {_W}) AS di FROM BAT),
m AS (SELECT flight_id, median(r) AS r FROM d WHERE di > 5 AND r > 0 AND r < 1 GROUP BY flight_id),
c AS (SELECT flight_id, min(timestamp_us) AS timestamp_us FROM BAT GROUP BY flight_id HAVING count(*) >= 10)
SELECT flight_id, {_point("CASE WHEN r < 0.15 THEN 'WARNING' ELSE 'CRITICAL' END", "r")} FROM m JOIN c USING (flight_id) WHERE r > 0.08""", sources=("BAT",)),
    _rule("IMU_RAW_EXTREME", ["excess_m_s2"],
          f""", x AS (SELECT *, abs(sqrt(acc_x_m_s2*acc_x_m_s2 + acc_y_m_s2*acc_y_m_s2 + acc_z_m_s2*acc_z_m_s2) - 9.81) AS x FROM IMU)
SELECT flight_id, {_point("'WARNING'", "x")} FROM x WHERE x > 20.0""", sources=("IMU",)),
    _rule("MOTOR_IMBALANCE", ["cv"],
          f""", b AS (SELECT r.flight_id, r.seq, r.timestamp_us, max(a.timestamp_us) FILTER (a.timestamp_us <= r.timestamp_us) AS t0,
  min(a.timestamp_us) FILTER (a.timestamp_us > r.timestamp_us) AS t1,
  arg_max({{'r': a.roll_deg, 'p': a.pitch_deg}}, a.timestamp_us) FILTER (a.timestamp_us <= r.timestamp_us) AS v0,
  arg_min({{'r': a.roll_deg, 'p': a.pitch_deg}}, a.timestamp_us) FILTER (a.timestamp_us > r.timestamp_us) AS v1
  FROM RCOU r JOIN ATT a USING (flight_id) GROUP BY r.flight_id, r.seq, r.timestamp_us),
i AS (SELECT flight_id, seq, CASE WHEN t0 IS NULL THEN v1.r WHEN t1 IS NULL OR t0 = timestamp_us THEN v0.r ELSE v0.r + (timestamp_us - t0) / (t1 - t0) * (v1.r - v0.r) END AS roll,
  CASE WHEN t0 IS NULL THEN v1.p WHEN t1 IS NULL OR t0 = timestamp_us THEN v0.p ELSE v0.p + (timestamp_us - t0) / (t1 - t0) * (v1.p - v0.p) END AS pitch FROM b),
h AS (SELECT r.*, abs(roll) < 5 AND abs(pitch) < 5 AS hover FROM RCOU r JOIN i USING (flight_id, seq)),
g AS (SELECT flight_id, min(timestamp_us) AS timestamp_us, count(*) FILTER (hover) AS n, avg(ch1_us) FILTER (hover) AS a, avg(ch2_us) FILTER (hover) AS b,
  avg(ch3_us) FILTER (hover) AS c, avg(ch4_us) FILTER (hover) AS d FROM h GROUP BY flight_id),
v AS (SELECT *, (a + b + c + d) / 4 AS m FROM g WHERE n >= 100),
w AS (SELECT *, sqrt(((a-m)*(a-m) + (b-m)*(b-m) + (c-m)*(c-m) + (d-m)*(d-m)) / 4) / m AS cv FROM v WHERE m >= 100)
SELECT flight_id, {_point("CASE WHEN cv > 0.20 THEN 'CRITICAL' ELSE 'WARNING' END", "cv")} FROM w WHERE cv > 0.10""", by="type", sources=("RCOU", "ATT")),
    _rule("ESC_DESYNC", ["drop_pct"],
          f""", p AS (SELECT *, lag(rpm) {_W} AS rpm0, timestamp_us - lag(timestamp_us) {_W} AS dt, count(*) OVER (PARTITION BY flight_id) AS n FROM ESC),
d AS (SELECT *, (rpm0 - rpm) / greatest(rpm0, 1) AS d FROM p WHERE n >= 5 AND dt > 0 AND dt <= 200000 AND rpm0 >= 500)
SELECT flight_id, {_point("'CRITICAL'", "d", "'motor0'")} FROM d WHERE d > 0.30""", sources=("ESC",)),
    _rule("MOTOR_OUTPUT_DROP", ["ch1_us"],
          f""", c AS (SELECT flight_id, timestamp_us, min(seq) AS seq FROM RCOU WHERE least(ch1_us, ch2_us, ch3_us, ch4_us) < 1100
  AND greatest(ch1_us, ch2_us, ch3_us, ch4_us) > 1400 AND timestamp_us > 0 GROUP BY flight_id, timestamp_us),
kept AS (SELECT flight_id, min(timestamp_us) AS timestamp_us FROM c GROUP BY flight_id
  UNION ALL SELECT c.flight_id, min(c.timestamp_us) FROM kept JOIN c ON c.flight_id = kept.flight_id AND c.timestamp_us > kept.timestamp_us + 5000000 GROUP BY c.flight_id)
SELECT flight_id, {_point("'CRITICAL'", "r.ch1_us")} FROM kept JOIN c USING (flight_id, timestamp_us) JOIN RCOU r USING (flight_id, timestamp_us, seq)""", sources=("RCOU",)),
    _rule("FAILSAFE_VERIFY", ["response_mode", "ecode"],
          f""", j AS (SELECT e.flight_id, e.timestamp_us, e.seq, any_value(e.subsys) AS subsys, any_value(e.ecode) AS ecode, count(m.seq) AS n,
  count(*) FILTER (m.mode_num = 6 OR (m.mode_num = 9 AND e.subsys IN (5, 6, 9))) AS good, arg_min(m.mode_num, m.timestamp_us * 1000000000 + m.seq) AS first_mode
  FROM ERR e LEFT JOIN MODE m ON m.flight_id = e.flight_id AND m.timestamp_us BETWEEN e.timestamp_us AND e.timestamp_us + 3000000
  WHERE e.subsys BETWEEN 5 AND 9 AND e.flight_id IN (SELECT flight_id FROM MODE) GROUP BY e.flight_id, e.timestamp_us, e.seq)
SELECT flight_id, {_point("CASE WHEN n = 0 THEN 'CRITICAL' ELSE 'WARNING' END", "CASE WHEN n = 0 THEN ecode ELSE first_mode END")} FROM j WHERE good = 0""", sources=("ERR", "MODE")),
    _rule("UNEXPECTED_MODE_CHANGE", ["mode"],
          f""", p AS (SELECT *, lag(mode_num) {_W} AS m0 FROM MODE) SELECT flight_id, {_point("'INFO'", "mode_num")} FROM p
WHERE m0 IS NOT NULL AND reason BETWEEN 4 AND 11""", sources=("MODE",)),
    _rule("RTL_BEHAVIOR", ["min_alt_m"],
          f""", s AS (SELECT flight_id, min(timestamp_us) AS rtl FROM MODE WHERE mode_name = 'RTL' GROUP BY flight_id),
r AS (SELECT g.*, rtl, row_number() OVER (PARTITION BY flight_id ORDER BY timestamp_us, seq) AS rn FROM GPS g JOIN s USING (flight_id)
  WHERE timestamp_us BETWEEN rtl AND rtl + 30000000),
a AS (SELECT flight_id, rtl, count(*) AS n, max(alt_rel_m) FILTER (rn = 1) AS alt0, min(alt_rel_m) AS low FROM r WHERE rn <= 10 GROUP BY flight_id, rtl)
SELECT flight_id, {_point("'CRITICAL'", "low", ts="rtl")} FROM a WHERE n > 5 AND alt0 > 5.0 AND low < alt0 * 0.7""", sources=("MODE", "GPS")),
    _rule("UNSAFE_ARM", ["fix_type_at_arm"],
          f""", s AS (SELECT flight_id, min(timestamp_us) AS arm FROM MODE WHERE mode_name <> 'INITIALISING' GROUP BY flight_id),
a AS (SELECT flight_id, arm, min(fix_type) AS fix FROM GPS JOIN s USING (flight_id) WHERE timestamp_us BETWEEN arm - 5000000 AND arm + 2000000 GROUP BY flight_id, arm)
SELECT flight_id, {_point("'WARNING'", "fix", ts="arm")} FROM a WHERE fix < 3""", sources=("MODE", "GPS")),
]
# the recursive rule needs the keyword on its WITH
_ROWS = [Query(q.name, q.run, q.sql.replace("WITH ev", "WITH RECURSIVE ev", 1)) if q.name == "rule_motor_output_drop" else q for q in _ROWS]


def att_extreme_roll(spark, sf):
    return _project(rows.extreme_roll(telemetry(spark, sf)), "max_roll_deg")


_ROLL = f""", m AS (SELECT flight_id, max(abs(roll_deg)) AS r FROM ATT GROUP BY flight_id),
t AS (SELECT flight_id, r, min(timestamp_us) AS timestamp_us FROM ATT JOIN m USING (flight_id) WHERE abs(roll_deg) = r GROUP BY flight_id, r)
SELECT flight_id, {_point("CASE WHEN r > 60 THEN 'CRITICAL' ELSE 'WARNING' END", "r")} FROM t WHERE r > 45"""


def all_rules(spark, sf):
    found = run_rules(telemetry(spark, sf), [q.name[5:].upper() for q in [*_GROUPED, *_ROWS] if q.name != "rule_motor_imbalance"])
    return found.groupBy("rule_name", "severity").agg(F.count(F.lit(1)).alias("n"), F.min("timestamp_us").alias("first_us"))


_ALL = " UNION ALL ".join(
    f"SELECT '{q.name[5:].upper()}' AS rule_name, severity, count(*) AS n, min(timestamp_us) AS first_us FROM ({q.sql}) GROUP BY severity"
    for q in [*_GROUPED, *_ROWS] if q.name != "rule_motor_imbalance"
)


def timeline_events(spark, sf):
    return timeline.timeline(telemetry(spark, sf)).select("flight_id", "timestamp_us", "seq", "event_type", "severity")


_MODES = f"""m AS (SELECT *, lag(mode_name) {_W} AS name0, mode_num >= 0 AND mode_name <> 'INITIALISING' AS armed,
  coalesce(lag(mode_num >= 0 AND mode_name <> 'INITIALISING') {_W}, false) AS was FROM MODE)"""
_EVENTS = f"""{_MODES},
g AS (SELECT *, lag(fix_type) {_W} AS fix0, lag(num_sats) {_W} AS sats0, lag(hdop) {_W} AS hdop0 FROM GPS),
x AS (SELECT *, row_number() {_W} AS rn FROM ATT WHERE abs(roll_deg) > 60 OR abs(pitch_deg) > 60),
q AS (SELECT *, min(timestamp_us) OVER (PARTITION BY flight_id) AS t0 FROM PARM),
evt AS (
SELECT flight_id, timestamp_us, seq, 'MODE_CHANGE' AS event_type, CASE WHEN reason IN (1, 2) THEN 'INFO' ELSE 'WARNING' END AS severity FROM m WHERE name0 <> mode_name
UNION ALL SELECT flight_id, timestamp_us, seq, CASE WHEN armed THEN 'ARM' ELSE 'DISARM' END, 'INFO' FROM m WHERE armed <> was
UNION ALL SELECT flight_id, timestamp_us, seq, 'ERROR', CASE WHEN ecode = 0 THEN 'INFO' WHEN subsys IN (6,7,8,16,17,24) THEN 'CRITICAL' ELSE 'WARNING' END FROM ERR
UNION ALL SELECT flight_id, timestamp_us, seq, 'GPS_FIX_DEGRADED', CASE WHEN fix_type < 2 THEN 'CRITICAL' ELSE 'WARNING' END FROM g WHERE fix_type < fix0
UNION ALL SELECT flight_id, timestamp_us, seq, 'GPS_SAT_DROP', 'CRITICAL' FROM g WHERE sats0 - num_sats >= 4
UNION ALL SELECT flight_id, timestamp_us, seq, 'GPS_HDOP_SPIKE', 'WARNING' FROM g WHERE hdop > 2.0 AND hdop0 <= 2.0
UNION ALL SELECT flight_id, timestamp_us, seq, 'CRASH_DETECTED', 'FATAL' FROM x WHERE rn = 1
UNION ALL SELECT flight_id, timestamp_us, seq, 'PARAM_CHANGE', 'INFO' FROM q WHERE timestamp_us > t0 + 10000000)"""
_EV_TABLES = ("MODE", "ERR", "GPS", "ATT", "PARM")


def event_horizon(spark, sf):
    return timeline.event_horizon(timeline.timeline(telemetry(spark, sf)).select("flight_id", "timestamp_us", "severity"))


_HORIZON = f"""{telemetry_sql(*_EV_TABLES)}, {_EVENTS},
f AS (SELECT flight_id, min(timestamp_us) FILTER (severity IN ('CRITICAL', 'FATAL')) AS first_critical_us FROM evt GROUP BY flight_id)
SELECT f.flight_id, first_critical_us, max(timestamp_us) FILTER (severity = 'INFO' AND timestamp_us < first_critical_us) AS event_horizon_us
FROM f JOIN evt USING (flight_id) GROUP BY f.flight_id, first_critical_us"""


def timeline_counts(spark, sf):
    return timeline.timeline_counts(timeline.timeline(telemetry(spark, sf)))


_COUNTS = f"""{telemetry_sql(*_EV_TABLES)}, {_EVENTS} SELECT flight_id, count(*) AS total_events, count(*) FILTER (severity = 'CRITICAL') AS critical_events,
count(*) FILTER (severity = 'FATAL') AS fatal_events, count(*) FILTER (severity = 'WARNING') AS warnings FROM evt GROUP BY flight_id"""


def phases(spark, sf):
    return timeline.phases(telemetry(spark, sf)).select("flight_id", "name", "start_us", "end_us", "mode_name")


_PHASE_CASE = "CASE mode_name " + " ".join(f"WHEN '{m}' THEN '{p}'" for m, p in timeline.MODE_PHASES.items()) + " ELSE 'HOVER' END"
_PHASES = f"""{telemetry_sql(*_EV_TABLES)}, {_EVENTS},
b AS (SELECT s.flight_id, t0, t1, arm, crash FROM (SELECT flight_id, min(timestamp_us) AS t0, max(timestamp_us) AS t1 FROM MODE GROUP BY flight_id) s
  LEFT JOIN (SELECT flight_id, min(timestamp_us) FILTER (event_type = 'ARM') AS arm, min(timestamp_us) FILTER (event_type = 'CRASH_DETECTED') AS crash
    FROM evt GROUP BY flight_id) USING (flight_id)),
s AS (SELECT flight_id, seq, timestamp_us AS start_us, coalesce(lead(timestamp_us) {_W}, crash, t1) AS end_us, mode_name, arm FROM MODE JOIN b USING (flight_id)),
a AS (SELECT s.flight_id, s.seq, max(alt_rel_m) - min(alt_rel_m) AS delta, avg(alt_rel_m) AS mean FROM s JOIN GPS g
  ON g.flight_id = s.flight_id AND g.timestamp_us BETWEEN start_us AND end_us GROUP BY s.flight_id, s.seq),
n AS (SELECT s.*, {_PHASE_CASE} AS base, delta, mean FROM s LEFT JOIN a USING (flight_id, seq) WHERE mode_name <> 'INITIALISING')
SELECT flight_id, CASE WHEN start_us >= arm AND base = 'HOVER' AND delta > 2.0 THEN 'TAKEOFF' WHEN start_us >= arm AND base = 'HOVER' AND mean < 0.5 THEN 'LANDING'
  ELSE base END AS name, start_us, end_us, mode_name FROM n
UNION ALL SELECT flight_id, 'PRE_ARM', t0, arm, 'PREFLIGHT' FROM b WHERE arm > t0
UNION ALL SELECT flight_id, 'CRASH', crash, crash + 5000000, 'CRASH' FROM b WHERE crash IS NOT NULL
UNION ALL SELECT flight_id, 'UNKNOWN', min(timestamp_us), max(timestamp_us), 'UNKNOWN' FROM ATT WHERE flight_id NOT IN (SELECT flight_id FROM MODE) GROUP BY flight_id"""


def flight_summary(spark, sf):
    t = telemetry(spark, sf)
    ev = timeline.timeline(t)
    return timeline.flight_summary(ev, timeline.phases(t, ev)).select(
        "flight_id", "phases", "key_events", "crash_timestamp_us", "arm_timestamp_us", "crash_detected", "event_horizon_us")


_SUMMARY = f"""WITH h AS ({_HORIZON}), p AS (SELECT flight_id, count(*) AS phases FROM ({_PHASES}) GROUP BY flight_id),
e AS (SELECT flight_id, count(*) FILTER (severity <> 'INFO') AS key_events, min(timestamp_us) FILTER (event_type = 'CRASH_DETECTED') AS crash_timestamp_us,
  min(timestamp_us) FILTER (event_type = 'ARM') AS arm_timestamp_us FROM ({telemetry_sql(*_EV_TABLES)}, {_EVENTS} SELECT * FROM evt) GROUP BY flight_id)
SELECT flight_id, coalesce(phases, 0) AS phases, coalesce(key_events, 0) AS key_events, crash_timestamp_us, arm_timestamp_us,
  crash_timestamp_us IS NOT NULL AS crash_detected, event_horizon_us FROM e FULL JOIN p USING (flight_id) LEFT JOIN h USING (flight_id)"""


def _round_all(df, *keep):
    return df.select(*[F.col(c) if c in keep or dict(df.dtypes)[c] != "double" else rounded(c).alias(c) for c in df.columns])


def gps_metrics(spark, sf):
    return _round_all(metrics.gps_metrics(telemetry(spark, sf)))


def power_metrics(spark, sf):
    return _round_all(metrics.power_metrics(telemetry(spark, sf)))


def filter_metrics(spark, sf):
    return _round_all(metrics.filter_metrics(telemetry(spark, sf)))


def feature_vector(spark, sf):
    v = metrics.feature_vector(telemetry(spark, sf))
    return v.select("flight_id", F.explode("metrics").alias("metric", "v")).select("flight_id", "metric", rounded("v").alias("value"))


def parameter_drift(spark, sf):
    return _project(compliance.parameter_drift(telemetry(spark, sf)), "value")


_RANGES = ", ".join(f"('{n}', {lo}, {hi}, {n in compliance.CRITICAL_PARAMETERS})" for n, (lo, hi) in compliance.PARAMETER_RANGES.items())
_DRIFT = f""", q AS (SELECT *, min(timestamp_us) OVER (PARTITION BY flight_id) AS t0 FROM PARM),
l AS (SELECT flight_id, t0, name, arg_max(value, timestamp_us * 1000000000 + seq) AS value FROM q WHERE timestamp_us <= t0 + 30000000 GROUP BY flight_id, t0, name),
r(name, lo, hi, crit) AS (VALUES {_RANGES})
SELECT flight_id, {_point("CASE WHEN crit THEN 'CRITICAL' ELSE 'WARNING' END", "value", "name", "t0")} FROM l JOIN r USING (name) WHERE value NOT BETWEEN lo AND hi"""


def parameter_missing(spark, sf):
    values = compliance.initial_parameters(telemetry(spark, sf))
    out = compliance.range_violations(values, values.select("flight_id").distinct())
    return out.select("flight_id", "param", "issue", "severity", rounded("actual").alias("actual"))


_MISSING = f""", q AS (SELECT *, min(timestamp_us) OVER (PARTITION BY flight_id) AS t0 FROM PARM),
l AS (SELECT flight_id, name, arg_max(value, timestamp_us * 1000000000 + seq) AS value FROM q WHERE timestamp_us <= t0 + 30000000 GROUP BY flight_id, name),
r(name, lo, hi, crit) AS (VALUES {_RANGES})
SELECT f.flight_id, r.name AS param, CASE WHEN value IS NULL THEN 'MISSING' ELSE 'OUT_OF_RANGE' END AS issue,
  CASE WHEN value IS NULL THEN 'INFO' WHEN crit THEN 'CRITICAL' ELSE 'WARNING' END AS severity, round(value, 8) AS actual
FROM (SELECT DISTINCT flight_id FROM l) f CROSS JOIN r LEFT JOIN l ON l.flight_id = f.flight_id AND l.name = r.name WHERE value IS NULL OR value NOT BETWEEN lo AND hi"""


def safety_audit(spark, sf):
    return compliance.safety_audit(telemetry(spark, sf)).select("flight_id", "parameter", "result", rounded("actual").alias("actual"))


_CHECKS = ", ".join(f"('{p}', {'NULL' if r is None else r}, '{k}')" for p, r, k, _ in compliance.SAFETY_CHECKS)
_AUDIT = f""", l AS (SELECT flight_id, name, arg_max(value, timestamp_us * 1000000000 + seq) AS value FROM PARM GROUP BY flight_id, name),
c(parameter, required, kind) AS (VALUES {_CHECKS})
SELECT f.flight_id, c.parameter, CASE WHEN value IS NULL THEN 'warning' WHEN CASE kind WHEN 'nonzero' THEN value <> 0 WHEN 'eq' THEN value = required
  WHEN 'lte' THEN value <= required WHEN 'gte' THEN value >= required ELSE true END THEN 'compliant' ELSE 'violation' END AS result, round(value, 8) AS actual
FROM (SELECT DISTINCT flight_id FROM l) f CROSS JOIN c LEFT JOIN l ON l.flight_id = f.flight_id AND l.name = c.parameter"""


def profile_deviation(spark, sf):
    d = compliance.profile_deviation(compliance.initial_parameters(telemetry(spark, sf)), "ardupilot_quad")
    return d.select("flight_id", "name", rounded("value").alias("value"), "expected", "severity")


_BASE = ", ".join(f"('{n}', {e}, {w}, {k})" for n, (e, w, k) in compliance.PROFILE_BASELINES["ardupilot_quad"].items())
_PROFILE = f""", q AS (SELECT *, min(timestamp_us) OVER (PARTITION BY flight_id) AS t0 FROM PARM),
l AS (SELECT flight_id, name, arg_max(value, timestamp_us * 1000000000 + seq) AS value FROM q WHERE timestamp_us <= t0 + 30000000 GROUP BY flight_id, name),
b(name, expected, warn, crit) AS (VALUES {_BASE})
SELECT flight_id, name, round(value, 8) AS value, CAST(expected AS DOUBLE) AS expected, CASE WHEN abs(value - expected) > crit THEN 'CRITICAL' ELSE 'WARNING' END AS severity
FROM l JOIN b USING (name) WHERE abs(value - expected) > least(warn, crit)"""


def data_gaps(spark, sf):
    t = telemetry(spark, sf)
    return compliance.data_gaps(t, t.table("GPS")).select("flight_id", "has_esc_telemetry", "has_parameters", "esc_confidence", "parameter_confidence")


def command_counts(spark, sf):
    return metrics.command_counts(telemetry(spark, sf))


def standard_zscore(spark, sf):
    z = standard_channel_checks(telemetry(spark, sf))
    return z.select("flight_id", "timestamp_us", "field", "value", rounded("z_score", 5).alias("z_score"), "severity")


def _zscore_sql(table, field, thr):
    w = STANDARD_WINDOW
    frame = f"OVER (PARTITION BY flight_id ORDER BY timestamp_us, seq ROWS BETWEEN {w // 2} PRECEDING AND {w // 2 - 1} FOLLOWING)"
    return f"""SELECT flight_id, timestamp_us, '{table}.{field}' AS field, {field} AS value, round(z, 5) AS z_score,
  CASE WHEN z >= {1.5 * thr} THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM (SELECT *, coalesce(lag(z) {_W} > {thr}, false) AS was FROM
  (SELECT *, abs({field} - m) / greatest(sqrt(sum(({field} - m) * ({field} - m)) {frame} / {w}), 1e-10) AS z FROM
  (SELECT *, sum({field}) {frame} / {w} AS m, count(*) OVER (PARTITION BY flight_id) AS n_all FROM {table}) WHERE n_all >= {w}))
  WHERE z > {thr} AND NOT was"""


_STANDARD = telemetry_sql("GPS", "BAT", "NKF4", "ATT") + " " + " UNION ALL ".join(_zscore_sql(*c) for c in STANDARD_CHANNELS)

_GPS_SQL = """ SELECT flight_id, round(avg(hdop), 8) AS hdop_mean, round(max(hdop), 8) AS hdop_max, round(min(hdop), 8) AS hdop_min, min(num_sats) AS sat_count_min,
round(avg(num_sats), 8) AS sat_count_mean, min(fix_type) AS fix_type_min, round(max(speed_acc_m_s), 8) AS speed_acc_max FROM GPS GROUP BY flight_id"""
_POWER_SQL = """ SELECT flight_id, round(min(voltage_v), 8) AS voltage_min, round(max(voltage_v), 8) AS voltage_max, round(avg(voltage_v), 8) AS voltage_mean,
round(max(current_a), 8) AS current_max, round(avg(current_a), 8) AS current_mean, round(min(remaining_pct), 8) AS remaining_min_pct,
round(max(consumed_mah), 8) AS consumed_mah_total FROM BAT GROUP BY flight_id"""
_FILTER_SQL = f""", l AS (SELECT *, abs(lane - lag(lane) {_W}) AS dl FROM NKF4), a AS (SELECT flight_id, round(max(var_ratio_vel), 8) AS max_vel_ivr,
round(avg(var_ratio_vel), 8) AS mean_vel_ivr, round(max(var_ratio_pos), 8) AS max_pos_ivr, round(max(var_ratio_hgt), 8) AS max_hgt_ivr,
coalesce(sum(dl), 0) AS lane_switches FROM l GROUP BY flight_id), h AS (SELECT flight_id, round(max(abs(innov_heading)), 8) AS max_heading_innov_rad FROM NKF3 GROUP BY flight_id)
SELECT flight_id, max_vel_ivr, mean_vel_ivr, max_pos_ivr, max_hgt_ivr, coalesce(lane_switches, 0) AS lane_switches, max_heading_innov_rad FROM a FULL JOIN h USING (flight_id)"""
_VECTOR_SQL = """ SELECT flight_id, 'battery_voltage_min' AS metric, round(min(voltage_v), 8) AS value FROM BAT GROUP BY flight_id
UNION ALL SELECT flight_id, 'current_max_a', round(max(current_a), 8) FROM BAT GROUP BY flight_id
UNION ALL SELECT flight_id, 'gps_hdop_max', round(max(hdop), 8) FROM GPS GROUP BY flight_id
UNION ALL SELECT flight_id, 'ekf_var_ratio_max', round(max(var_ratio_vel), 8) FROM NKF4 GROUP BY flight_id"""

QUERIES = [
    *_GROUPED, *_ROWS,
    Query("att_extreme_roll", att_extreme_roll, telemetry_sql("ATT") + _ROLL),
    Query("all_rules", all_rules, _ALL),
    Query("timeline", timeline_events, f"{telemetry_sql(*_EV_TABLES)}, {_EVENTS} SELECT * FROM evt"),
    Query("event_horizon", event_horizon, _HORIZON),
    Query("timeline_counts", timeline_counts, _COUNTS),
    Query("phases", phases, _PHASES),
    Query("flight_summary", flight_summary, _SUMMARY),
    Query("gps_metrics", gps_metrics, telemetry_sql("GPS") + _GPS_SQL),
    Query("power_metrics", power_metrics, telemetry_sql("BAT") + _POWER_SQL),
    Query("filter_metrics", filter_metrics, telemetry_sql("NKF4", "NKF3") + _FILTER_SQL),
    Query("feature_vector", feature_vector, telemetry_sql("BAT", "GPS", "NKF4") + _VECTOR_SQL),
    Query("parameter_drift", parameter_drift, telemetry_sql("PARM") + _DRIFT),
    Query("param_range_check", parameter_missing, telemetry_sql("PARM") + _MISSING),
    Query("safety_audit", safety_audit, telemetry_sql("PARM") + _AUDIT),
    Query("profile_deviation", profile_deviation, telemetry_sql("PARM") + _PROFILE),
    Query("data_gaps", data_gaps, telemetry_sql("GPS", "PARM", "ESC") + """ SELECT DISTINCT flight_id, flight_id IN (SELECT flight_id FROM ESC) AS has_esc_telemetry,
flight_id IN (SELECT flight_id FROM PARM) AS has_parameters, CASE WHEN flight_id IN (SELECT flight_id FROM ESC) THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END AS esc_confidence,
CASE WHEN flight_id IN (SELECT flight_id FROM PARM) THEN 0.85::DOUBLE ELSE 0.2::DOUBLE END AS parameter_confidence FROM GPS"""),
    Query("command_counts", command_counts, telemetry_sql("CMD") + " SELECT flight_id, count(*) AS cmd_count FROM CMD GROUP BY flight_id"),
    Query("standard_zscore", standard_zscore, _STANDARD),
]
