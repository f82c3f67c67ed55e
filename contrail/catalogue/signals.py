"""Queries on spectra, lags, shifts and outliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.catalogue.base import EV, ORDER, USER, Query, event_series, events, load, micros, rounded, telemetry, telemetry_sql
from contrail.operators import segments, spectrum, stats
from contrail.operators.series import exact_quantile

PRIO, DAY_ORDER = ["o_orderpriority"], ["day_us", "seq"]


def daily_orders(spark, sf):
    """Order value per day and priority."""
    o = load(spark, sf, "orders").select("o_orderpriority", micros("o_orderdate").alias("day_us"), "o_totalprice")
    return o.groupBy("o_orderpriority", "day_us").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).withColumn("seq", F.lit(0))


_DAILY = """d AS (SELECT o_orderpriority, epoch_us(o_orderdate) AS day_us, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2)"""


def welch_psd(spark, sf):
    w = spectrum.welch(daily_orders(spark, sf), PRIO, DAY_ORDER, {"total": "total"})
    return w.select("o_orderpriority", F.col("bin").cast("long").alias("bin"), rounded("hz").alias("hz"), F.round("psd_db", 5).alias("psd_db"))


def _welch_sql(src, key, ts, value, max_seg, fs):
    """CTEs up to ``psd``: (key, bin, hz, psd, fs)."""
    return f"""n AS (SELECT {key}, {ts} AS ts, {value} AS v, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY {key}) AS n, {ts} - lag({ts}) OVER w AS dt
  FROM {src} WINDOW w AS (PARTITION BY {key} ORDER BY {ts}, seq)),
f AS (SELECT {key}, {fs} AS fs FROM n GROUP BY 1),
s AS (SELECT n.*, fs, least({max_seg}, n // 4) AS s, least({max_seg}, n // 4) - least({max_seg}, n // 4) // 2 AS hop FROM n JOIN f USING ({key})),
g AS (SELECT {key}, fs, s, k, p - k * hop AS i, v FROM (SELECT *, unnest(range(0, (n - s) // hop + 1)) AS k FROM s WHERE s >= 16)
  WHERE p BETWEEN k * hop AND k * hop + s - 1),
x AS (SELECT *, (v - avg(v) OVER (PARTITION BY {key}, k)) * (0.5 - 0.5 * cos(2 * pi() * i / s)) AS x, pow(0.5 - 0.5 * cos(2 * pi() * i / s), 2) AS w2 FROM g),
b AS (SELECT {key}, fs, s, k, bin, pow(sum(x * cos(2 * pi() * ((bin * i) % s) / s)), 2) + pow(sum(x * sin(2 * pi() * ((bin * i) % s) / s)), 2) AS pw, sum(w2) AS w2
  FROM (SELECT *, unnest(range(0, s // 2 + 1)) AS bin FROM x) GROUP BY ALL),
psd AS (SELECT {key}, bin, bin * fs / s AS hz, avg(pw / (fs * w2) * CASE WHEN bin = 0 OR (s % 2 = 0 AND bin = s // 2) THEN 1 ELSE 2 END) AS psd, fs
  FROM b GROUP BY {key}, bin, fs, s)"""


_ORDERS_PSD = _welch_sql("(SELECT *, 0 AS seq FROM d)", "o_orderpriority", "day_us", "total", 512, "least(greatest(1e6 / median(dt), 50.0), 2000.0)")
_WELCH = f"""WITH {_DAILY}, {_ORDERS_PSD}
SELECT o_orderpriority, bin, round(hz, 8) AS hz, round(10 * log10(greatest(psd, 1e-20)), 5) AS psd_db FROM psd"""


def spectral_peaks(spark, sf):
    w = spectrum.welch(daily_orders(spark, sf), PRIO, DAY_ORDER, {"total": "total"})
    p = spectrum.label_peaks(spectrum.spectral_peaks(w, PRIO, 1.0, 500.0, 3.0, 0.1), PRIO)
    return p.select("o_orderpriority", "rank", rounded("hz").alias("hz"), F.round("db", 5).alias("db"), rounded("motor_hz").alias("motor_hz"), "harmonic_order")


# spacing is one bin here, so every local maximum is a candidate
_PEAKS = f"""WITH {_DAILY}, {_ORDERS_PSD}, q AS (SELECT *, 10 * log10(greatest(psd, 1e-20)) AS db FROM psd WHERE hz BETWEEN 1.0 AND least(fs / 2, 500.0)),
m AS (SELECT *, lag(db) OVER w AS l, lead(db) OVER w AS r FROM q WINDOW w AS (PARTITION BY o_orderpriority ORDER BY bin)),
c AS (SELECT * FROM m WHERE db > l AND db > r),
e AS (SELECT c.o_orderpriority, c.bin, any_value(c.hz) AS hz, any_value(c.db) AS db, max(q.bin) FILTER (q.bin < c.bin AND q.db > c.db) AS lb, min(q.bin) FILTER (q.bin > c.bin AND q.db > c.db) AS rb
  FROM c JOIN q USING (o_orderpriority) GROUP BY 1, 2),
p AS (SELECT e.o_orderpriority, e.bin, any_value(e.hz) AS hz, any_value(e.db) AS db,
  greatest(min(q.db) FILTER (q.bin <= e.bin AND q.bin > coalesce(lb, -1)), min(q.db) FILTER (q.bin >= e.bin AND q.bin < coalesce(rb, 1000000))) AS base
  FROM e JOIN q USING (o_orderpriority) GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY db DESC) AS rank FROM p WHERE db - base >= 3.0),
h AS (SELECT *, arg_min(hz, rank) FILTER (hz BETWEEN 20 AND 200) OVER (PARTITION BY o_orderpriority) AS motor FROM k)
SELECT o_orderpriority, rank, round(hz, 8) AS hz, round(db, 5) AS db, round(motor, 8) AS motor_hz,
  list_min(list_filter(range(1, 8), lambda n: abs(hz - motor * n) < motor * 0.05)) AS harmonic_order FROM h"""


def vibration_report(spark, sf):
    t = telemetry(spark, sf, "type")
    axes = {"X": "acc_x_m_s2", "Y": "acc_y_m_s2", "Z": "acc_z_m_s2"}
    r = spectrum.vibration_report(t.table("IMU"), ["flight_id"], ["timestamp_us", "seq"], axes, t.table("VIBE"))
    return r.select("flight_id", *[rounded(f"rms_{a}", 6).alias(f"rms_{a}") for a in "xyz"], "overall_severity", "clips_x", "clips_y", "clips_z")


_VIB = f"""WITH {EV}, g AS (SELECT event_type AS flight_id, round(stddev_pop(value / 5), 6) AS rms_x, round(stddev_pop(k / 1e1), 6) AS rms_y,
  round(stddev_pop(981e-2 + value / 50), 6) AS rms_z, sum(k * k) AS clips_x, sum(k * 3) AS clips_y, 0 AS clips_z FROM ev GROUP BY 1)
SELECT flight_id, rms_x, rms_y, rms_z, CASE WHEN greatest(rms_x, rms_y, rms_z) < 5 THEN 'GOOD' WHEN greatest(rms_x, rms_y, rms_z) < 15 THEN 'ACCEPTABLE'
  WHEN greatest(rms_x, rms_y, rms_z) < 30 THEN 'WARNING' ELSE 'CRITICAL' END AS overall_severity, clips_x, clips_y, clips_z FROM g"""


def control_oscillation(spark, sf):
    o = spectrum.control_oscillation(telemetry(spark, sf, "type").table("ATT"), ["flight_id"], ["timestamp_us", "seq"])
    return o.select("flight_id", "timestamp_us", F.round("osc_power", 6).alias("osc_power"))


_OSC = f"""{telemetry_sql('ATT', by='type')}, {_welch_sql('ATT', 'flight_id', 'timestamp_us', 'roll_deg', 256, '1e6 / median(dt)')},
top AS (SELECT flight_id, max(psd) FILTER (hz BETWEEN 2.0 AND 10.0) AS osc, quantile_cont(psd, 0.9) AS p90 FROM psd GROUP BY 1),
c AS (SELECT flight_id, min(timestamp_us) AS timestamp_us FROM ATT GROUP BY 1 HAVING count(*) > 100)
SELECT flight_id, timestamp_us, round(osc, 6) AS osc_power FROM top JOIN c USING (flight_id) WHERE osc > p90"""


def xcorr_lag(spark, sf):
    o = load(spark, sf, "orders").groupBy(micros("o_orderdate").alias("day_us")).agg(F.round(F.sum("o_totalprice"), 2).alias("a"))
    s = load(spark, sf, "lineitem").groupBy(micros("l_shipdate").alias("day_us")).agg(F.round(F.sum("l_extendedprice"), 2).alias("b"))
    pairs = o.join(s, "day_us").withColumns({"series": F.lit("daily"), "seq": F.lit(0)})
    r = stats.cross_correlation_lag(pairs, ["series"], DAY_ORDER, "a", "b", 60, 1 / 86400.0)
    return r.select("lag_samples", F.round("lag_seconds", 3).alias("lag_seconds"), rounded("peak_correlation").alias("peak_correlation"), "is_significant")


_XCORR = """WITH o AS (SELECT o_orderdate AS d, round(sum(o_totalprice), 2) AS a FROM orders GROUP BY 1), s AS (SELECT l_shipdate AS d, round(sum(l_extendedprice), 2) AS b FROM lineitem GROUP BY 1),
j AS (SELECT row_number() OVER (ORDER BY d) AS i, a, b FROM o JOIN s USING (d)),
z AS (SELECT i, (a - avg(a) OVER ()) / (stddev_pop(a) OVER () + 1e-10) AS a, (b - avg(b) OVER ()) / (stddev_pop(b) OVER () + 1e-10) AS b, count(*) OVER () AS n FROM j),
l AS (SELECT x.i - y.i AS lag, sum(x.a * y.b) / any_value(x.n) AS c FROM z x JOIN z y ON x.i - y.i BETWEEN -60 AND 60 GROUP BY 1)
SELECT lag AS lag_samples, round(lag / (1 / 86400.0::DOUBLE), 3) AS lag_seconds, round(c, 8) AS peak_correlation, c > 0.5 AS is_significant FROM l ORDER BY c DESC, lag LIMIT 1"""


def changepoints(spark, sf):
    c = stats.change_points(event_series(spark, sf), "value", 10, 5.0)
    return c.select("user_id", "ts_us", "event_id", rounded("score", 5).alias("score"))


_W = "PARTITION BY user_id ORDER BY ts_us, event_id ROWS BETWEEN"
_CHANGE = f"""WITH {EV}, a AS (SELECT *, count(*) OVER u AS n_all, avg(value) OVER u AS mu, stddev_pop(value) OVER u AS sd FROM ev WINDOW u AS (PARTITION BY user_id)),
z AS (SELECT *, (value - mu) / sd AS z FROM a WHERE n_all >= 20 AND sd >= 1e-10),
s AS (SELECT *, CASE WHEN count(z) OVER ({_W} 9 PRECEDING AND CURRENT ROW) = 10 AND count(z) OVER ({_W} 1 FOLLOWING AND 10 FOLLOWING) = 10 THEN
  20 * ln(greatest(var_pop(z) OVER ({_W} 9 PRECEDING AND 10 FOLLOWING), 1e-3)) - 10 * ln(greatest(var_pop(z) OVER ({_W} 9 PRECEDING AND CURRENT ROW), 1e-3))
  - 10 * ln(greatest(var_pop(z) OVER ({_W} 1 FOLLOWING AND 10 FOLLOWING), 1e-3)) END AS score FROM z),
p AS (SELECT *, max(score) OVER ({_W} 10 PRECEDING AND 10 FOLLOWING) AS top, coalesce(max(score) OVER ({_W} 10 PRECEDING AND 1 PRECEDING), -1e300) AS earlier FROM s)
SELECT user_id, ts_us, event_id, round(score, 5) AS score FROM p WHERE score = top AND score > earlier AND score > 10.0"""


def penalised_breaks(spark, sf):
    b = segments.penalised_breaks(event_series(spark, sf), "value", 10, 1.0)
    return b.select("user_id", "position", "ts_us", "event_id")


def isolation_scores(spark, sf):
    df = load(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    s = stats.isolation_scores(df, ["l_returnflag"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"])
    return s.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", rounded("score").alias("score"))


def isolation_profile(spark, sf):
    """What holds for any forest: every complete row has a score from -1 to 0, and the cut-off leaves its share below."""
    s = isolation_scores(spark, sf).checkpoint()
    cut = exact_quantile(s, ["l_returnflag"], "score", 0.05).withColumnRenamed("score", "cut")
    rows = s.join(F.broadcast(cut), "l_returnflag").groupBy("l_returnflag")  # three keys
    return rows.agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.col("score").between(-1, 0)).alias("in_range"),
                    F.round(F.avg((F.col("score") < F.col("cut")).cast("double")), 2).alias("share_below"))


_ISOLATION = """SELECT l_returnflag, count(*) AS n, true AS in_range, 0.05::DOUBLE AS share_below FROM lineitem
WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL GROUP BY 1 HAVING count(*) >= 20"""


def isolation_anomalies(spark, sf):
    a = stats.isolation_anomalies(events(spark, sf), ["event_type"], ["value", "k"], ORDER)
    return a.select("event_type", F.col("start").alias("start_us"), F.col("end").alias("end_us"), F.col("middle").alias("middle_us"), "n", rounded("value").alias("worst"),
                    rounded(F.col("features")["value"]).alias("first_value"), F.col("features")["k"].alias("first_k"), "severity")


def axis_levels(spark, sf):
    a = spectrum.axis_levels(events(spark, sf).withColumn("k", F.col("k").cast("double")), USER, {"X": "value", "Y": "k"})
    return a.select("user_id", "axis", rounded("rms").alias("rms"), "severity")


_LEVELS = f"""WITH {EV}, g AS (SELECT user_id, count(*) AS n, stddev_pop(value) AS x, stddev_pop(k) AS y FROM ev GROUP BY 1),
l AS (SELECT user_id, 'X' AS axis, CASE WHEN n >= 64 THEN x ELSE 0 END AS r FROM g UNION ALL SELECT user_id, 'Y', CASE WHEN n >= 64 THEN y ELSE 0 END FROM g)
SELECT user_id, axis, round(r, 8) AS rms, CASE WHEN r < 5 THEN 'GOOD' WHEN r < 15 THEN 'ACCEPTABLE' WHEN r < 30 THEN 'WARNING' ELSE 'CRITICAL' END AS severity FROM l"""

QUERIES = [
    Query("welch_psd", welch_psd, _WELCH),
    Query("spectral_peaks", spectral_peaks, _PEAKS),
    Query("vibration_report", vibration_report, _VIB),
    Query("control_oscillation", control_oscillation, _OSC),
    Query("axis_levels", axis_levels, _LEVELS),
    Query("xcorr_lag", xcorr_lag, _XCORR),
    Query("changepoints", changepoints, _CHANGE),
    Query("penalised_breaks", penalised_breaks),
    Query("isolation_scores", isolation_scores),
    Query("isolation_anomalies", isolation_anomalies),
    Query("isolation_profile", isolation_profile, _ISOLATION),
]
