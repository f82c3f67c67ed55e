"""Queries that join series along time."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.catalogue.base import EV, HOUR, ORDER, USER, Query, event_series, events, load, rounded
from contrail.functions.geometry import haversine_m, quaternion_to_euler
from contrail.operators import align
from contrail.operators.runs import first_rows
from contrail.plans.timeline import segment_stats
from contrail.session import broadcast_if_small

_T = {"keys": USER, "ts": "ts_us", "seq": "event_id"}


def _of(spark, sf, kind):
    return events(spark, sf).where(F.col("event_type") == kind)


def nearest_join(spark, sf):
    views = _of(spark, sf, "view")
    j = align.nearest_join(_of(spark, sf, "click"), {"view": (views, ["event_id", "value"])}, tolerance=12 * HOUR, **_T)
    return j.select("user_id", "event_id", "ts_us", "view_event_id", "view_value")


_NEAREST = f"""WITH {EV}, c AS (SELECT * FROM ev WHERE event_type = 'click'), v AS (SELECT * FROM ev WHERE event_type = 'view'),
j AS (SELECT c.user_id, c.event_id, c.ts_us, v.event_id AS view_event_id, v.value AS view_value,
  row_number() OVER (PARTITION BY c.event_id ORDER BY abs(v.ts_us - c.ts_us), v.ts_us) AS r
  FROM c LEFT JOIN v ON v.user_id = c.user_id AND abs(v.ts_us - c.ts_us) <= {12 * HOUR})
SELECT user_id, event_id, ts_us, view_event_id, view_value FROM j WHERE r = 1"""


def interp_join(spark, sf):
    j = align.interpolated_join(_of(spark, sf, "click"), _of(spark, sf, "view"), ["value"], prefix="view_", **_T)
    return j.select("user_id", "event_id", "ts_us", rounded("view_value").alias("view_value"))


_INTERP = f"""WITH {EV}, c AS (SELECT * FROM ev WHERE event_type = 'click'), v AS (SELECT * FROM ev WHERE event_type = 'view'),
b AS (SELECT c.user_id, c.event_id, c.ts_us, max(v.ts_us) FILTER (v.ts_us <= c.ts_us) AS t0, min(v.ts_us) FILTER (v.ts_us > c.ts_us) AS t1,
  arg_max(v.value, v.ts_us) FILTER (v.ts_us <= c.ts_us) AS v0, arg_min(v.value, v.ts_us) FILTER (v.ts_us > c.ts_us) AS v1
  FROM c LEFT JOIN v ON v.user_id = c.user_id GROUP BY ALL)
SELECT user_id, event_id, ts_us, round(CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = ts_us THEN v0
  ELSE v0 + (ts_us - t0) / (t1 - t0) * (v1 - v0) END, 8) AS view_value FROM b"""


def response_window(spark, sf):
    err, buy = _of(spark, sf, "error"), _of(spark, sf, "purchase")
    good = buy.where("value > 50")
    n = align.count_following(err.select("user_id", "ts_us", "event_id"), buy, within=6 * HOUR, name="n_responses", **_T)
    f = align.following_join(n, {"any": (buy, ["event_id"]), "good": (good, ["event_id"])}, within=6 * HOUR, **_T)
    verdict = F.when(F.col("any").isNull(), "CRITICAL").when(F.col("good").isNull(), "WARNING").otherwise("OK")
    return f.select("user_id", "event_id", "ts_us", "n_responses", F.col("any.event_id").alias("first_response"), verdict.alias("verdict"))


_RESPONSE = f"""WITH {EV}, e AS (SELECT * FROM ev WHERE event_type = 'error'), p AS (SELECT * FROM ev WHERE event_type = 'purchase')
SELECT e.user_id, e.event_id, e.ts_us, count(p.event_id) AS n_responses, arg_min(p.event_id, p.ts_us) AS first_response,
  CASE WHEN count(p.event_id) = 0 THEN 'CRITICAL' WHEN count(*) FILTER (p.value > 50) = 0 THEN 'WARNING' ELSE 'OK' END AS verdict
FROM e LEFT JOIN p ON p.user_id = e.user_id AND p.ts_us BETWEEN e.ts_us AND e.ts_us + {6 * HOUR} GROUP BY e.user_id, e.event_id, e.ts_us"""


def phase_stats(spark, sf):
    s = event_series(spark, sf).shift({"before": "event_type"})
    starts = s.with_df(s.df.where("before is null or before <> event_type")).shift(nxt={"end_us": "ts_us"})
    seg = starts.df.where("end_us is not null").select("user_id", F.col("ts_us").alias("start_us"), "end_us")
    rows = events(spark, sf).select("user_id", "ts_us", "event_id", "value")
    aggs = {"n": F.count(F.lit(1)), "v_min": F.min("value"), "v_max": F.max("value"), "v_mean": rounded(F.avg("value"))}
    return segment_stats(rows, seg, aggs, USER, "ts_us", "event_id")


_PHASES = f"""WITH {EV}, p AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS before FROM ev),
s AS (SELECT user_id, ts_us AS start_us, lead(ts_us) OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS end_us FROM p
  WHERE before IS NULL OR before <> event_type)
SELECT s.user_id, start_us, end_us, count(*) AS n, min(value) AS v_min, max(value) AS v_max, round(avg(value), 8) AS v_mean
FROM s JOIN ev ON ev.user_id = s.user_id AND ev.ts_us BETWEEN start_us AND end_us WHERE end_us IS NOT NULL GROUP BY s.user_id, start_us, end_us"""


def first_n_after(spark, sf):
    first = _of(spark, sf, "error").groupBy("user_id").agg(F.min("ts_us").alias("start_us"))
    after = events(spark, sf).join(broadcast_if_small(first), "user_id").where("ts_us >= start_us")
    g = first_rows(after, ["user_id", "start_us"], ORDER, 10).groupBy("user_id", "start_us")
    return g.agg(F.count(F.lit(1)).alias("n"), F.min_by("value", F.struct(*ORDER)).alias("initial"), F.min("value").alias("lowest"))


_FIRST_N = f"""WITH {EV}, f AS (SELECT user_id, min(ts_us) AS start_us FROM ev WHERE event_type = 'error' GROUP BY user_id),
r AS (SELECT ev.*, start_us, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS rn FROM ev JOIN f USING (user_id) WHERE ts_us >= start_us)
SELECT user_id, start_us, count(*) AS n, arg_min(value, ts_us) AS initial, min(value) AS lowest FROM r WHERE rn <= 10 GROUP BY user_id, start_us"""


def band_min(spark, sf):
    arm = _of(spark, sf, "signup").groupBy("user_id").agg(F.min("ts_us").alias("arm_us"))
    near = events(spark, sf).join(broadcast_if_small(arm), "user_id").where(
        F.col("ts_us").between(F.col("arm_us") - 24 * HOUR, F.col("arm_us") + 12 * HOUR))
    return near.groupBy("user_id", "arm_us").agg(F.min("value").alias("lowest"), F.count(F.lit(1)).alias("n"))


_BAND = f"""WITH {EV}, a AS (SELECT user_id, min(ts_us) AS arm_us FROM ev WHERE event_type = 'signup' GROUP BY user_id)
SELECT user_id, arm_us, min(value) AS lowest, count(*) AS n FROM ev JOIN a USING (user_id)
WHERE ts_us BETWEEN arm_us - {24 * HOUR} AND arm_us + {12 * HOUR} GROUP BY user_id, arm_us"""


def source_fallback(spark, sf):
    first = _of(spark, sf, "purchase").where("value > 150")
    return align.fallback_source(first, _of(spark, sf, "view"), "user_id").select("user_id", "event_id", "event_type", "value")


_FALLBACK = f"""WITH {EV}, p AS (SELECT * FROM ev WHERE event_type = 'purchase' AND value > 150)
SELECT user_id, event_id, event_type, value FROM p UNION ALL
SELECT user_id, event_id, event_type, value FROM ev WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM p)"""


def sensor_disagreement(spark, sf):
    d = align.sensor_disagreement(_of(spark, sf, "click"), _of(spark, sf, "view"), "value", USER, "ts_us")
    return d.select("user_id", rounded("rmse", 6).alias("rmse"), rounded("max_diff", 6).alias("max_diff"),
                    rounded("mean_bias", 6).alias("mean_bias"), "n_samples")


def _carry(kind):
    return f"""{kind}b AS (SELECT t.user_id, t.ts_us, max(s.ts_us) FILTER (s.ts_us <= t.ts_us) AS t0, min(s.ts_us) FILTER (s.ts_us > t.ts_us) AS t1,
  arg_max(s.value, s.ts_us) FILTER (s.ts_us <= t.ts_us) AS v0, arg_min(s.value, s.ts_us) FILTER (s.ts_us > t.ts_us) AS v1
  FROM grid t JOIN ev s ON s.user_id = t.user_id AND s.event_type = '{kind}' GROUP BY t.user_id, t.ts_us),
{kind}i AS (SELECT user_id, ts_us, CASE WHEN t0 IS NULL THEN v1 WHEN t1 IS NULL OR t0 = ts_us THEN v0
  ELSE v0 + (ts_us - t0) / (t1 - t0) * (v1 - v0) END AS v FROM {kind}b)"""


_DISAGREE = f"""WITH {EV}, b AS (SELECT user_id, greatest(min(ts_us) FILTER (event_type = 'click'), min(ts_us) FILTER (event_type = 'view')) AS lo,
  least(max(ts_us) FILTER (event_type = 'click'), max(ts_us) FILTER (event_type = 'view')) AS hi FROM ev GROUP BY user_id
  HAVING count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type = 'view') > 0),
grid AS (SELECT DISTINCT user_id, ts_us FROM ev JOIN b USING (user_id) WHERE event_type IN ('click', 'view') AND ts_us BETWEEN lo AND hi),
{_carry('click')}, {_carry('view')},
d AS (SELECT user_id, c.v - w.v AS d FROM clicki c JOIN viewi w USING (user_id, ts_us)),
g AS (SELECT user_id, sqrt(avg(d * d)) AS rmse, max(abs(d)) AS mx, avg(d) AS mb, count(*) AS n FROM d GROUP BY user_id)
SELECT b.user_id, CASE WHEN n >= 10 THEN round(rmse, 6) END AS rmse, CASE WHEN n >= 10 THEN round(mx, 6) END AS max_diff,
  CASE WHEN n >= 10 THEN round(mb, 6) END AS mean_bias, coalesce(n, 0) AS n_samples FROM b LEFT JOIN g USING (user_id)"""


def code_lookup(spark, sf):
    nation, region = load(spark, sf, "nation"), load(spark, sf, "region")
    j = load(spark, sf, "customer").join(broadcast_if_small(nation), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    j = j.join(broadcast_if_small(region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    name = F.coalesce("n_name", F.concat(F.lit("UNKNOWN_"), F.col("c_nationkey").cast("string")))
    return j.select("c_custkey", name.alias("nation"), F.coalesce("r_name", F.lit("UNKNOWN")).alias("region"))


def great_circle(spark, sf):
    s = event_series(spark, sf).with_columns({"lat": F.col("k") - 50.0, "lng": F.col("value") / 2}).shift({"lat0": "lat", "lng0": "lng"})
    d = haversine_m(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng"))
    return s.df.where("lat0 is not null").select("user_id", "event_id", F.round(d, 3).alias("metres"))


_CIRCLE = f"""WITH {EV}, p AS (SELECT user_id, event_id, k - 50.0 AS lat, value / 2 AS lng, lag(k - 50.0) OVER w AS lat0, lag(value / 2) OVER w AS lng0
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY ts_us, event_id)),
a AS (SELECT *, pow(sin(radians(lat - lat0) / 2), 2) + cos(radians(lat0)) * cos(radians(lat)) * pow(sin(radians(lng - lng0) / 2), 2) AS a FROM p WHERE lat0 IS NOT NULL)
SELECT user_id, event_id, round(12742000.0 * atan2(sqrt(a), sqrt(1 - a)), 3) AS metres FROM a"""


def euler_angles(spark, sf):
    parts = [F.col("embedding")[i].cast("double") for i in range(4)]
    norm = F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))
    e = load(spark, sf, "embeddings").select("vec_id", *[(p / norm).alias(f"q{i}") for i, p in enumerate(parts)])
    angles = quaternion_to_euler(*[F.col(f"q{i}") for i in range(4)])
    return e.select("vec_id", *[F.round(c, 6).alias(n) for n, c in angles.items()])


_EULER = """WITH p AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings),
q AS (SELECT vec_id, a / n AS w, b / n AS x, c / n AS y, d / n AS z FROM (SELECT *, sqrt(a*a + b*b + c*c + d*d) AS n FROM p))
SELECT vec_id, round(degrees(atan2(2 * (w*x + y*z), 1 - 2 * (x*x + y*y))), 6) AS roll_deg,
  round(degrees(asin(greatest(-1.0, least(1.0, 2 * (w*y - z*x))))), 6) AS pitch_deg,
  round(degrees(atan2(2 * (w*z + x*y), 1 - 2 * (y*y + z*z))), 6) AS yaw_deg FROM q"""

QUERIES = [
    Query("nearest_join", nearest_join, _NEAREST),
    Query("interp_join", interp_join, _INTERP),
    Query("response_window", response_window, _RESPONSE),
    Query("phase_stats", phase_stats, _PHASES),
    Query("first_n_after", first_n_after, _FIRST_N),
    Query("band_min", band_min, _BAND),
    Query("source_fallback", source_fallback, _FALLBACK),
    Query("sensor_disagreement", sensor_disagreement, _DISAGREE),
    Query("code_lookup", code_lookup, """SELECT c_custkey, coalesce(n_name, 'UNKNOWN_' || c_nationkey) AS nation, coalesce(r_name, 'UNKNOWN') AS region
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""),
    Query("great_circle", great_circle, _CIRCLE),
    Query("euler_angles", euler_angles, _EULER),
]
