"""Queries on runs, steps and moving frames of event series."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.catalogue.base import DAY, EV, HOUR, ORDER, USER, Query, event_series, events, groups_sql, load, rounded
from contrail.functions.geometry import magnitude
from contrail.operators import runs, stats
from contrail.operators.runs import Check
from contrail.operators.series import exact_quantile, open_series

_EVG = {"key": "user_id", "ts": "ts_us", "seq": "event_id"}
_W = "OVER (PARTITION BY user_id ORDER BY ts_us, event_id)"


def sustained_violation(spark, sf):
    s = event_series(spark, sf)
    g = runs.violation_groups(s, [Check("high", F.col("value") > 80, F.col("value"), 6 * HOUR)])
    return g.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n",
                    F.col("v_max").alias("value_max"), rounded("v_mean").alias("value_mean"))


_SUSTAINED = f"""WITH {EV} SELECT user_id, start_us, end_us, n, v_max AS value_max, round(v_mean, 8) AS value_mean
FROM {groups_sql('ev', 'value > 80', 'value', min_duration=6 * HOUR, **_EVG)}"""


def fused_threshold_rules(spark, sf):
    v, k = F.col("value"), F.col("k")
    checks = [Check("high", v > 80, v, 6 * HOUR), Check("busy", k >= 70, k, 3 * HOUR), Check("low", v < 10, v, 6 * HOUR)]
    g = runs.violation_groups(event_series(spark, sf), checks)
    return g.select("user_id", F.col("check").alias("rule"), F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n",
                    F.col("v_max").alias("peak"))


_FUSED = f"WITH {EV} " + " UNION ALL ".join(
    f"SELECT user_id, '{n}' AS rule, start_us, end_us, n, CAST(v_max AS DOUBLE) AS peak FROM {groups_sql('ev', c, v, min_duration=h * HOUR, **_EVG)}"
    for n, c, v, h in (("high", "value > 80", "value", 6), ("busy", "k >= 70", "k", 3), ("low", "value < 10", "value", 6))
)


def instant_violation(spark, sf):
    return events(spark, sf).where("value > 200").select("user_id", "ts_us", "event_id", "value")


def tolerant_groups(spark, sf):
    g = runs.violation_groups(event_series(spark, sf), [Check("high", F.col("value") > 80, F.col("value"), 0, 3)])
    return g.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n", F.col("v_max").alias("peak"))


def burst_onset(spark, sf):
    return runs.burst_onsets(event_series(spark, sf), F.col("value") > 60).select("user_id", "ts_us", "event_id", "value")


def spaced_events(spark, sf):
    return runs.spaced_events(event_series(spark, sf, "value > 60"), 12 * HOUR).select("user_id", "ts_us", "event_id", "value")


_SPACED = f"""WITH RECURSIVE {EV}, c AS (SELECT * FROM ev WHERE value > 60),
kept AS (SELECT user_id, min(ts_us) AS ts_us FROM c GROUP BY user_id
  UNION ALL SELECT c.user_id, min(c.ts_us) FROM kept JOIN c ON c.user_id = kept.user_id AND c.ts_us > kept.ts_us + {12 * HOUR}
  GROUP BY c.user_id)
SELECT c.user_id, c.ts_us, c.event_id, c.value FROM c JOIN kept USING (user_id, ts_us)"""


def mode_transitions(spark, sf):
    t = runs.transitions(event_series(spark, sf), "event_type")
    return t.select("user_id", "ts_us", "event_id", "before", F.col("event_type").alias("after"))


def arm_edges(spark, sf):
    s = event_series(spark, sf).with_columns({"armed": F.col("event_type") != "signup"}).shift({"was": "armed"})
    was = F.coalesce("was", F.lit(False))
    edge = F.when(F.col("armed") & ~was, "ARM").when(~F.col("armed") & was, "DISARM")
    return s.df.select("user_id", "ts_us", "event_id", edge.alias("edge")).where("edge is not null")


def step_drop(spark, sf):
    p = runs.steps(event_series(spark, sf), {"before": "value"}, DAY)
    return p.where("before - value >= 60").select("user_id", "ts_us", "event_id", "before", "value", "dt")


def value_gradient(spark, sf):
    g = runs.gradient(event_series(spark, sf), "value", "g", 1 / HOUR)
    return g.df.select("user_id", "ts_us", "event_id", rounded("g", 6).alias("per_hour"))


_GRAD = f"""p AS (SELECT *, lag(ts_us) {_W} AS t0, lead(ts_us) {_W} AS t1, lag(value) {_W} AS v0, lead(value) {_W} AS v1 FROM ev),
h AS (SELECT *, (ts_us - t0) * {1 / HOUR!r} AS h0, (t1 - ts_us) * {1 / HOUR!r} AS h1 FROM p),
g AS (SELECT *, CASE WHEN t0 IS NULL THEN (v1 - value) / h1 WHEN t1 IS NULL THEN (value - v0) / h0
  ELSE (h0*h0*v1 + (h1*h1 - h0*h0)*value - h1*h1*v0) / (h0*h1*(h0+h1)) END AS g FROM h)"""


def voltage_sag(spark, sf):
    s = runs.gradient(event_series(spark, sf), "value", "g", 1 / HOUR)
    g = F.col("g")
    found = runs.violation_groups(s, [Check("WARNING", g < -5, g, 0, 3), Check("CRITICAL", g < -15, g, 0, 3)])
    return found.select("user_id", F.col("check").alias("severity"), F.col("start").alias("start_us"), F.col("end").alias("end_us"),
                        "n", rounded("v_min", 6).alias("worst"))


_SAG = f"WITH {EV}, {_GRAD} " + " UNION ALL ".join(
    f"SELECT user_id, '{s}' AS severity, start_us, end_us, n, round(v_min, 6) AS worst FROM {groups_sql('g', f'g < {t}', 'g', gap=3, **_EVG)}"
    for s, t in (("WARNING", -5), ("CRITICAL", -15))
)


def brownout(spark, sf):
    s = event_series(spark, sf).totals({"top": F.max("value")})
    s = s.with_columns({"cells": F.greatest(F.lit(1.0), F.bround(F.col("top") / 100))})
    g = runs.violation_groups(s, [Check("b", F.col("value") < F.col("cells") * 12, F.col("value"), 12 * HOUR, 1, F.col("cells"))])
    return g.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n", F.col("aside").alias("cells"),
                    F.col("v_min").alias("lowest"))


_BROWN = f"""WITH {EV}, c AS (SELECT *, greatest(1.0::DOUBLE, round_even(max(value) OVER (PARTITION BY user_id) / 100, 0)) AS cells FROM ev)
SELECT user_id, start_us, end_us, n, aside AS cells, v_min AS lowest
FROM {groups_sql('c', 'value < cells * 12', 'value', min_duration=12 * HOUR, aside='cells', **_EVG)}"""


def rolling_mean(spark, sf):
    s = runs.rolling_mean_padded(event_series(spark, sf), "value", 20, "m")
    return s.df.select("user_id", "ts_us", "event_id", rounded("m").alias("moving_mean"))


_ROLL = "rows BETWEEN 10 PRECEDING AND 9 FOLLOWING"
_FRAME = f"OVER (PARTITION BY user_id ORDER BY ts_us, event_id {_ROLL})"


def current_spike(spark, sf):
    s = runs.rolling_mean_padded(event_series(spark, sf).totals({"rows": F.count(F.lit(1))}), "value", 20, "m")
    s = s.with_columns({"base": F.greatest(F.col("m"), F.lit(1.0))})
    hit = (F.col("rows") >= 40) & (F.col("value") > F.col("base") * 2.5)
    g = runs.violation_groups(s, [Check("s", hit, F.col("value"), 0, 5, F.col("base"))])
    return g.select("user_id", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n", F.col("v_max").alias("peak"),
                    rounded("aside").alias("baseline"))


_SPIKE = f"""WITH {EV}, b AS (SELECT *, greatest(sum(value) {_FRAME} / 20, 1.0) AS base, count(*) OVER (PARTITION BY user_id) AS n_all FROM ev)
SELECT user_id, start_us, end_us, n, v_max AS peak, round(aside, 8) AS baseline
FROM {groups_sql('b', 'n_all >= 40 AND value > base * 2.5', 'value', gap=5, aside='base', **_EVG)}"""


def internal_resistance(spark, sf):
    s = event_series(spark, sf).shift({"v0": "value", "k0": "k"})
    di = F.col("k") - F.col("k0")
    est = s.df.where(F.abs(di) > 5).select("user_id", (-(F.col("value") - F.col("v0")) / di).alias("r"))
    med = exact_quantile(est.where("r > 0 and r < 1"), USER, "r", 0.5)
    counts = events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("ts_us")).where("n >= 10")
    sev = F.when(F.col("r") < 0.5, "WARNING").otherwise("CRITICAL")
    return med.where("r > 0.08").join(counts, "user_id").select("user_id", "ts_us", rounded("r").alias("resistance"), sev.alias("severity"))


_RINT = f"""WITH {EV}, d AS (SELECT *, value - lag(value) {_W} AS dv, k - lag(k) {_W} AS di FROM ev),
r AS (SELECT user_id, -dv / di AS r FROM d WHERE abs(di) > 5), m AS (SELECT user_id, median(r) AS r FROM r WHERE r > 0 AND r < 1 GROUP BY user_id),
c AS (SELECT user_id, min(ts_us) AS ts_us FROM ev GROUP BY user_id HAVING count(*) >= 10)
SELECT user_id, ts_us, round(r, 8) AS resistance, CASE WHEN r < 0.5 THEN 'WARNING' ELSE 'CRITICAL' END AS severity
FROM m JOIN c USING (user_id) WHERE r > 0.08"""


def rolling_zscore(spark, sf):
    z = stats.rolling_zscore(event_series(spark, sf), "value", 20, 2.0)
    return z.select("user_id", "ts_us", "event_id", "value", rounded("z_score", 6).alias("z_score"), "severity")


_ZSCORE = f"""WITH {EV}, a AS (SELECT *, sum(value) {_FRAME} / 20 AS m, count(*) OVER (PARTITION BY user_id) AS n_all FROM ev),
b AS (SELECT *, abs(value - m) / greatest(sqrt(sum((value - m) * (value - m)) {_FRAME} / 20), 1e-10) AS z FROM a WHERE n_all >= 20),
c AS (SELECT *, coalesce(lag(z) {_W} > 2.0, false) AS was FROM b)
SELECT user_id, ts_us, event_id, value, round(z, 6) AS z_score, CASE WHEN z >= 3.0 THEN 'CRITICAL' ELSE 'WARNING' END AS severity
FROM c WHERE z > 2.0 AND NOT was"""


def clip_rate(spark, sf):
    s = event_series(spark, sf).shift({"t0": "ts_us"}, {"t1": "ts_us"})
    dt = F.greatest(F.coalesce(F.col("ts_us") - F.col("t0"), F.col("t1") - F.col("ts_us")) / HOUR, F.lit(0.001))
    s = s.with_columns({"rate": F.col("k") / dt})
    r = F.col("rate")
    g = runs.violation_groups(s, [Check("CRITICAL", r > 100, r, 0, 5), Check("WARNING", (r > 50) & (r <= 100), r, 0, 5)])
    return g.select("user_id", F.col("check").alias("severity"), F.col("start").alias("start_us"), F.col("end").alias("end_us"), "n",
                    rounded("v_max", 6).alias("peak_per_hour"))


_CLIP = f"""WITH {EV}, r AS (SELECT *, k / greatest(coalesce(ts_us - lag(ts_us) {_W}, lead(ts_us) {_W} - ts_us) / {HOUR}.0, 0.001) AS rate FROM ev) """ + " UNION ALL ".join(
    f"SELECT user_id, '{s}' AS severity, start_us, end_us, n, round(v_max, 6) AS peak_per_hour FROM {groups_sql('r', c, 'rate', gap=5, **_EVG)}"
    for s, c in (("CRITICAL", "rate > 100"), ("WARNING", "rate > 50 AND rate <= 100"))
)


def vector_magnitude(spark, sf):
    size = magnitude(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100)
    df = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.abs(size - 25.0).alias("x"))
    return df.where("x > 20").select("l_orderkey", "l_linenumber", "l_partkey", rounded("x").alias("excess"))


def downsample(spark, sf):
    return runs.every_nth(event_series(spark, sf), 20).select("user_id", "ts_us", "event_id", "value")


def row_differences(spark, sf):
    s = event_series(spark, sf).shift({"p": "value"}, {"x": "value"})
    return s.df.select("user_id", "ts_us", "event_id", rounded(F.col("value") - F.col("p")).alias("diff"), F.col("x").alias("next_value"))


def output_asymmetry(spark, sf):
    names = ["click", "error", "purchase", "signup", "view"]
    day = F.floor(F.col("ts_us") / DAY) * DAY
    per_day = events(spark, sf).groupBy("user_id", day.cast("long").alias("day_us")).agg(
        *[F.max(F.when(F.col("event_type") == n, F.col("value"))).alias(n) for n in names]
    )
    outs = F.array_compact(F.array(*names))
    odd = per_day.where(F.exists(outs, lambda v: v < 10) & F.exists(outs, lambda v: v > 40))
    s = open_series(odd.withColumn("seq", F.lit(0)), USER, ["day_us", "seq"])
    return runs.spaced_events(s, 5 * DAY).select("user_id", "day_us", *names)


_ASYM = f"""WITH RECURSIVE {EV}, d AS (SELECT user_id, ts_us // {DAY} * {DAY} AS day_us,
  max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'error') AS error,
  max(value) FILTER (event_type = 'purchase') AS purchase, max(value) FILTER (event_type = 'signup') AS signup,
  max(value) FILTER (event_type = 'view') AS "view" FROM ev GROUP BY 1, 2),
c AS (SELECT * FROM d WHERE least(click, error, purchase, signup, "view") < 10 AND greatest(click, error, purchase, signup, "view") > 40),
kept AS (SELECT user_id, min(day_us) AS day_us FROM c GROUP BY user_id
  UNION ALL SELECT c.user_id, min(c.day_us) FROM kept JOIN c ON c.user_id = kept.user_id AND c.day_us > kept.day_us + {5 * DAY} GROUP BY c.user_id)
SELECT c.* FROM c JOIN kept USING (user_id, day_us)"""

QUERIES = [
    Query("sustained_violation", sustained_violation, _SUSTAINED),
    Query("fused_threshold_rules", fused_threshold_rules, _FUSED),
    Query("instant_violation", instant_violation, f"WITH {EV} SELECT user_id, ts_us, event_id, value FROM ev WHERE value > 200"),
    Query("tolerant_groups", tolerant_groups,
          f"WITH {EV} SELECT user_id, start_us, end_us, n, v_max AS peak FROM {groups_sql('ev', 'value > 80', 'value', gap=3, **_EVG)}"),
    Query("burst_onset", burst_onset, f"""WITH {EV}, f AS (SELECT *, value > 60 AS flag, coalesce(lag(value > 60) {_W}, false) AS was FROM ev)
SELECT user_id, ts_us, event_id, value FROM f WHERE flag AND NOT was"""),
    Query("spaced_events", spaced_events, _SPACED),
    Query("mode_transitions", mode_transitions, f"""WITH {EV}, p AS (SELECT *, lag(event_type) {_W} AS before FROM ev)
SELECT user_id, ts_us, event_id, before, event_type AS after FROM p WHERE before <> event_type"""),
    Query("arm_edges", arm_edges, f"""WITH {EV}, a AS (SELECT *, event_type <> 'signup' AS armed, lag(event_type <> 'signup', 1, false) {_W} AS was FROM ev)
SELECT user_id, ts_us, event_id, CASE WHEN armed THEN 'ARM' ELSE 'DISARM' END AS edge FROM a WHERE armed <> was"""),
    Query("step_drop", step_drop, f"""WITH {EV}, p AS (SELECT *, lag(value) {_W} AS before, ts_us - lag(ts_us) {_W} AS dt FROM ev)
SELECT user_id, ts_us, event_id, before, value, dt FROM p WHERE dt > 0 AND dt <= {DAY} AND before - value >= 60"""),
    Query("value_gradient", value_gradient, f"WITH {EV}, {_GRAD} SELECT user_id, ts_us, event_id, round(g, 6) AS per_hour FROM g"),
    Query("voltage_sag", voltage_sag, _SAG),
    Query("brownout", brownout, _BROWN),
    Query("rolling_mean", rolling_mean, f"WITH {EV} SELECT user_id, ts_us, event_id, round(sum(value) {_FRAME} / 20, 8) AS moving_mean FROM ev"),
    Query("current_spike", current_spike, _SPIKE),
    Query("internal_resistance", internal_resistance, _RINT),
    Query("rolling_zscore", rolling_zscore, _ZSCORE),
    Query("clip_rate", clip_rate, _CLIP),
    Query("vector_magnitude", vector_magnitude, """SELECT l_orderkey, l_linenumber, l_partkey, round(x, 8) AS excess FROM (SELECT *,
  abs(sqrt(l_quantity * l_quantity + (l_discount * 100) * (l_discount * 100) + (l_tax * 100) * (l_tax * 100)) - 25.0) AS x FROM lineitem) WHERE x > 20"""),
    Query("downsample", downsample, f"""WITH {EV}, n AS (SELECT *, row_number() {_W} AS rn, count(*) OVER (PARTITION BY user_id) AS n_all FROM ev)
SELECT user_id, ts_us, event_id, value FROM n WHERE (rn - 1) % greatest(1, CASE WHEN n_all > 20 THEN n_all // 20 ELSE 1 END) = 0"""),
    Query("row_differences", row_differences, f"""WITH {EV} SELECT user_id, ts_us, event_id, round(value - lag(value) {_W}, 8) AS diff,
  lead(value) {_W} AS next_value FROM ev"""),
    Query("output_asymmetry", output_asymmetry, _ASYM),
]
