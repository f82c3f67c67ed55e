"""Queries on derived records: anomalies, registries, profiles, baselines, evaluation, ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.catalogue.base import DAY, EV, Query, events, load, micros, rounded
from contrail.operators import similarity
from contrail.operators.runs import first_rows
from contrail.plans import evaluation, grounding, metrics, report
from contrail.sources import manifest, mapping, profile, tabular
from contrail.sources.store import unpivot
from contrail.streaming.stateless import over_quota

# Events read as anomalies: the type gives rule and category, the value gives the severity.
_RULE = """CASE event_type WHEN 'click' THEN 'GPS_FIX_DROP' WHEN 'view' THEN 'BAT_LOW_CAPACITY' WHEN 'error' THEN 'EKF_INNOV_VEL'
  WHEN 'purchase' THEN 'VIBE_HIGH_RMS' WHEN 'signup' THEN CASE WHEN k < 15 THEN 'UNSAFE_ARM' WHEN k < 50 THEN 'PARAM_OUT_OF_RANGE' ELSE 'MOTOR_IMBALANCE' END END"""
_CATEGORY = "CASE event_type WHEN 'click' THEN 'GPS' WHEN 'view' THEN 'POWER' WHEN 'error' THEN 'EKF' WHEN 'purchase' THEN 'VIBRATION' ELSE 'OTHER' END"
_SEVERITY = "CASE WHEN value > 200 THEN 'FATAL' WHEN value > 100 THEN 'CRITICAL' WHEN value > 40 THEN 'WARNING' ELSE 'INFO' END"
_ANOM = f"""{EV}, anom AS (SELECT CAST(user_id AS VARCHAR) AS flight_id, {_RULE} AS rule_name, {_CATEGORY} AS category, {_SEVERITY} AS severity,
  ts_us AS timestamp_us, CAST(event_id AS VARCHAR) AS channel, value FROM ev)"""
_RANK = "CASE severity WHEN 'FATAL' THEN 0 WHEN 'CRITICAL' THEN 1 WHEN 'WARNING' THEN 2 ELSE 3 END"


def anomalies(spark, sf):
    return events(spark, sf).selectExpr(
        "CAST(user_id AS STRING) AS flight_id", f"{_RULE} AS rule_name", f"{_CATEGORY} AS category", f"{_SEVERITY} AS severity",
        "ts_us AS timestamp_us", "CAST(event_id AS STRING) AS channel", "CAST(value AS STRING) AS description",
        "map('value', value) AS raw_values", "value",
    )


def anomaly_summary(spark, sf):
    return metrics.anomaly_counts(anomalies(spark, sf))


def anomaly_heads(spark, sf):
    s = metrics.anomaly_summary(anomalies(spark, sf))
    return s.select("flight_id", "total", "first_critical_us", "has_fatal", F.map_values("by_severity")[0].alias("n_first_severity"))


_HEADS = f"""WITH {_ANOM}, f AS (SELECT flight_id, severity, count(*) AS n FROM anom GROUP BY 1, 2)
SELECT a.flight_id, count(*) AS total, min(timestamp_us) FILTER (severity IN ('CRITICAL', 'FATAL')) AS first_critical_us, bool_or(severity = 'FATAL') AS has_fatal,
  (SELECT arg_min(n, severity) FROM f WHERE f.flight_id = a.flight_id) AS n_first_severity FROM anom a GROUP BY a.flight_id"""


def registry_dedupe(spark, sf):
    daily = anomalies(spark, sf).withColumn("timestamp_us", F.floor(F.col("timestamp_us") / DAY) * DAY)
    r = report.anomaly_registry(daily)
    return r.select("flight_id", "rule_name", "timestamp_us", "subsystem", "severity", F.col("raw_values")["value"].alias("value"))


_DEDUPE = f"""WITH {_ANOM}, r AS (SELECT *, timestamp_us // {DAY} * {DAY} AS day_us, row_number() OVER (PARTITION BY flight_id, rule_name, timestamp_us // {DAY}
  ORDER BY {_RANK}, channel) AS rn FROM anom)
SELECT flight_id, rule_name, day_us AS timestamp_us, category AS subsystem, severity, value FROM r WHERE rn = 1"""


def findings_merge(spark, sf):
    a = anomalies(spark, sf)
    merged = report.merge_findings(a.where("category = 'GPS'"), a.where("severity <> 'INFO'"))
    return merged.select("flight_id", "rule_name", "timestamp_us", "severity")


def classify_guarded(spark, sf):
    a = anomalies(spark, sf)
    loud = a.where("severity <> 'INFO'")
    flights = a.groupBy("flight_id").agg(
        (F.max("value") > 260).alias("crash_detected"), F.when(F.avg("value") > 50, F.lit("CRASH")).alias("proposed"))
    return report.classify(flights, loud).select("flight_id", "base_classification", "classification", "n_anomalies")


_CRASHY = ", ".join(f"'{r}'" for r in report.CRASH_RULES)
_CLASSIFY = f"""WITH {_ANOM}, f AS (SELECT flight_id, max(value) > 260 AS crash, CASE WHEN avg(value) > 50 THEN 'CRASH' END AS proposed FROM anom GROUP BY 1),
s AS (SELECT flight_id, count(*) AS n, bool_or(severity = 'FATAL') AS fatal, bool_or(rule_name IN ({_CRASHY})) AS cr FROM anom WHERE severity <> 'INFO' GROUP BY 1),
j AS (SELECT f.flight_id, crash, coalesce(n, 0) AS n, coalesce(fatal, false) AS fatal, coalesce(cr, false) AS cr, proposed,
  CASE WHEN crash THEN 'CRASH' WHEN coalesce(n, 0) > 0 THEN 'ANOMALY' ELSE 'REVIEW' END AS base FROM f LEFT JOIN s USING (flight_id))
SELECT flight_id, base AS base_classification, CASE WHEN crash THEN 'CRASH' WHEN coalesce(proposed, base) = 'CRASH' AND NOT fatal AND NOT cr THEN 'ANOMALY'
  ELSE coalesce(proposed, base) END AS classification, n AS n_anomalies FROM j"""


def top_anchor(spark, sf):
    return report.anchor(anomalies(spark, sf)).select("flight_id", "rule_name", "severity", "timestamp_us", "channel")


_ANCHOR = f"""WITH {_ANOM}, r AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY {_RANK}, timestamp_us DESC) AS rn FROM anom)
SELECT flight_id, rule_name, severity, timestamp_us, channel FROM r WHERE rn = 1"""


def causal_bounds(spark, sf):
    return report.causal_bounds(anomalies(spark, sf))


_CAUSAL = f"""WITH {_ANOM} SELECT flight_id, arg_min(rule_name, timestamp_us) AS earliest_rule, min(timestamp_us) AS earliest_us,
arg_max(rule_name, timestamp_us) AS latest_rule, max(timestamp_us) AS latest_us, count(*) AS n_critical FROM anom WHERE severity IN ('CRITICAL', 'FATAL') GROUP BY flight_id"""


def report_evidence(spark, sf):
    return report.report_evidence(anomalies(spark, sf)).select("flight_id", "section", "rule_name", "severity", "timestamp_us")


_EVIDENCE = f"""WITH {_ANOM}, s AS (SELECT *, CASE WHEN severity IN ('CRITICAL', 'FATAL') THEN 'critical' ELSE 'other' END AS section FROM anom
  UNION ALL SELECT *, 'parameter' FROM anom WHERE rule_name LIKE 'PARAM\\_%' ESCAPE '\\')
SELECT flight_id, section, rule_name, severity, timestamp_us FROM s"""


def domain_matrix(spark, sf):
    a = anomalies(spark, sf)
    ids = grounding.evidence_ids(a.where("severity in ('CRITICAL', 'FATAL')"))
    return report.domain_matrix(ids, a).select("flight_id", "domain", "n_rules", "n_agents", "available")


_MATRIX_D = " UNION ALL ".join(
    f"SELECT '{d}' AS domain, '{p}' AS prefix" for d, (prefixes, _) in report.EVIDENCE_MATRIX.items() for p in prefixes)
_MATRIX = f"""WITH {_ANOM}, d AS ({_MATRIX_D}), i AS (SELECT DISTINCT flight_id, rule_name FROM anom WHERE severity IN ('CRITICAL', 'FATAL')),
h AS (SELECT flight_id, domain, count(DISTINCT rule_name) AS n FROM i JOIN d ON starts_with(rule_name, prefix) GROUP BY 1, 2)
SELECT f.flight_id, x.domain, coalesce(n, 0) AS n_rules, 0 AS n_agents, coalesce(n, 0) > 0 AS available
FROM (SELECT DISTINCT flight_id FROM anom) f CROSS JOIN (SELECT DISTINCT domain FROM d) x LEFT JOIN h ON h.flight_id = f.flight_id AND h.domain = x.domain"""


def last_value_per_key(spark, sf):
    return metrics.last_values(events(spark, sf), ["user_id", "event_type"], "k", ("ts_us", "event_id"))


def flight_profile(spark, sf):
    e = events(spark, sf).withColumn("flight_id", F.col("user_id").cast("string"))
    return profile.type_profile(e, "ts_us", "event_type").select("flight_id", "event_type", "n", rounded("rate_hz", 12).alias("rate_hz"))


def log_profile(spark, sf):
    names = F.create_map(*[F.lit(x) for p in (("click", "ATT"), ("view", "GPS"), ("error", "ERR"), ("purchase", "MODE"), ("signup", "PARM")) for x in p])
    e = events(spark, sf).select(F.col("user_id").cast("string").alias("flight_id"), "ts_us", F.col("event_id").alias("seq"), names[F.col("event_type")].alias("msg_type"))
    p = profile.log_profile(e, "ts_us")
    return p.select("flight_id", "log_start_us", "log_end_us", "duration_us", "parameter_count", F.array_join("message_types", ",").alias("types"),
                    F.array_join("missing_critical", ",").alias("missing"))


_LOG = f"""WITH {EV}, m AS (SELECT *, CASE event_type WHEN 'click' THEN 'ATT' WHEN 'view' THEN 'GPS' WHEN 'error' THEN 'ERR' WHEN 'purchase' THEN 'MODE' ELSE 'PARM' END AS t FROM ev)
SELECT CAST(user_id AS VARCHAR) AS flight_id, min(ts_us) AS log_start_us, max(ts_us) AS log_end_us, max(ts_us) - min(ts_us) AS duration_us,
  count(*) FILTER (t = 'PARM') AS parameter_count, array_to_string(list_sort(list(DISTINCT t)), ',') AS types,
  array_to_string(list_filter(['ATT', 'GPS', 'IMU', 'BAT', 'RCOU', 'MODE', 'ERR'], lambda x: NOT list_contains(list(DISTINCT t), x)), ',') AS missing FROM m GROUP BY user_id"""


# Each vector asks for rows of its own: a vehicle type, a phase, or healthy rows only, and a third of them for any.
_BASE_KIND = "*, vec_id % 3 AS vehicle_type, vec_id % 4 AS phase, label <> 9 AS is_healthy"
_ASKS = "*, CASE WHEN vec_id % 5 < 3 THEN vec_id % 3 END AS vehicle_type, CASE WHEN vec_id % 7 < 2 THEN vec_id % 4 END AS phase, CASE WHEN vec_id % 2 = 0 THEN true END AS healthy"


def similar_topk(spark, sf):
    e = load(spark, sf, "embeddings")
    asks = e.selectExpr(*_exprs(_ASKS))
    t = similarity.top_k(asks, e.selectExpr(*_exprs(_BASE_KIND)), 5, "vec_id", "vec_id", filters={"vehicle_type": "vehicle_type", "phase": "phase", "is_healthy": "healthy"})
    return t.select("query_id", "id", rounded("score").alias("score"), "rank")


def _exprs(columns):
    return [c.strip() for c in columns.split(", ")]


_COSINE = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS score"
_RANKED = "t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"
_SIM_OWN = f"""q AS (SELECT {_ASKS} FROM embeddings), e AS (SELECT {_BASE_KIND} FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} FROM q a JOIN e b ON (a.vehicle_type IS NULL OR a.vehicle_type = b.vehicle_type)
  AND (a.phase IS NULL OR a.phase = b.phase) AND (a.healthy IS NULL OR b.is_healthy = a.healthy)), {_RANKED}"""
_SIM = f"""s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COSINE} FROM embeddings a JOIN embeddings b ON b.label <> 9), {_RANKED}"""


def _with_metrics(df):
    first = F.col("embedding")[0].cast("double")
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return df.withColumn("metrics", F.create_map(F.lit("first"), first, F.lit("total"), total, F.lit("label"), F.col("label").cast("double")))


def baseline_deviation(spark, sf):
    e = _with_metrics(load(spark, sf, "embeddings")).withColumn("query_id", F.col("vec_id"))
    d = similarity.deviation_from_matches(e, e, 10, "query_id", "vec_id", where=F.col("label") != 9)
    far = F.abs("z_score") < 1e6  # a spread of zero gives a z without meaning in its digits
    return d.select("query_id", "metric", rounded("current_value", 6).alias("current_value"), rounded("baseline_mean", 6).alias("baseline_mean"),
                    F.when(far, F.round("z_score", 4)).alias("z_score"), "is_anomalous", F.when(F.abs("z_score") > 1e-6, F.col("direction")).alias("direction"),
                    F.array_join("similar", ",").alias("matches"), F.array_join(F.transform("similarity_scores", lambda x: F.format_number(x, 6)), ",").alias("scores"), "n_compared")


_DEV = f"""WITH {_SIM}, m AS (SELECT vec_id, unnest([{{'metric': 'first', 'v': embedding[1]::DOUBLE}}, {{'metric': 'total', 'v': list_sum(embedding::DOUBLE[])}},
  {{'metric': 'label', 'v': label::DOUBLE}}], recursive := true) FROM embeddings),
b AS (SELECT query_id, metric, avg(v) AS mu, stddev_pop(v) AS sd FROM t JOIN m ON m.vec_id = t.id WHERE rank <= 10 GROUP BY 1, 2),
z AS (SELECT b.*, m.v, (v - mu) / (sd + 1e-10) AS z FROM b JOIN m ON m.vec_id = b.query_id AND m.metric = b.metric),
h AS (SELECT query_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE rank <= 5) AS matches,
  string_agg(printf('%.6f', score), ',' ORDER BY rank) FILTER (WHERE rank <= 5) AS scores, count(*) AS n_compared FROM t WHERE rank <= 10 GROUP BY 1)
SELECT query_id, metric, round(v, 6) AS current_value, round(mu, 6) AS baseline_mean, CASE WHEN abs(z) < 1e6 THEN round(z, 4) END AS z_score, abs(z) > 2.5 AS is_anomalous,
  CASE WHEN abs(z) > 1e-6 THEN CASE WHEN z > 0 THEN 'HIGH' ELSE 'LOW' END END AS direction, matches, scores, n_compared
FROM z JOIN h USING (query_id)"""


def _labelled(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source", "text")
    return load(spark, sf, "labels").join(docs, "doc_id")


def class_metrics(spark, sf):
    want = F.when(F.col("toxic") == 1, "TOXIC").when(F.col("quality") == 1, "GOOD").otherwise("POOR")
    got = F.when(F.col("n_chars") > 3000, "TOXIC").when(F.col("n_chars") > 500, "GOOD").otherwise("POOR")
    m = evaluation.class_metrics(_labelled(spark, sf), want, got)
    return m.select("label", "tp", "fp", "fn", *[rounded(c).alias(c) for c in ("precision", "recall", "f1")])


_CLASS = """WITH j AS (SELECT CASE WHEN toxic = 1 THEN 'TOXIC' WHEN quality = 1 THEN 'GOOD' ELSE 'POOR' END AS e,
  CASE WHEN n_chars > 3000 THEN 'TOXIC' WHEN n_chars > 500 THEN 'GOOD' ELSE 'POOR' END AS a FROM labels JOIN documents USING (doc_id)),
l AS (SELECT DISTINCT unnest([e, a]) AS label FROM j),
c AS (SELECT label, count(*) FILTER (e = label AND a = label) AS tp, count(*) FILTER (e <> label AND a = label) AS fp, count(*) FILTER (e = label AND a <> label) AS fn FROM l, j GROUP BY label),
p AS (SELECT *, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r FROM c)
SELECT label, tp, fp, fn, round(p, 8) AS precision, round(r, 8) AS recall, round(2 * p * r / nullif(p + r, 0), 8) AS f1 FROM p"""


def binary_rates(spark, sf):
    r = evaluation.binary_rates(_labelled(spark, sf), F.col("quality") == 1, F.col("n_chars") > 800)
    return r.select("total_cases", *[rounded(c).alias(c) for c in ("accuracy", "false_positive_rate", "false_negative_rate")])


_BINARY = """WITH j AS (SELECT quality = 1 AS e, n_chars > 800 AS a FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS total_cases, round(avg((e = a)::INT), 8) AS accuracy, round(count(*) FILTER (NOT e AND a) / nullif(count(*) FILTER (NOT e), 0), 8) AS false_positive_rate,
  round(count(*) FILTER (e AND NOT a) / nullif(count(*) FILTER (e), 0), 8) AS false_negative_rate FROM j"""

_LEVEL = "CASE WHEN n_chars > 4000 THEN 'DEFINITIVE' WHEN n_chars > 1500 THEN 'HIGH' WHEN n_chars > 500 THEN 'MEDIUM' WHEN n_chars > 100 THEN 'LOW' ELSE 'NONE' END"


def confidence_calibration(spark, sf):
    j = _labelled(spark, sf).withColumn("level", F.expr(_LEVEL))
    c = evaluation.confidence_calibration(j, (F.col("quality") == 1) == (F.col("n_chars") > 800), F.col("level"))
    return c.select("correct", rounded("mean_confidence").alias("mean_confidence"), "n")


_CALIB = f"""WITH j AS (SELECT (quality = 1) = (n_chars > 800) AS correct, {_LEVEL} AS level FROM labels JOIN documents USING (doc_id))
SELECT correct, round(avg(CASE level WHEN 'DEFINITIVE' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 ELSE 0 END), 8) AS mean_confidence, count(*) AS n FROM j GROUP BY correct"""


def _scored(spark, sf):
    j = _labelled(spark, sf)
    case = F.col("doc_id").cast("string").alias("case_id")
    reports = j.select(
        case, F.expr("CASE WHEN n_chars > 1500 THEN 'CRASH' ELSE 'ANOMALY' END").alias("classification"), F.expr(_LEVEL).alias("confidence_level"),
        F.col("text").alias("root_cause"), F.array("source", "lang").alias("rule_names"),
        F.array(F.concat("text", F.lit(" [evidence: "), "source", F.lit(", "), "lang", F.lit("] (HIGH)"))).alias("contributing_factors"),
        F.when(F.col("toxic") == 1, F.array(F.lit("toxic"))).otherwise(F.array().cast("array<string>")).alias("errors"),
    )
    specs = j.select(
        case, F.expr("CASE WHEN quality = 1 THEN 'CRASH' ELSE 'ANOMALY' END").alias("expected_classification"), F.lit("MEDIUM").alias("min_confidence"),
        F.array(F.when(F.col("quality") == 1, "en").otherwise("fr")).alias("required_rules"), F.array(F.lit("the "), F.lit("der ")).alias("keywords"),
        F.array(F.lit("src1"), F.lit("fr"), F.lit("de")).alias("required_evidence"), F.array(F.lit("Worthless"), F.lit("QUE")).alias("forbidden_terms"),
    )
    return evaluation.score_cases(reports, specs)


_SCORED = f"""s AS (SELECT CAST(doc_id AS VARCHAR) AS case_id, toxic, CASE WHEN n_chars > 1500 THEN 'CRASH' ELSE 'ANOMALY' END AS got,
  CASE WHEN quality = 1 THEN 'CRASH' ELSE 'ANOMALY' END AS want, CASE {_LEVEL} WHEN 'DEFINITIVE' THEN 3 WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 0 ELSE -1 END AS rank,
  CASE WHEN quality = 1 THEN lang = 'en' ELSE lang = 'fr' END AS rules_ok, contains(lower(text), 'the ') OR contains(lower(text), 'der ') AS cause_ok,
  source = 'src1' OR lang IN ('fr', 'de') AS cite_ok, NOT contains(lower(text), 'worthless') AND NOT contains(lower(text), 'que') AS clean FROM labels JOIN documents USING (doc_id)),
c AS (SELECT *, (got = want)::INT + (rank >= 1)::INT + rules_ok::INT + cause_ok::INT + cite_ok::INT + clean::INT AS hits FROM s)"""


def score_cases(spark, sf):
    return _scored(spark, sf).select("case_id", rounded("score").alias("score"), "passed")


def criteria_rates(spark, sf):
    return evaluation.criteria_rates(_scored(spark, sf)).select("criterion", rounded("pass_rate").alias("pass_rate"), "checked")


_CRIT = f"WITH {_SCORED} " + " UNION ALL ".join(
    f"SELECT '{n}' AS criterion, round(avg(({c})::INT), 8) AS pass_rate, count(*) AS checked FROM c"
    for n, c in (("classification_match", "got = want"), ("confidence_sufficient", "rank >= 1"), ("required_rules_present", "rules_ok"),
                 ("root_cause_keyword_present", "cause_ok"), ("contributing_evidence_present", "cite_ok"), ("no_forbidden_terms", "clean")))


def benchmark_metrics(spark, sf):
    m = evaluation.benchmark_metrics(_scored(spark, sf))
    keep = ["total_cases", "passed_cases", "failed_cases", "error_cases", "classification_correct", "passes_exit_criteria"]
    rates = ["classification_accuracy", "false_positive_rate", "false_negative_rate", "fabricated_evidence_rate", "overall_pass_rate", "mean_conf_correct", "mean_conf_incorrect"]
    return m.select(*keep, *[rounded(c).alias(c) for c in rates], F.array_join("failures", ",").alias("failures"))


_BENCH = f"""WITH {_SCORED}, m AS (SELECT count(*) AS total_cases, count(*) FILTER (hits = 6) AS passed_cases, count(*) FILTER (hits < 6) AS failed_cases,
  count(*) FILTER (toxic = 1) AS error_cases, count(*) FILTER (got = want) AS classification_correct, avg((got = want)::INT) AS acc,
  count(*) FILTER (want <> 'CRASH' AND got = 'CRASH') / count(*) FILTER (want <> 'CRASH') AS fpr, count(*) FILTER (want = 'CRASH' AND got <> 'CRASH') / count(*) FILTER (want = 'CRASH') AS fnr,
  avg((NOT rules_ok)::INT) AS fab, avg((hits = 6)::INT) AS pass, avg(greatest(rank, 0)) FILTER (got = want) AS mc, avg(greatest(rank, 0)) FILTER (got <> want) AS mi FROM c)
SELECT total_cases, passed_cases, failed_cases, error_cases, classification_correct, acc >= 0.8 AND fab = 0 AND fnr <= 0.2 AS passes_exit_criteria,
  round(acc, 8) AS classification_accuracy, round(fpr, 8) AS false_positive_rate, round(fnr, 8) AS false_negative_rate, round(fab, 8) AS fabricated_evidence_rate,
  round(pass, 8) AS overall_pass_rate, round(mc, 8) AS mean_conf_correct, round(mi, 8) AS mean_conf_incorrect,
  concat_ws(',', CASE WHEN acc < 0.8 THEN 'classification_accuracy' END, CASE WHEN fab > 0 THEN 'fabricated_evidence_rate' END, CASE WHEN fnr > 0.2 THEN 'false_negative_rate' END) AS failures FROM m"""


def quota_windows(spark, sf):
    return over_quota(events(spark, sf), "user_id", "event_type", "ts_us", 2, 86_400)


def newest_page(spark, sf):
    o = load(spark, sf, "orders").select("o_orderkey", micros("o_orderdate").alias("day_us"), "o_custkey")
    return o.orderBy(F.desc("day_us"), "o_orderkey").offset(10).limit(50)


def latest_version(spark, sf):
    o = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", micros("o_orderdate").alias("day_us"))
    latest = o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("day_us", "o_orderkey")).alias("r"))
    return latest.select("o_custkey", "r.*")


def record_tree(spark, sf):
    c, o = load(spark, sf, "customer").select("c_custkey"), load(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    li = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n_lines"))
    return c.join(o, "c_custkey", "left").join(li, "o_orderkey", "left").select("c_custkey", "o_orderkey", "n_lines")


def cascade_delete(spark, sf):
    gone = load(spark, sf, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    dead = load(spark, sf, "orders").join(gone, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("l_orderkey")).distinct()
    return load(spark, sf, "lineitem").join(dead, "l_orderkey", "left_anti").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def duplicate_hash(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    firsts = d.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    return firsts.where("copies > 1")


def format_sniff(spark, sf):
    parts = [load(spark, sf, "documents").select(F.col("text").alias("t"), F.lit("txt").alias("x")),
             load(spark, sf, "pages").select(F.col("html").alias("t"), F.lit("json").alias("x")),
             load(spark, sf, "events").select(F.col("props").alias("t"), F.lit("csv").alias("x"))]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    header = F.substring(F.encode("t", "UTF-8"), 1, manifest.HEADER_BYTES)
    return both.groupBy("x", manifest.detect_format(header, F.col("x")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


_SNIFF = """WITH b AS (SELECT text AS t, 'txt' AS x FROM documents UNION ALL SELECT html, 'json' FROM pages UNION ALL SELECT props, 'csv' FROM events),
h AS (SELECT x, hex(encode(t))[1:64] AS h FROM b), d AS (SELECT x, h, list_aggregate(list_transform(range(1, len(h), 2), lambda i: h[i:i+1]), 'string_agg', ' ') AS s FROM h)
SELECT x, CASE WHEN contains(' ' || coalesce(s, ''), ' 2C') AND NOT starts_with(h, '7B') THEN 'csv' WHEN regexp_matches(coalesce(s, ''), '^(20 )*(7B|5B)') THEN 'json'
  WHEN x = 'json' THEN 'json' WHEN x = 'csv' THEN 'csv' ELSE 'ardupilot_bin' END AS format, count(*) AS n FROM d GROUP BY 1, 2"""


def admission_checks(spark, sf):
    p = load(spark, sf, "pages").select(F.element_at(F.split("url", "/"), -1).alias("filename"), F.length("html").cast("long").alias("length"),
                                        F.substring(F.encode("html", "UTF-8"), 1, 32).alias("header"))
    e = load(spark, sf, "events").select(F.concat(F.col("event_type"), F.lit("."), F.expr("CASE WHEN value > 60 THEN 'json' WHEN value > 30 THEN 'csv' ELSE 'exe' END")).alias("filename"),
                                         (F.col("value") * 10).cast("long").alias("length"), F.encode("props", "UTF-8").alias("header"))
    rows = p.unionByName(e).withColumn("extension", manifest.extension(F.col("filename")))
    return rows.groupBy(F.coalesce(manifest.reject_reason(1500), F.lit("accepted")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


_ADMIT = r"""WITH r AS (SELECT string_split(url, '/')[-1] AS f, length(html) AS n, hex(encode(html)) AS h FROM pages UNION ALL
SELECT event_type || '.' || CASE WHEN value > 60 THEN 'json' WHEN value > 30 THEN 'csv' ELSE 'exe' END, CAST(trunc(value * 10) AS BIGINT), hex(encode(props)) FROM events),
x AS (SELECT *, lower(regexp_extract(f, '\.([^.]+)$', 1)) AS e FROM r)
SELECT CASE WHEN NOT regexp_matches(f, '^[0-9A-Za-z_\-. ]+$') THEN 'unsafe filename' WHEN length(f) > 255 THEN 'filename too long'
  WHEN e NOT IN ('bin', 'ulg', 'ulog', 'tlog', 'csv', 'json') THEN 'unsupported extension' WHEN n <= 0 THEN 'empty file' WHEN n > 1500 THEN 'file too large'
  WHEN e = 'json' AND NOT (starts_with(h, '7B') OR starts_with(h, '5B')) THEN 'header does not match extension' ELSE 'accepted' END AS verdict, count(*) AS n FROM x GROUP BY 1"""


def time_normalize(spark, sf):
    e = events(spark, sf).select(F.col("event_type").alias("source_file"), "event_id",
                                 F.when(F.col("event_type") == "view", F.col("ts_us").cast("double")).otherwise(F.floor(F.col("ts_us") / 1e6).cast("double")).alias("time"))
    return tabular.normalize_time(e).select("event_id", "timestamp_us")


def _raw(spark, sf, message, fields):
    e = events(spark, sf)
    pairs = [c for k, v in fields.items() for c in (F.lit(k), F.expr(v).cast("string"))]
    return e.select(F.col("user_id").cast("string").alias("flight_id"), F.col("event_id").alias("seq"), message.alias("msg_type"), F.create_map(*pairs).alias("fields"))


def dataflash_tables(spark, sf):
    kind = F.when(F.col("event_type") == "error", "ERR").when(F.col("event_type") == "view", "MODE").when(F.col("event_type") == "click", "BAT").otherwise("NOISE")
    t = mapping.from_dataflash(_raw(spark, sf, kind, {"TimeUS": "ts_us", "Subsys": "k % 30", "ECode": "k % 3", "Mode": "k % 30", "Volt": "value",
                                                      "VoltR": "CASE WHEN k > 50 THEN value + 1 END"}), ["BAT", "MODE", "ERR"])
    parts = [
        t["BAT"].select("flight_id", "timestamp_us", F.lit("BAT").alias("msg"), F.lit(None).cast("string").alias("name"), rounded("voltage_v", 4).alias("v")),
        t["MODE"].select("flight_id", "timestamp_us", F.lit("MODE").alias("msg"), F.col("mode_name").alias("name"), F.col("mode_num").cast("double").alias("v")),
        t["ERR"].select("flight_id", "timestamp_us", F.lit("ERR").alias("msg"), F.col("subsys_name").alias("name"), F.col("subsys").cast("double").alias("v")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _lookup(code, names, other):
    return f"CASE {code} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in names.items()) + f" ELSE {other} END"


def _dataflash_sql():
    from contrail.schema import ERR_SUBSYSTEMS, FLIGHT_MODES

    return f"""WITH {EV} SELECT CAST(user_id AS VARCHAR) AS flight_id, ts_us AS timestamp_us,
  CASE event_type WHEN 'error' THEN 'ERR' WHEN 'view' THEN 'MODE' ELSE 'BAT' END AS msg,
  CASE event_type WHEN 'error' THEN {_lookup('k % 30', ERR_SUBSYSTEMS, "'UNKNOWN'")} WHEN 'view' THEN {_lookup('k % 30', FLIGHT_MODES, "'UNKNOWN_' || (k % 30)")} END AS name,
  CASE event_type WHEN 'click' THEN round(CASE WHEN k > 50 THEN value + 1 ELSE value END, 4) ELSE k % 30 END AS v
FROM ev WHERE event_type IN ('error', 'view', 'click')"""


def ulog_tables(spark, sf):
    kind = F.when(F.col("event_type") == "error", "vehicle_gps_position").when(F.col("event_type") == "view", "battery_status").otherwise("vehicle_status")
    t = mapping.from_ulog(_raw(spark, sf, kind, {"timestamp": "ts_us", "lat": "k * 10000000", "alt": "k * 1000", "remaining": "k / 100e0", "nav_state": "k % 20"}),
                          ["vehicle_gps_position", "battery_status", "vehicle_status"])
    parts = [
        t["GPS"].select("flight_id", "timestamp_us", F.lit("GPS").alias("msg"), F.lit(None).cast("string").alias("name"), rounded(F.col("lat_deg") + F.col("alt_msl_m"), 6).alias("v")),
        t["BAT"].select("flight_id", "timestamp_us", F.lit("BAT").alias("msg"), F.lit(None).cast("string").alias("name"), rounded("remaining_pct", 6).alias("v")),
        t["MODE"].select("flight_id", "timestamp_us", F.lit("MODE").alias("msg"), F.col("mode_name").alias("name"), F.col("mode_num").cast("double").alias("v")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _ulog_sql():
    from contrail.schema import NAV_STATES

    return f"""WITH {EV} SELECT CAST(user_id AS VARCHAR) AS flight_id, ts_us AS timestamp_us, CASE event_type WHEN 'error' THEN 'GPS' WHEN 'view' THEN 'BAT' ELSE 'MODE' END AS msg,
  CASE WHEN event_type NOT IN ('error', 'view') THEN {_lookup('k % 20', NAV_STATES, "'UNKNOWN'")} END AS name,
  CASE event_type WHEN 'error' THEN 2.0 * k WHEN 'view' THEN k ELSE k % 20 END AS v FROM ev"""


def mavlink_tables(spark, sf):
    kind = F.when(F.col("event_type") == "error", "SYS_STATUS").when(F.col("event_type") == "view", "ATTITUDE").otherwise("GPS_RAW_INT")
    t = mapping.from_mavlink(_raw(spark, sf, kind, {"_timestamp": "floor(ts_us / 1000000)", "voltage_battery": "k * 100", "current_battery": "k", "roll": "k / 100e0", "eph": "k", "vel": "k * 10"}),
                             ["SYS_STATUS", "ATTITUDE", "GPS_RAW_INT"])
    parts = [
        t["BAT_SYS"].select("flight_id", "timestamp_us", F.lit("BAT_SYS").alias("msg"), rounded(F.col("voltage_v") + F.col("current_a"), 6).alias("v")),
        t["ATT"].select("flight_id", "timestamp_us", F.lit("ATT").alias("msg"), rounded("roll_deg", 6).alias("v")),
        t["GPS"].select("flight_id", "timestamp_us", F.lit("GPS").alias("msg"), rounded(F.col("hdop") + F.col("gnd_speed_m_s"), 6).alias("v")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_MAVLINK = f"""WITH {EV} SELECT CAST(user_id AS VARCHAR) AS flight_id, ts_us // 1000000 * 1000000 AS timestamp_us,
  CASE event_type WHEN 'error' THEN 'BAT_SYS' WHEN 'view' THEN 'ATT' ELSE 'GPS' END AS msg,
  round(CASE event_type WHEN 'error' THEN k * 0.1::DOUBLE + k * 0.01::DOUBLE WHEN 'view' THEN degrees(k / 100e0) ELSE k * 0.01::DOUBLE + k * 0.1::DOUBLE END, 6) AS v FROM ev"""


def channel_unpivot(spark, sf):
    e = events(spark, sf).where(F.col("ts_us").between(1_704_067_200_000_000 + 3 * DAY, 1_704_067_200_000_000 + 20 * DAY))
    return unpivot(e, ["user_id", "ts_us"], {"EV.value": "value", "EV.k": "k"})


def time_ranges(spark, sf):
    return events(spark, sf).groupBy("user_id", "event_type").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))


def adhoc_sql(spark, sf):
    events(spark, sf).createOrReplaceTempView("telemetry_events")
    return spark.sql("SELECT user_id, event_type, count(*) AS n, round(avg(value), 8) AS mean_value FROM telemetry_events WHERE k > 10 GROUP BY user_id, event_type HAVING count(*) > 5")


def channel_imbalance(spark, sf):
    names = ["click", "error", "purchase", "signup", "view"]
    g = events(spark, sf).groupBy("user_id").agg(*[F.avg(F.when(F.col("event_type") == n, F.col("value"))).alias(n) for n in names])
    long = unpivot(g, ["user_id"], {n: n for n in names}).where("value is not null")
    s = long.groupBy("user_id").agg((F.stddev_pop("value") / F.avg("value")).alias("cv"), F.max_by("channel", "value").alias("highest"), F.min_by("channel", "value").alias("lowest"))
    sev = F.when(F.col("cv") > 0.20, "CRITICAL").otherwise("WARNING")
    return s.where("cv > 0.10").select("user_id", rounded("cv").alias("cv"), "highest", "lowest", sev.alias("severity"))


_IMBALANCE = f"""WITH {EV}, m AS (SELECT user_id, event_type, avg(value) AS v FROM ev GROUP BY 1, 2),
s AS (SELECT user_id, stddev_pop(v) / avg(v) AS cv, arg_max(event_type, v) AS highest, arg_min(event_type, v) AS lowest FROM m GROUP BY 1)
SELECT user_id, round(cv, 8) AS cv, highest, lowest, CASE WHEN cv > 0.20 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM s WHERE cv > 0.10"""


def first_rows_per_key(spark, sf):
    return first_rows(events(spark, sf), ["user_id"], ["ts_us", "event_id"], 3).select("user_id", "event_id", "value")


QUERIES = [
    Query("anomaly_summary", anomaly_summary, f"""WITH {_ANOM} SELECT flight_id, 'category' AS dimension, category AS item, count(*) AS n FROM anom GROUP BY 1, 3
UNION ALL SELECT flight_id, 'severity', severity, count(*) FROM anom GROUP BY 1, 3"""),
    Query("anomaly_heads", anomaly_heads, _HEADS),
    Query("registry_dedupe", registry_dedupe, _DEDUPE),
    Query("findings_merge", findings_merge, f"""WITH {_ANOM} SELECT DISTINCT flight_id, rule_name, timestamp_us, severity FROM anom WHERE category = 'GPS' OR severity <> 'INFO'"""),
    Query("classify_guarded", classify_guarded, _CLASSIFY),
    Query("top_anchor", top_anchor, _ANCHOR),
    Query("causal_bounds", causal_bounds, _CAUSAL),
    Query("report_evidence", report_evidence, _EVIDENCE),
    Query("domain_matrix", domain_matrix, _MATRIX),
    Query("last_value_per_key", last_value_per_key, f"WITH {EV} SELECT user_id, event_type, arg_max(k, ts_us) AS k FROM ev GROUP BY 1, 2"),
    Query("flight_profile", flight_profile, f"""WITH {EV}, s AS (SELECT user_id, max(ts_us) - min(ts_us) AS span FROM ev GROUP BY 1)
SELECT CAST(user_id AS VARCHAR) AS flight_id, event_type, count(*) AS n, round(count(*) / (any_value(span) / 1e6), 12) AS rate_hz FROM ev JOIN s USING (user_id) GROUP BY 1, 2"""),
    Query("log_profile", log_profile, _LOG),
    Query("similar_topk", similar_topk, f"WITH {_SIM_OWN} SELECT query_id, id, round(score, 8) AS score, rank FROM t WHERE rank <= 5"),
    Query("baseline_deviation", baseline_deviation, _DEV),
    Query("class_metrics", class_metrics, _CLASS),
    Query("binary_rates", binary_rates, _BINARY),
    Query("confidence_calibration", confidence_calibration, _CALIB),
    Query("score_cases", score_cases, f"WITH {_SCORED} SELECT case_id, round(hits / 6, 8) AS score, hits = 6 AS passed FROM c"),
    Query("criteria_rates", criteria_rates, _CRIT),
    Query("benchmark_metrics", benchmark_metrics, _BENCH),
    Query("quota_windows", quota_windows, f"""WITH {EV} SELECT user_id, event_type, ts_us // {DAY} * {DAY} AS window_start_us, count(*) AS n FROM ev GROUP BY 1, 2, 3 HAVING count(*) > 2"""),
    Query("newest_page", newest_page, "SELECT o_orderkey, epoch_us(o_orderdate) AS day_us, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 10"),
    Query("latest_version", latest_version, """SELECT o_custkey, arg_max(o_orderkey, epoch_us(o_orderdate) / 1000000 * 1000000 + o_orderkey) AS o_orderkey,
arg_max(o_orderstatus, epoch_us(o_orderdate) / 1000000 * 1000000 + o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey"""),
    Query("record_tree", record_tree, """SELECT c_custkey, o_orderkey, n_lines FROM customer LEFT JOIN orders ON o_custkey = c_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"""),
    Query("cascade_delete", cascade_delete, """SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_orderkey NOT IN
(SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) GROUP BY 1"""),
    Query("duplicate_hash", duplicate_hash, "SELECT sha256(text) AS sha256, min(doc_id) AS first_id, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1"),
    Query("format_sniff", format_sniff, _SNIFF),
    Query("admission_checks", admission_checks, _ADMIT),
    Query("time_normalize", time_normalize, f"WITH {EV} SELECT event_id, CASE WHEN event_type = 'view' THEN ts_us ELSE ts_us // 1000000 * 1000000 END AS timestamp_us FROM ev"),
    Query("dataflash_tables", dataflash_tables, _dataflash_sql()),
    Query("ulog_tables", ulog_tables, _ulog_sql()),
    Query("mavlink_tables", mavlink_tables, _MAVLINK),
    Query("channel_unpivot", channel_unpivot, f"""WITH {EV}, r AS (SELECT * FROM ev WHERE ts_us BETWEEN {1_704_067_200_000_000 + 3 * DAY} AND {1_704_067_200_000_000 + 20 * DAY})
SELECT user_id, ts_us, 'EV.value' AS channel, value FROM r UNION ALL SELECT user_id, ts_us, 'EV.k', CAST(k AS DOUBLE) FROM r"""),
    Query("time_ranges", time_ranges, f"WITH {EV} SELECT user_id, event_type, min(ts_us) AS start_us, max(ts_us) AS end_us FROM ev GROUP BY 1, 2"),
    Query("adhoc_sql", adhoc_sql, f"WITH {EV} SELECT user_id, event_type, count(*) AS n, round(avg(value), 8) AS mean_value FROM ev WHERE k > 10 GROUP BY 1, 2 HAVING count(*) > 5"),
    Query("channel_imbalance", channel_imbalance, _IMBALANCE),
    Query("first_rows_per_key", first_rows_per_key, f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_us, event_id) AS rn FROM ev)
SELECT user_id, event_id, value FROM r WHERE rn <= 3"""),
]
