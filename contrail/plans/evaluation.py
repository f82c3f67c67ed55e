"""Score reports against expected outcomes and aggregate quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.functions.text import citation_ids

# Confidence ranks and exit thresholds.
CONFIDENCE_RANK = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "DEFINITIVE": 3}
MIN_ACCURACY, MAX_MISS_RATE = 0.80, 0.20


def confidence_rank(level: Column, missing: int) -> Column:
    listed = F.create_map(*[F.lit(x) for pair in CONFIDENCE_RANK.items() for x in pair])
    return F.coalesce(F.try_element_at(listed, level), F.lit(missing))


def score_cases(reports: DataFrame, specs: DataFrame) -> DataFrame:
    """Adds the criteria list, score and verdict of each case.

    ``reports``: case_id, classification, confidence_level, root_cause, rule_names array,
    contributing_factors array, errors array.  ``specs``: case_id and the expectations."""
    c, none = F.col, F.array().cast("array<string>")
    rows = specs.join(reports, "case_id")
    factors = F.coalesce("contributing_factors", none)
    cited = F.flatten(F.transform(factors, citation_ids))
    cause, text = F.lower(F.coalesce("root_cause", F.lit(""))), F.lower(F.array_join(factors, " "))
    fields = {n: F.coalesce(n, none) for n in ("required_rules", "keywords", "required_evidence", "forbidden_terms")}

    def criterion(name: str, passed: Column) -> Column:
        return F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"))

    def unless_empty(field: str, entry: Column) -> Column:
        return F.when(F.size(fields[field]) > 0, entry)

    criteria = F.array_compact(F.array(
        criterion("classification_match", c("classification") == c("expected_classification")),
        criterion("confidence_sufficient", confidence_rank(c("confidence_level"), -1) >= confidence_rank(c("min_confidence"), 0)),
        criterion("required_rules_present", F.size(F.array_except(fields["required_rules"], F.coalesce("rule_names", none))) == 0),
        unless_empty("keywords", criterion("root_cause_keyword_present", F.exists(fields["keywords"], lambda k: cause.contains(k)))),
        unless_empty("required_evidence", criterion("contributing_evidence_present", F.arrays_overlap(fields["required_evidence"], cited))),
        unless_empty("forbidden_terms", criterion("no_forbidden_terms", ~F.exists(fields["forbidden_terms"], lambda k: text.contains(F.lower(k))))),
    ))
    out = rows.withColumn("criteria", criteria)
    hits = F.size(F.filter("criteria", lambda x: x["passed"]))
    return out.withColumns({"score": hits / F.size("criteria"), "passed": hits == F.size("criteria")})


def class_metrics(df: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """tp / fp / fn, precision, recall and F1 per label.  Rows are counted per (expected, actual)
    pair first, so what is regrouped by label has at most labels-squared rows."""
    pairs = df.groupBy(expected.alias("e"), actual.alias("a")).agg(F.count(F.lit(1)).alias("n"))
    sides = F.when(F.col("e") == F.col("a"), F.array(_side("e", "tp"))).otherwise(F.array(_side("e", "fn"), _side("a", "fp")))
    rows = pairs.select("n", F.explode(sides).alias("s")).select("n", "s.*").where("label is not null")
    counts = rows.groupBy("label").agg(*[
        F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(k) for k in ("tp", "fp", "fn")
    ])
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return counts.withColumns({"precision": p, "recall": r}).withColumn(
        "f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def _side(column: str, kind: str) -> Column:
    return F.struct(F.col(column).alias("label"), F.lit(kind).alias("kind"))


def binary_rates(df: DataFrame, expected: Column, actual: Column) -> DataFrame:
    """Accuracy, false positive and false negative rate; a rate over nothing is 0."""
    hit = F.coalesce(actual, F.lit(False))

    def rate(num: Column, den: Column) -> Column:
        return F.coalesce(F.try_divide(F.count_if(num), F.count_if(den)), F.lit(0.0))

    return df.agg(
        F.count(F.lit(1)).alias("total_cases"), rate(expected == hit, F.lit(True)).alias("accuracy"),
        rate(~expected & hit, ~expected).alias("false_positive_rate"), rate(expected & ~hit, expected).alias("false_negative_rate"),
    )


def criteria_rates(scored: DataFrame) -> DataFrame:
    return scored.select(F.explode("criteria").alias("c")).groupBy(F.col("c.name").alias("criterion")).agg(
        F.avg(F.col("c.passed").cast("int")).alias("pass_rate"), F.count(F.lit(1)).alias("checked")
    )


def confidence_calibration(df: DataFrame, correct: Column, level: Column) -> DataFrame:
    """Mean confidence rank of right and wrong answers."""
    return df.groupBy(correct.alias("correct")).agg(
        F.avg(confidence_rank(level, 0)).alias("mean_confidence"), F.count(F.lit(1)).alias("n")
    )


def benchmark_metrics(scored: DataFrame, positive: str = "CRASH") -> DataFrame:
    """One row: accuracy, rates, calibration, fabricated evidence and the exit verdict."""
    want, got = F.col("expected_classification"), F.coalesce("classification", F.lit(""))
    correct, rank = want == got, confidence_rank(F.col("confidence_level"), 0)
    fabricated = F.exists("criteria", lambda c: (c["name"] == "required_rules_present") & ~c["passed"])

    def share(num: Column, den: Column | None = None) -> Column:
        den = F.count(F.lit(1)) if den is None else F.count_if(den)
        return F.coalesce(F.try_divide(F.count_if(num), den), F.lit(0.0))

    m = scored.agg(
        F.count(F.lit(1)).alias("total_cases"), F.count_if("passed").alias("passed_cases"), F.count_if(~F.col("passed")).alias("failed_cases"),
        F.count_if(F.size("errors") > 0).alias("error_cases"), F.count_if(correct).alias("classification_correct"),
        share(correct).alias("classification_accuracy"),
        share((want != positive) & (got == positive), want != positive).alias("false_positive_rate"),
        share((want == positive) & (got != positive), want == positive).alias("false_negative_rate"),
        share(fabricated).alias("fabricated_evidence_rate"), share(F.col("passed")).alias("overall_pass_rate"),
        F.coalesce(F.avg(F.when(correct, rank)), F.lit(0.0)).alias("mean_conf_correct"),
        F.coalesce(F.avg(F.when(~correct, rank)), F.lit(0.0)).alias("mean_conf_incorrect"),
    )
    failures = F.array_compact(F.array(
        F.when(F.col("classification_accuracy") < MIN_ACCURACY, "classification_accuracy"),
        F.when(F.col("fabricated_evidence_rate") > 0, "fabricated_evidence_rate"),
        F.when(F.col("false_negative_rate") > MAX_MISS_RATE, "false_negative_rate"),
    ))
    return m.withColumn("failures", failures).withColumn("passes_exit_criteria", F.size("failures") == 0)
