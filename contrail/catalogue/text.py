"""Queries on claims in documents and conversations, over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from contrail.catalogue.base import Query, load
from contrail.functions import text as tx
from contrail.plans import grounding

# Languages stand in for subsystems: common words claim one, documents labelled good back it.
LANGUAGES = {
    "ENGLISH": (["the", "with", "of the"], ["en"]), "FRENCH": (["avec", "le", "de la"], ["fr"]),
    "GERMAN": (["der", "und", "in der"], ["de"]), "SPANISH": (["el", "los", "de los"], ["es"]),
}
_WORD = r"[\p{L}\p{N}_]"


def _mention(column, kw):
    if " " in kw:
        return f"contains({column}, '{kw}')"
    return f"regexp_matches({column}, '(^|[^\\p{{L}}\\p{{N}}_]){kw}($|[^\\p{{L}}\\p{{N}}_])')"


def _first(column, keywords):
    return "CASE " + " ".join(f"WHEN {_mention(column, k)} THEN '{k}'" for k in sorted(keywords)) + " END"


def _claims_sql(src, keep, column="text"):
    return " UNION ALL ".join(
        f"SELECT {keep}, '{d}' AS domain, {_first(f'lower({column})', kws)} AS keyword FROM {src} WHERE {_first(f'lower({column})', kws)} IS NOT NULL"
        for d, (kws, _) in LANGUAGES.items())


GOOD = 4  # documents of a language that back it for a source
_BACKED = f"""i AS (SELECT source, lang FROM labels JOIN documents USING (doc_id) WHERE quality = 1 AND toxic = 0 GROUP BY 1, 2 HAVING count(*) >= {GOOD}),
k(prefix, domain) AS (VALUES ('en', 'ENGLISH'), ('fr', 'FRENCH'), ('de', 'GERMAN'), ('es', 'SPANISH')),
b AS (SELECT DISTINCT source, domain FROM i JOIN k ON starts_with(lang, prefix))"""


def _evidence(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "source", "lang")
    good = load(spark, sf, "labels").where("quality = 1 and toxic = 0").join(docs, "doc_id")
    return good.groupBy("source", F.col("lang").alias("evidence_id")).count().where(F.col("count") >= GOOD).drop("count")


def keyword_claims(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text")
    return grounding.text_claims(d, "text", LANGUAGES).select("doc_id", "domain", "keyword")


def keyword_table_claims(spark, sf):
    """The opening words of each benchmark item and the words of the languages, as one table of keywords."""
    items = load(spark, sf, "benchmark").select(
        F.concat(F.lit("item "), F.col("item_id")).alias("domain"), F.lower(F.substring_index("text", " ", 3)).alias("keyword"))
    common = spark.createDataFrame([(n, k) for n, (kws, _) in LANGUAGES.items() for k in kws], "domain string, keyword string")
    d = load(spark, sf, "documents").select("doc_id", "text")
    return grounding.text_claims(d, "text", items.unionByName(common)).select("doc_id", "domain", "keyword")


_TABLE_CLAIMS = f"""WITH c AS ({_claims_sql('documents', 'doc_id')}),
i AS (SELECT 'item ' || item_id AS domain, lower(array_to_string(string_split(text, ' ')[1:3], ' ')) AS keyword FROM benchmark)
SELECT * FROM c UNION ALL SELECT doc_id, domain, keyword FROM (SELECT doc_id, lower(text) AS t FROM documents) JOIN i ON contains(t, keyword)"""


def turn_claims(spark, sf):
    c = load(spark, sf, "conversations").select("conv_id", "turn", "text")
    return grounding.text_claims(c, "text", LANGUAGES).select("conv_id", "turn", "domain", "keyword")


def evidence_domains(spark, sf):
    return grounding.evidence_domains(_evidence(spark, sf), "source", LANGUAGES)


def unbacked_claims(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("claim"))
    w = grounding.claim_warnings(d, _evidence(spark, sf), "claim", "source", LANGUAGES)
    return w.select("doc_id", "source", "domain", "keyword", "warning")


_UNBACKED = f"""WITH {_BACKED}, c AS ({_claims_sql('documents', 'doc_id, source')})
SELECT doc_id, source, domain, keyword, 'speaks of ' || prefix || ', for which this flight has no evidence' AS warning
FROM c JOIN k USING (domain) WHERE (source, domain) NOT IN (SELECT (source, domain) FROM b)"""


def factor_check(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", F.col("text").alias("factor"), F.array("source", "lang").alias("supporting_evidence"))
    return grounding.check_factors(d, LANGUAGES).select("doc_id", "admissible", "reason")


def _reasons(docs, evidence_ok, cited):
    return ", ".join(
        f"CASE WHEN {_first('lower(text)', kws)} IS NOT NULL AND NOT ({evidence_ok(p[0])}) THEN 'speaks of {p[0]}, which none of its evidence (' || {cited} || ') supports' END"
        for kws, p in LANGUAGES.values())


_FACTOR = f"""WITH r AS (SELECT doc_id, concat_ws('; ', {_reasons('documents', lambda p: f"starts_with(source, '{p}') OR starts_with(lang, '{p}')", "source || ', ' || lang")}) AS r,
  {' OR '.join(f"{_first('lower(text)', kws)} IS NOT NULL" for kws, _ in LANGUAGES.values())} AS claimed FROM documents)
SELECT doc_id, r = '' AS admissible, CASE WHEN NOT claimed THEN 'no known subject' WHEN r = '' THEN 'ok' ELSE r END AS reason FROM r"""


def factor_split(spark, sf):
    d = load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("factor_id"), "source", F.col("text").alias("factor"),
                                            F.array("lang", F.lit("made_up"), F.lit("en")).alias("supporting_evidence"))
    s = grounding.split_factors(d, _evidence(spark, sf), "source", domains=LANGUAGES)
    return s.select("factor_id", "grounded", "rejected_because", F.array_join("supporting_evidence", ",").alias("evidence"), F.length("factor").alias("factor_chars"))


_SPLIT = f"""WITH {_BACKED}, d AS (SELECT *, (source, lang) IN (SELECT (source, lang) FROM i) AS own, (source, 'en') IN (SELECT (source, lang) FROM i) AS en FROM documents),
m AS (SELECT *, concat_ws(', ', CASE WHEN own THEN lang END, CASE WHEN en THEN 'en' END) AS cited FROM d),
r AS (SELECT *, concat_ws('; ', {_reasons('m', lambda p: f"(own AND starts_with(lang, '{p}')) OR (en AND 'en' = '{p}')", 'cited')}) AS why FROM m)
SELECT CAST(doc_id AS VARCHAR) AS factor_id, cited <> '' AND why = '' AS grounded, CASE WHEN cited = '' THEN 'evidence' WHEN why <> '' THEN 'domain' END AS rejected_because,
  CASE WHEN cited = '' THEN lang || ',made_up,en' ELSE replace(cited, ', ', ',') END AS evidence,
  length(text) + CASE WHEN cited <> '' AND why <> '' THEN length(' [unsupported: ' || why || ']') ELSE 0 END AS factor_chars FROM r"""


def citation_ids(spark, sf):
    d = load(spark, sf, "documents")
    cited = F.concat(F.col("text"), F.lit(" [evidence: "), F.col("source"), F.lit(" ,"), F.col("lang"), F.lit("] (HIGH)"))
    return d.select("doc_id", F.explode(tx.citation_ids(cited)).alias("evidence_id"))


def strip_citations(spark, sf):
    d = load(spark, sf, "documents")
    cited = F.concat(F.col("text"), F.lit("  [evidence: "), F.col("source"), F.lit("] "), F.col("lang"))
    return d.select("doc_id", F.md5(tx.strip_citations(cited)).alias("clean"))


def narrative_violations(spark, sf):
    r = load(spark, sf, "documents").select("doc_id", "source", "text")
    backed = grounding.evidence_domains(_evidence(spark, sf), "source", LANGUAGES)
    v = grounding.narrative_violations(r, backed, "source", ("text",), LANGUAGES)
    return v.groupBy("source", "domain", "keyword").agg(F.count(F.lit(1)).alias("n"), F.sum("position").cast("long").alias("positions"))


_NARR = f"""WITH {_BACKED}, c AS ({_claims_sql('documents', 'source, text')})
SELECT source, domain, keyword, count(*) AS n, CAST(sum(strpos(lower(text), keyword)) AS BIGINT) AS positions FROM c WHERE (source, domain) NOT IN (SELECT (source, domain) FROM b) GROUP BY 1, 2, 3"""


def narrative_gate(spark, sf):
    d = load(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("report"), F.col("text").alias("executive_summary"), F.lit("").alias("causal_chain"), F.col("source").alias("root_cause_determination"),
        F.array(F.concat("source", F.lit(" [evidence: A] (HIGH)"))).alias("contributing_factors"), F.lit("ANOMALY").alias("classification"), F.lit("HIGH").alias("confidence_level"), "source", "lang")
    ev = d.where("lang <> 'fr'").select("report", F.col("lang").alias("evidence_id"))
    g = grounding.narrative_gate(d, ev, "report", LANGUAGES)
    return g.select("report", "narrative_valid", F.array_join("allowed_domains", ",").alias("allowed"), F.md5("executive_summary").alias("summary"), F.size("violations").alias("n_violations"))


_GATE = f"""WITH k(lang, domain) AS (VALUES ('en', 'ENGLISH'), ('de', 'GERMAN'), ('es', 'SPANISH')), c AS ({_claims_sql('documents', 'doc_id, lang')}),
v AS (SELECT c.doc_id, count(*) AS n FROM c LEFT JOIN k USING (lang, domain) WHERE k.domain IS NULL GROUP BY 1),
a AS (SELECT d.*, n, coalesce(k.domain, '') AS allowed FROM documents d LEFT JOIN v USING (doc_id) LEFT JOIN k USING (lang))
SELECT CAST(doc_id AS VARCHAR) AS report, n IS NULL AS narrative_valid, allowed, md5(CASE WHEN n IS NULL THEN text ELSE 'ANOMALY, confidence HIGH: ' || source || '. With it: ' || source ||
  ' (HIGH). Evidence covers: ' || CASE WHEN allowed = '' THEN 'nothing' ELSE allowed END || '.' END) AS summary, CAST(n AS INT) AS n_violations FROM a"""

QUERIES = [
    Query("keyword_claims", keyword_claims, f"WITH c AS ({_claims_sql('documents', 'doc_id')}) SELECT * FROM c"),
    Query("keyword_table_claims", keyword_table_claims, _TABLE_CLAIMS),
    Query("turn_claims", turn_claims, f"WITH c AS ({_claims_sql('conversations', 'conv_id, turn')}) SELECT * FROM c"),
    Query("evidence_domains", evidence_domains, f"WITH {_BACKED} SELECT * FROM b"),
    Query("unbacked_claims", unbacked_claims, _UNBACKED),
    Query("factor_check", factor_check, _FACTOR),
    Query("factor_split", factor_split, _SPLIT),
    Query("citation_ids", citation_ids, "SELECT doc_id, unnest([source, lang]) AS evidence_id FROM documents"),
    Query("strip_citations", strip_citations, r"""SELECT doc_id, md5(regexp_replace(regexp_replace(text || '  [evidence: ' || source || '] ' || lang, '\s*\[evidence:[^\]]+\]', '', 'g'), '^\s+|\s+$', '', 'g')) AS clean FROM documents"""),
    Query("narrative_violations", narrative_violations, _NARR),
    Query("narrative_gate", narrative_gate, _GATE),
]
