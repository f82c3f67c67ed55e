"""The named queries of this subpackage over the test tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm import automaton, id_files, langid, merkle, packing, quality, simhash, token_counts, topk, toxicity, trie, warc
from contrail.llm.chat_query import CHAT_SQL, op10_chat_formatting
from contrail.llm.common import fresh_path, load
from contrail.llm.tree_sql import MERKLE_SQL, TRIE_SQL

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def op1_bpe_automaton(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path(WORD_BPE)
    docs = load(spark, sf, "documents").select("doc_id", "text")
    decoded = automaton.bpe_decode(automaton.bpe_encode(docs, path).drop("text"), path)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_simhash(spark: SparkSession, sf: str) -> DataFrame:
    groups = simhash.simhash_groups(load(spark, sf, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    counted = token_counts.count_tokens(load(spark, sf, "documents"), public_tokenizers.path(BYTE_BPE), fresh_path(spark, "token-counts"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op4_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    packed = packing.pack(load(spark, sf, "documents"), public_tokenizers.path(BYTE_BPE), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_top_k(spark: SparkSession, sf: str) -> DataFrame:
    return topk.top_k(load(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, load(spark, sf, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_id_files(spark: SparkSession, sf: str) -> DataFrame:
    return id_files.round_trip(load(spark, sf, "documents"), public_tokenizers.path(WORD_BPE))


def op8_quality_bands(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.quality(load(spark, sf, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.round_trip(load(spark, sf, "pages")).drop("payload")


def op11_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op12_merkle(spark: SparkSession, sf: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = merkle.manifest_rows(load(spark, sf, "documents"), tampered)
    return rows.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", "verified")


def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    head = F.crc32(F.col("c").cast("string").cast("binary")) % 4
    return trie.prefix_trie(load(spark, sf, "conversations"), F.col("c") - F.col("c") % 20, head)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_bpe_automaton, op2_simhash, op3_token_counts, op4_best_fit_packing, op5_top_k, op6_toxicity, op7_id_files, op8_quality_bands,
                              op9_warc, op10_chat_formatting, op11_language_id, op12_merkle, op13_prefix_trie)
}
TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, CASE WHEN strlen(html) >= {warc.REVISIT_BYTES} THEN min(page_id) OVER (PARTITION BY html) ELSE page_id END AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest,
    CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first < page_id THEN first END AS refers_to FROM m
"""

SQL: dict[str, str] = {"op5_top_k": TOP_K_SQL, "op9_warc": WARC_SQL, "op10_chat_formatting": CHAT_SQL, "op12_merkle": MERKLE_SQL, "op13_prefix_trie": TRIE_SQL}
