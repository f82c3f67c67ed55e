"""Token counts of whole texts through a cache of counts by content.

A count is stored under two digests: of the text and of the tokenizer file, so a new tokenizer version
never meets old counts.  A run looks up the distinct digests of its texts, encodes one text of each
missing digest, appends those counts to the cache and joins the counts back.

Texts are compared byte by byte; the only normalisation is that null is the empty text, since any other
could change a count.  Copies are found by digest with map-side aggregation, so a group of copies that
holds a third of all rows adds one row per task to the shuffle.  An empty table gives no rows; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm.common import column_values, map_batches, materialise, text_or_empty
from contrail.llm.pieces import text_encoder

CACHE_SCHEMA = "tokenizer binary, digest binary, n_tokens bigint"


def tokenizer_digest(path: str) -> bytes:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


def content_digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(text_or_empty(text), 256))


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """digest, n_tokens of this tokenizer; no rows where the cache has not been begun."""
    try:
        table = spark.read.schema(CACHE_SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        table = spark.createDataFrame([], CACHE_SCHEMA)
    # Two runs may have added the same text at the same time; their counts are equal.
    return table.where(F.col("tokenizer") == F.lit(tokenizer_digest(tokenizer))).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))


def add_missing(docs: DataFrame, tokenizer: str, cache: str, doc_id: str = "doc_id", text: str = "text") -> None:
    """Encode one text of each digest that the cache lacks and append the counts."""
    spark = docs.sparkSession
    # (digest, id) of one document of each missing text; ids and digests only go through this shuffle.
    chosen = (
        docs.select(content_digest(text).alias("digest"), F.col(doc_id).alias("id"))
        .groupBy("digest").agg(F.min("id").alias("id"))
        .join(read_cache(spark, cache, tokenizer).select("digest"), "digest", "left_anti")
    )
    texts = docs.select(content_digest(text).alias("digest"), F.col(doc_id).alias("id"), text_or_empty(text).alias("text"))
    # The id keeps copies apart: only the chosen document of a text meets its row.
    same = texts["id"].eqNullSafe(chosen["id"]) & (texts["digest"] == chosen["digest"])
    misses = texts.join(chosen, same, "left_semi").select("digest", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = text_encoder(tokenizer), set()
        for batch in batches:
            pairs = dict(zip(column_values(batch, "digest"), column_values(batch, "text")))
            new = {d: t for d, t in pairs.items() if d not in seen}  # rows that repeat id and text
            seen.update(new) if len(seen) < 100_000 else seen.clear()
            counts = encoder.counts(list(new.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(new), pa.binary()), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    counted = map_batches(misses, count, "digest binary, n_tokens bigint")
    counted.select(F.lit(tokenizer_digest(tokenizer)).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens of every document; the cache at ``cache`` grows by the texts it lacked."""
    add_missing(docs, tokenizer, cache, doc_id, text)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), content_digest(text).alias("digest"),
                        F.octet_length(text_or_empty(text)).cast("long").alias("n_bytes"))
    stored = materialise(read_cache(docs.sparkSession, cache, tokenizer), "token-counts-stored")
    # Many documents may share one digest: an own exchange on both sides lets the engine split a hot one.
    return keyed.join(stored.hint("merge"), "digest", "left").select("doc_id", "n_bytes", "n_tokens")
