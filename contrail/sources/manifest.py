"""Log files: format, hash, duplicates and admission."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER_BYTES = 32
CHUNK = 1 << 20
MAX_NAME = 255
# Extension -> format, and extension -> accepted leading bytes (hex).
EXTENSION_FORMATS = {
    "bin": "ardupilot_bin", "ulog": "px4_ulog", "ulg": "px4_ulog", "tlog": "mavlink_tlog", "csv": "csv", "json": "json",
}
ALLOWED_EXTENSIONS = ["bin", "ulg", "ulog", "tlog", "csv", "json"]
MAGIC = {"bin": ["A395"], "ulg": ["554C6F6701"], "ulog": ["554C6F6701"], "json": ["7B", "5B"]}


def _read_heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """First bytes and SHA-256 of each file, streamed in 1 MiB chunks on any file system."""
    from pyarrow import fs

    for pdf in frames:
        heads, sums = [], []
        for path in pdf["path"]:
            uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
            system, name = fs.FileSystem.from_uri(uri)
            digest, head = hashlib.sha256(), b""
            with system.open_input_stream(name) as f:
                while chunk := f.read(CHUNK):
                    head = head or bytes(chunk[:HEADER_BYTES])
                    digest.update(chunk)
            heads.append(head)
            sums.append(digest.hexdigest())
        yield pdf.assign(header=heads, sha256=sums)


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, header, sha256, filename, extension, format) for every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    read = files.mapInPandas(_read_heads, "path string, length long, header binary, sha256 string")
    name = F.element_at(F.split("path", "/"), -1)
    return read.withColumns({"filename": name, "extension": extension(name)}).withColumn(
        "format", detect_format(F.col("header"), F.col("extension"))
    )


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))


def detect_format(header: Column, ext: Column) -> Column:
    """By leading bytes, then by extension; telemetry streams may start with an 8-byte time."""
    hexed, text = F.hex(header), header.cast("string")
    by_name = F.create_map(*[F.lit(x) for pair in EXTENSION_FORMATS.items() for x in pair])
    stream = ["FE", "FD"]
    timed = F.substring(hexed, 17, 2).isin(stream) & (F.substring(hexed, 1, 8) != "554C6F67") & (ext == "tlog")
    return (
        F.when(hexed.startswith("A395"), "ardupilot_bin")
        .when(hexed.startswith("554C6F6701"), "px4_ulog")
        .when(F.substring(hexed, 1, 2).isin(stream) | timed, "mavlink_tlog")
        .when(text.contains(",") & ~text.startswith("{"), "csv")
        .when(F.ltrim(text).rlike(r"^[{\[]"), "json")
        .otherwise(F.coalesce(F.try_element_at(by_name, ext), F.lit("ardupilot_bin")))
    )


def reject_reason(max_bytes: int) -> Column:
    """NULL when the file may be taken in, else the first failed check."""
    name, ext, size, hexed = F.col("filename"), F.col("extension"), F.col("length"), F.hex("header")
    wrong = F.lit(False)
    for e, prefixes in MAGIC.items():
        ok = F.lit(False)
        for p in prefixes:
            ok = ok | hexed.startswith(p)
        wrong = wrong | ((ext == e) & ~ok)
    return (
        F.when(~name.rlike(r"^[\w\-. ]+$"), "unsafe filename").when(F.length(name) > MAX_NAME, "filename too long")
        .when(~ext.isin(ALLOWED_EXTENSIONS), "unsupported extension").when(size <= 0, "empty file")
        .when(size > max_bytes, "file too large").when(wrong, "header does not match extension")
    )


def admit(manifest: DataFrame, max_bytes: int, catalog: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected).  Copies, inside the batch or of catalogued files, are rejected."""
    checked = manifest.withColumn("reject_reason", reject_reason(max_bytes))
    bad, good = checked.where("reject_reason is not null"), checked.where("reject_reason is null")
    # the first path of each hash stays; computed as an aggregate so copies collapse early
    firsts = good.groupBy("sha256").agg(F.min("path").alias("path"))
    if catalog is not None:
        firsts = firsts.join(catalog.select("sha256").distinct(), "sha256", "left_anti")
    fresh = good.join(firsts, ["sha256", "path"], "left_semi")
    copies = good.join(firsts, ["sha256", "path"], "left_anti").withColumn("reject_reason", F.lit("duplicate"))
    return fresh.drop("reject_reason"), bad.unionByName(copies)
