"""Token ids of a corpus as binary files: one concatenated id array, boundaries in Elias-Fano form.

File: magic, the ids (16 or 32 bits each, little endian), a footer, the footer's length (32 bits), magic.
The footer holds the counts and two non-decreasing sequences, the documents' ends in the array and their
doc_ids, each in about 2 + log2(universe / documents) bits a value: low bits packed, high bits as a unary
bit string, and the place of every 64th one as a 32-bit number, from which ``select`` finds any value.

Documents lie in ascending doc_id order within and across the files (nulls first; rows that repeat a
doc_id in any order).  A file is a range of doc_ids between sampled bounds; an id that fills several ranges
is dealt over all of them.  Null texts are empty, and every document has its end id.  Tasks write under new
names and the manifest, a written table, lists those of the attempts that counted, so a lost executor leaves
at most an unlisted file.  Other columns are not read; an empty table makes no file.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from contrail.llm.common import column_values, fresh_path, map_batches, materialise, open_folder, text_or_empty
from contrail.llm.pieces import text_encoder

MAGIC = b"IDSEF1\r\n"
SAMPLE = 64  # ones between two samples
READ_DOCS = 500  # documents between two selected places when a file is read in order
SHARD_BYTES = 256 << 20  # text bytes a file is made for where the session does not ask for more files


class EliasFano:
    """A non-decreasing sequence of non-negative integers."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        n = len(values)
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(low_bits)) & 1).astype(np.uint8)
        places = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        bits[places] = 1
        pack = lambda x: np.packbits(x, bitorder="little").tobytes()
        return cls(n, low_bits, pack(low.ravel()), pack(bits), places[::SAMPLE].astype("<u4"))

    def _place(self, k: int) -> int:
        """Where the k-th one stands in the unary part: from the nearest sample on, a short scan."""
        byte, bit = divmod(int(self.samples[k // SAMPLE]), 8)
        rest = k % SAMPLE
        view = np.frombuffer(self.high, np.uint8)
        while True:
            ones = np.flatnonzero(np.unpackbits(view[byte : byte + 64], bitorder="little"))
            ones = ones[ones >= bit]
            if rest < len(ones):
                return byte * 8 + int(ones[rest])
            rest, byte, bit = rest - len(ones), byte + 64, 0

    def select(self, k: int) -> int:
        """The value at place k."""
        a = k * self.low_bits
        word = int.from_bytes(self.low[a // 8 : (a + self.low_bits + 7) // 8], "little") >> (a % 8)
        return (self._place(k) - k) << self.low_bits | word & ((1 << self.low_bits) - 1)

    def values(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """The values from place ``first`` to before ``last``: both edges are selected, and only the unary and low
        bits between them are decoded."""
        last = self.n if last is None else min(last, self.n)
        if first >= last:
            return np.zeros(0, np.int64)
        start, end = self._place(first), self._place(last - 1)
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8)[start // 8 : end // 8 + 1], bitorder="little")
        places = np.flatnonzero(bits[start % 8 : end - start // 8 * 8 + 1]) + start
        a, b = first * self.low_bits, last * self.low_bits
        low = np.unpackbits(np.frombuffer(self.low, np.uint8)[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a]
        low = low.reshape(last - first, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return ((places - np.arange(first, last)) << self.low_bits) + low

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high)], "<u4").tobytes()
        return head + self.low + self.high + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[EliasFano, bytes]:
        """The sequence at the start of ``raw`` and the rest."""
        n, low_bits, a, b = np.frombuffer(raw, "<u4", 4).tolist()
        end = 16 + a + b + 4 * (-(-n // SAMPLE))
        return cls(n, low_bits, raw[16 : 16 + a], raw[16 + a : 16 + a + b], np.frombuffer(raw[16 + a + b : end], "<u4")), raw[end:]


def write_file(stream, documents: Iterator[tuple[int | None, bytes]], width: int) -> tuple[int, int]:
    """Write (doc_id, ids) in order; ids are passed on as they come.  Returns documents and ids written."""
    stream.write(MAGIC)
    ends, keys, nulls, at = [], [], 0, 0
    for key, raw in documents:
        stream.write(raw)
        at += len(raw) // width
        ends.append(at)
        nulls += key is None
        keys += [] if key is None else [key]
    base = keys[0] if keys else 0
    footer = np.array([width, nulls], "<u4").tobytes() + np.array([base], "<i8").tobytes()
    footer += EliasFano.build(np.array(ends, np.int64)).to_bytes() + EliasFano.build(np.array(keys, np.int64) - base).to_bytes()
    stream.write(footer + len(footer).to_bytes(4, "little") + MAGIC)
    return len(ends), at


class IdFile:
    """An open file: documents by place, without reading the others."""

    def __init__(self, stream, size: int):
        self.stream = stream
        stream.seek(size - 12)
        tail = stream.read(12)
        if tail[4:] != MAGIC:
            raise ValueError("not an id file, or cut off")
        length = int.from_bytes(tail[:4], "little")
        stream.seek(size - 12 - length)
        raw = stream.read(length)
        self.width, self.nulls = np.frombuffer(raw, "<u4", 2).tolist()
        self.base = int(np.frombuffer(raw[8:16], "<i8")[0])
        self.ends, raw = EliasFano.from_bytes(raw[16:])
        self.keys, _ = EliasFano.from_bytes(raw)

    def __len__(self) -> int:
        return self.ends.n

    def doc_ids(self, first: int, last: int) -> list[int | None]:
        """The doc_ids from one document's place to another's."""
        known = self.keys.values(max(first - self.nulls, 0), max(last - self.nulls, 0))
        return [None] * (last - first - len(known)) + (self.base + known).tolist()

    def doc_id(self, k: int) -> int | None:
        return None if k < self.nulls else self.base + self.keys.select(k - self.nulls)

    def span(self, k: int) -> tuple[int, int]:
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def ids(self, first: int, last: int) -> np.ndarray:
        """Ids from one place of the array to another."""
        self.stream.seek(len(MAGIC) + first * self.width)
        return np.frombuffer(self.stream.read((last - first) * self.width), f"<u{self.width}")


def write_ids(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the files below ``folder``; the manifest: shard, path, n_docs, n_ids."""
    spark = docs.sparkSession
    kept = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    total = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD_BYTES))
    quantiles = [i / shards for i in range(1, shards)] or [0.5]
    bounds = np.array(kept.agg(F.percentile_approx("doc_id", quantiles, 100 * shards)).first()[0] or [], np.int64)
    width = 2 if text_encoder(tokenizer).tokenizer.get_vocab_size() <= 65_536 and end_id < 65_536 else 4

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = text_encoder(tokenizer), np.asarray([end_id], f"<u{width}").tobytes()
        for batch in batches:
            keys = column_values(batch, "doc_id")
            raw = [np.frombuffer(b, "<u4").astype(f"<u{width}").tobytes() + end for b in encoder.ids(column_values(batch, "text"))]
            known = np.array([-(2**63) if k is None else k for k in keys], np.int64)
            low, high = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
            spread = np.array([zlib.crc32(b) for b in raw], np.int64) % (high - low + 1)
            yield pa.RecordBatch.from_arrays([pa.array(low + spread, pa.int32()), pa.array(keys, pa.int64()), pa.array(raw, pa.binary())],
                                             names=["shard", "doc_id", "ids"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        rows = (r for b in batches for r in zip(*(column_values(b, c) for c in ("shard", "doc_id", "ids"))))
        for shard, group in groupby(rows, key=lambda r: r[0]):
            name = f"{root}/shard-{shard:07d}-{uuid.uuid4().hex}.ids"
            with fs.open_output_stream(name) as stream:
                n_docs, n_ids = write_file(stream, ((k, raw) for _, k, raw in group), width)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [name], "n_docs": [n_docs], "n_ids": [n_ids]})

    encoded = map_batches(kept, encode, "shard int, doc_id bigint, ids binary")
    ordered = encoded.repartitionById(shards, "shard").sortWithinPartitions("shard", "doc_id")
    return materialise(map_batches(ordered, write, "shard int, path string, n_docs bigint, n_ids bigint"), "id-manifest")


def read_ids(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, start counting over all files."""
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    files = manifest.select("path", "n_docs", "n_ids", F.coalesce(before, F.lit(0)).alias("base"), "shard")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        for path, n_docs, n_ids, base in (r for b in batches for r in zip(*(column_values(b, c) for c in ("path", "n_docs", "n_ids", "base")))):
            with fs.open_input_file(path) as stream:
                file = IdFile(stream, stream.size())
                if len(file) != n_docs or file.ends.select(n_docs - 1) != n_ids:
                    raise ValueError(f"{path} does not hold what its manifest says")
                start = 0
                for a in range(0, n_docs, READ_DOCS):
                    b = min(a + READ_DOCS, n_docs)
                    ends = file.ends.values(a, b)
                    starts = np.append(start, ends[:-1])
                    ids = file.ids(start, int(ends[-1])).astype("<u4")
                    crc = [zlib.crc32(ids[s:e]) for s, e in zip(starts - start, ends - start)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(file.doc_ids(a, b), pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start = int(ends[-1])

    return map_batches(files.repartitionById(n, F.col("shard") % n), read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write the files to a new place in the shared folder and read them again."""
    folder = fresh_path(docs.sparkSession, "id-files")
    return read_ids(docs.sparkSession, write_ids(docs, tokenizer, folder, end_id), folder)
