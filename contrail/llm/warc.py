"""WARC archives: writing pages as records, and reading records back by boundary-chain verification.

Records are plain (not compressed), so a reader can begin anywhere: every task scans its byte range of a
file for record heads and emits candidate -> successor offsets, the successor being where the head's
Content-Length says the record ends.  A payload may itself contain heads (a page about archives, an archive
stored as a page), so candidates prove nothing.  Pointer jumping from offset 0 of each file, with jumps that
double in length every round, keeps exactly the candidates that the chain of records reaches.

Of pages with equal payloads of at least 100 bytes the one with the smallest page_id is a response and the
others are revisits without payload; rows that repeat its page_id are responses too.  Null html is an empty
payload.  Rows with a null page_id are written as responses and come back with a null page_id.  Empty tables
make no file.  A head may be of any length.  A file that gives other than the records its manifest counts, such as
one that is cut off, is an error.  Tasks write under new names, and the
manifest (a written table) lists the files of the attempts that counted.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from contrail.llm.common import column_values, fresh_path, map_batches, materialise, open_folder
from contrail.session import broadcast_if_small

VERSION = b"WARC/1.1\r\n"
END = b"\r\n\r\n"
REVISIT_BYTES = 100
FILE_BYTES, SPLIT_BYTES, HEAD_BYTES = 64 << 20, 8 << 20, 16_384
TASK_BYTES = 256 << 20  # most bytes a task reads on average
PLACES = 1 << 38  # more than a file's bytes, and a multiple of SPLIT_BYTES
_LINES = re.compile(rb"(?:[A-Za-z-]+:[^\n]*\n)*")
_CUT = re.compile(rb"\r?|[A-Za-z-]+(?::[^\n]*)?")  # what a head's last line may look like where reading stopped
_FIELD = re.compile(rb"^([A-Za-z-]+):[ \t]*(.*?)[ \t]*$", re.M)
ROW_FIELDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


# -- writing -----------------------------------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind, block = ("response", payload) if refers_to is None else ("revisit", b"")
    name = "none" if page_id is None else str(page_id)
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url or ""),
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return VERSION + "\r\n".join(head).encode("utf-8", "replace") + END + block + END


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write all pages below ``folder``; the manifest: path, size, n_records."""
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"),
                        F.sha2(payload, 256).alias("digest"))
    # Payloads stay where they are: only ids and digests are compared, with a row per task and digest in the shuffle.
    keys = rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("page_id", "digest").where("page_id IS NOT NULL")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = broadcast_if_small(materialise(firsts, "warc-firsts"))
    marked = rows.join(firsts, "digest", "left").withColumn("refers_to", F.when(F.col("first") < F.col("page_id"), F.col("first")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        path, stream, size, n = "", None, 0, 0
        done = []
        for batch in batches:
            for row in zip(*(column_values(batch, c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                if stream is None:
                    path, size, n = f"{root}/pages-{uuid.uuid4().hex}.warc", 0, 0
                    stream = fs.open_output_stream(path)
                raw = record(*row)
                stream.write(raw)
                size, n = size + len(raw), n + 1
                if size >= FILE_BYTES:
                    stream.close()
                    done.append((path, size, n))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((path, size, n))
        yield pa.RecordBatch.from_pydict({"path": pa.array([d[0] for d in done], pa.string()), "size": pa.array([d[1] for d in done], pa.int64()),
                                          "n_records": pa.array([d[2] for d in done], pa.int64())})

    return materialise(map_batches(marked, write, "path string, size bigint, n_records bigint"), "warc-manifest")


# -- reading -----------------------------------------------------------------------------------------


def parse_head(raw: bytes) -> tuple[dict[bytes, bytes], int] | None:
    """Fields of a record head at the start of ``raw`` and its length; None if it is none."""
    end = raw.find(END)
    if not raw.startswith(VERSION) or end < 0:
        return None
    fields = {k.lower(): v for k, v in _FIELD.findall(raw[len(VERSION) : end].replace(b"\r\n", b"\n"))}
    if not fields.get(b"content-length", b"").isdigit() or len(fields[b"content-length"]) > 15:
        return None
    return fields, end + len(END)


def head_end(stream, raw: bytes, at: int) -> tuple[bytes, int, int, int]:
    """Of the head at ``at`` of ``raw``, which is read on as far as the head goes: raw, the place of the head's end (or
    of a line that no head has), the place of its last Content-Length line (-1 if it has none) and the length.

    Heads that begin later and before that end have the same end, so they share the answer.
    """
    seen = at
    while (end := raw.find(END, seen)) < 0:
        stop = _LINES.match(raw, at + len(VERSION)).end()
        more = stream.read(len(raw)) if _CUT.fullmatch(raw, stop) else b""
        if not more:
            return raw, stop, -1, 0
        seen, raw = max(at, len(raw) - len(END) + 1), raw + more
    line = raw[at:end].lower().rfind(b"\ncontent-length:")
    value = raw[at + line + 1 : end].split(b"\n", 1)[0].partition(b":")[2].strip(b" \t\r")
    if line < 0 or not value.isdigit() or len(value) > 15:
        return raw, end, -1, 0
    return raw, end, at + line, int(value)


def _dealt(rows: DataFrame, files: DataFrame, key: Column) -> DataFrame:
    """Rows that stand for parts of ``files``, in as many tasks as the bytes behind them ask for: the rows are small,
    so partitions merged by their own size would leave the reading to one task."""
    size, splits = files.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum(F.ceil(F.col("size") / SPLIT_BYTES)), F.lit(0))).first()
    wanted = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(min(wanted, splits), -(-size // TASK_BYTES), 1)
    return rows.repartitionById(n, F.pmod(key, F.lit(n)).cast("int"))


def candidates(files: DataFrame, folder: str) -> DataFrame:
    """at, next: every place in the files that looks like a record, and the place after that record.

    ``files``: file (a number), path, size.  A place is the file's number times PLACES plus the offset.
    """
    ranges = files.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)), F.lit(SPLIT_BYTES).cast("long"))))
    splits = _dealt(ranges.select("file", "path", "size", "first"), files, F.xxhash64("file", "first"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        for file, path, size, first in (r for b in batches for r in zip(*(column_values(b, c) for c in ("file", "path", "size", "first")))):
            with fs.open_input_file(path) as stream:
                stream.seek(first)
                raw = stream.read(min(SPLIT_BYTES + HEAD_BYTES, size - first))
                at, end, out = raw.find(VERSION), 0, []
                while 0 <= at < SPLIT_BYTES:
                    if at >= end:
                        raw, end, line, length = head_end(stream, raw, at)
                    if at < line:
                        after = first + end + len(END) + length + len(END)
                        if after <= size:
                            out.append((file * PLACES + first + at, file * PLACES + after))
                    at = raw.find(VERSION, at + 1)
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], names=["at", "next"])

    return map_batches(splits, scan, "at bigint, next bigint")


def reachable(edges: DataFrame) -> DataFrame:
    """The edges (at, next) that lie on the chain from offset 0 of their file.

    After k rounds the jumps are 2^k records long and the first 2^k records of every chain are marked, so the
    rounds are the logarithm of the longest file's records.
    """
    edges = materialise(edges, "warc-edges")
    jumps = edges.select("at", F.col("next").alias("to"))
    marked = edges.where(F.col("at") % PLACES == 0).select("at")
    while True:
        landed = marked.join(jumps, "at").select(F.col("to").alias("at"))
        more = materialise(landed.join(edges.select("at"), "at", "left_semi"), "warc-marked")
        if more.isEmpty():
            return edges.join(marked, "at", "left_semi")
        marked = marked.unionByName(more)
        twice = jumps.join(jumps.select(F.col("at").alias("to"), F.col("to").alias("over")), "to")
        jumps = materialise(twice.select("at", F.col("over").alias("to")), "warc-jumps")


def read_records(records: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and payload of verified records."""
    split = F.shiftright(F.col("at"), SPLIT_BYTES.bit_length() - 1)  # files are whole numbers of splits apart
    dealt = records.withColumn("file", F.shiftright(F.col("at"), PLACES.bit_length() - 1)).join(files.select("file", "path"), "file")
    dealt = dealt.select("path", F.col("at") % PLACES, F.col("next") % PLACES, split).toDF("path", "at", "next", "split")
    dealt = _dealt(dealt, files, F.xxhash64("split")).sortWithinPartitions("split", "at")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_folder(folder)
        open_path, stream = None, None
        for batch in batches:
            rows, held = [], 0
            for path, at, after in zip(*(column_values(batch, c) for c in ("path", "at", "next"))):
                if path != open_path:
                    if stream is not None:
                        stream.close()
                    open_path, stream = path, fs.open_input_file(path)
                stream.seek(at)
                raw = stream.read(after - at)
                fields, start = parse_head(raw)
                payload = raw[start : -len(END)]
                kind = fields[b"warc-type"].decode()
                digest = fields[b"warc-payload-digest"].decode().removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {path} at {at} does not match its digest")
                size = len(payload) if kind == "response" else int(fields[b"warc-payload-length"])
                rows.append((_page(fields.get(b"warc-record-id")), size, digest, kind, _page(fields.get(b"warc-refers-to")), payload))
                held += len(payload)
                if held > 16 << 20:
                    yield _rows(rows)
                    rows, held = [], 0
            yield _rows(rows)
        if stream is not None:
            stream.close()

    return map_batches(dealt, read, ROW_FIELDS + ", payload binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


def _page(urn: bytes | None) -> int | None:
    name = urn.decode().removeprefix("<urn:page:").removesuffix(">") if urn else "none"
    return None if name == "none" else int(name)


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    numbers = F.row_number().over(Window.orderBy("path")).cast("long")  # a row for each file
    files = materialise(manifest.select(numbers.alias("file"), "path", "size", "n_records"), "warc-files")
    records = materialise(reachable(candidates(files, folder)), "warc-records")
    found = records.groupBy(F.shiftright(F.col("at"), PLACES.bit_length() - 1).alias("file")).agg(F.count("*").alias("n"))
    short = files.join(found, "file", "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> n_records").first()
    if short:
        raise ValueError(f"{short['path']} gives {short['n']} records, its manifest says {short['n_records']}")
    return read_records(records, files, folder)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archives to a new place in the shared folder and read them again."""
    folder = fresh_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder), folder)
