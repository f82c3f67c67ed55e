"""Exact top-k inner products by norm-bucketed retrieval.

Candidates are sorted into buckets of similar length (bounds from sampled lengths); a bucket is cut into cells
of bounded size.  Every block of queries first meets the longest bucket, which gives each query a lower bound
for its k-th score.  In a bucket with greatest length l a candidate can only reach a bound t of a query q if
their cosine is at least t / (|q| l), the local threshold:

* above 1 the whole bucket is skipped;
* where it is high, coordinate pruning: with p and q of unit length, (p - q) is at most sqrt(2 - 2 c) long, so
  p lies that near to q in each of q's largest coordinates;
* otherwise length pruning: rows lie from long to short, and those shorter than t / |q| are left off.

Products of the rest are verified exactly: components are integers, products are computed in doubles while
they stay below 2^53 and in whole numbers of any size beyond.  Results of the cells are merged by score, ties
to the smaller id.

Vectors that are null or empty or hold a null or a value that is not finite take no part; rows with a null id
neither.  A query meets the vectors of its own width.  Rows that repeat an id are candidates each,
and the smallest of their vectors is the query.  Fewer candidates than k: all.  Components or products beyond 64 bits
are errors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from contrail.llm.common import materialise
from contrail.session import broadcast_if_small

CELL, QUERIES, BUCKETS, SPREAD = 8192, 2048, 16, 16
STEEP, FOCUS = 0.8, 4  # local threshold from which coordinates are looked at, and how many


def usable(df: DataFrame, is_query: Column, scale: float, vec_id: str, embedding: str) -> DataFrame:
    """id, asked, v (whole numbers), width, norm2 (a double) of the vectors that take part."""
    x = F.col(embedding)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    rows = df.where(F.col(vec_id).isNotNull() & x.isNotNull() & finite & (F.size(x) > 0))
    large = F.raise_error(F.lit("a component is beyond 64 bits"))
    whole = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**63, F.floor(c.cast("double") * scale)).otherwise(large.cast("long")))
    v = rows.select(F.col(vec_id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), whole.alias("v"))
    return v.withColumns({"width": F.size("v"), "norm2": _norm2("v")})


def _norm2(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))


def _blocks(rows: DataFrame, group: Sequence[str], size: int) -> DataFrame:
    """``rows`` in blocks of about ``size``, from long to short: the group, block, id, v (flat), longest."""
    counts = rows.groupBy(*group).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))  # a row for each bucket of a width
    dealt = rows.join(broadcast_if_small(counts), list(group)).withColumn("block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int"))
    members = F.sort_array(F.collect_list(F.struct((-F.col("norm2")).alias("order"), "id", "v")))
    packed = dealt.groupBy(*group, "block").agg(members.alias("m"), F.sqrt(F.max("norm2")).alias("longest"))
    return packed.select(*group, "block", F.col("m.id").alias("id"), F.flatten("m.v").alias("v"), "longest")


def top_k(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k candidates with the highest products for each query."""
    spark = df.sparkSession
    rows = materialise(usable(df, is_query, scale, vec_id, embedding), "topk-vectors")
    most = rows.agg(F.max(F.greatest(F.array_max("v"), -(F.array_min("v") + 1)))).first()[0]
    if most is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    kind = next(t for t, bits in (("smallint", 15), ("int", 31), ("bigint", 63)) if most < 2**bits)
    rows = rows.withColumn("v", F.col("v").cast(f"array<{kind}>"))
    # Bounds of the buckets of each width.
    bounds = rows.groupBy("width").agg(F.percentile_approx("norm2", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("bounds"))
    bucket = F.size(F.filter("bounds", lambda b: F.col("norm2") <= b))  # 0: the longest
    cells = rows.join(broadcast_if_small(materialise(bounds, "topk-bounds")), "width").withColumn("bucket", bucket)
    cells = materialise(_blocks(cells, ("width", "bucket"), CELL), "topk-cells")
    # Of rows that repeat an id and a width the smallest vector asks.
    asked = rows.where("asked").groupBy("id", "width").agg(F.min("v").alias("v"))
    asked = asked.join(asked.groupBy("id").agg(F.min(F.struct("v")).alias("least")), "id").where("v = least.v").withColumn("norm2", _norm2("v"))
    blocks = _blocks(asked, ("width",), QUERIES).select(F.concat_ws("/", "width", "block").alias("q_block"), "width", F.col("id").alias("q_id"), F.col("v").alias("q_v"),
                                                       F.col("longest").alias("q_longest"))
    blocks = materialise(blocks, "topk-queries")
    at = F.struct("bucket", "block")
    longest = cells.groupBy("width").agg(F.min(at).alias("at")).select("width", "at.*")  # a cell of the longest vectors of each width
    first = cells.join(broadcast_if_small(longest), ["width", "bucket", "block"], "left_semi")
    first = _search(first, blocks.withColumn("known", F.array().cast("array<struct<query_id:bigint,bound:bigint>>")), k)
    # Lower bounds of the k-th scores, k results of the first cell at least; one row for each query block.
    kth = first.groupBy("q_block", "query_id").agg(F.min("score").alias("bound"), F.count("*").alias("n")).where(F.col("n") >= k)
    known = kth.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "bound")).alias("known"))
    found = _search(cells, blocks.join(known, "q_block", "left"), k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.select("query_id", "vec_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search(cells: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Every block of queries against every cell of candidates that its bounds leave: a stated set against all rows."""
    spark = cells.sparkSession
    # Which query block wants which bucket is settled on numbers alone; only then vectors are copied.
    least = F.when(F.size("known") == F.size("q_id"), F.array_min(F.transform("known", lambda x: x["bound"])))
    layout = cells.groupBy("width", "bucket").agg(F.max("longest").alias("reach"))
    wanted = blocks.select("q_block", "width", "q_longest", least.alias("least")).join(layout, "width")
    # A block skips a bucket when even its longest query can't reach its least bound there.
    wanted = wanted.where(F.col("least").isNull() | (F.col("least") <= F.col("q_longest") * F.col("reach") * (1 + 1e-9)))
    wanted = materialise(wanted.select("q_block", "width", "bucket"), "topk-wanted")
    # The cells that a query block wants are dealt to SPREAD tasks, to each of which the block goes once.
    spread = F.pmod(F.xxhash64("bucket", "block"), F.lit(SPREAD)).alias("spread")
    offered = cells.select("width", "bucket", spread, "id", "v").join(wanted, ["width", "bucket"]).select("q_block", "spread", "id", "v")
    asking = blocks.select("q_block", "q_id", "q_v", "known").withColumn("spread", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))))
    pairs = offered.join(asking.hint("shuffle_hash"), ["q_block", "spread"])
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "8")
    try:
        run = partial(_cells, k=k)
        columns = ("q_block", "q_id", "q_v", "known", "id", "v")
        return materialise(pairs.select(*columns).mapInArrow(run, "q_block string, query_id bigint, vec_id bigint, score bigint"), "topk-found")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def _cells(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            block, known = batch.column(0)[i].as_py(), batch.column(3)[i].as_py() or []
            q_id, q_v, c_id, c_v = (batch.column(c)[i].values.to_numpy() for c in (1, 2, 4, 5))
            bounds = {x["query_id"]: x["bound"] for x in known}
            query, candidate, score = search_cell(q_id, q_v.reshape(len(q_id), -1), c_id, c_v.reshape(len(c_id), -1), bounds, k)
            yield pa.RecordBatch.from_arrays([pa.array([block] * len(query), pa.string()), pa.array(query), pa.array(candidate), pa.array(score)],
                                             names=["q_block", "query_id", "vec_id", "score"])


def search_cell(q_id: np.ndarray, q: np.ndarray, c_id: np.ndarray, c: np.ndarray, bounds: dict[int, int], k: int) -> tuple[np.ndarray, ...]:
    """The k best of a cell (from long to short) for each query that the bounds leave: query, candidate, score."""
    q_len, c_len = (np.sqrt((x.astype(float) ** 2).sum(axis=1)) for x in (q, c))
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1] < 2**53
    qs, cs = (x.astype(float if exact else object) for x in (q, c))
    bound = np.array([bounds.get(i, np.iinfo(np.int64).min) for i in q_id.tolist()], np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where((bound > 0) & (q_len > 0), bound / (q_len * c_len[0]), -1.0) * (1 - 1e-9)
        unit = np.nan_to_num(c / c_len[:, None])
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def verify(queries: np.ndarray, rows: np.ndarray | slice) -> None:
        score = qs[queries] @ cs[rows].T
        if not exact:
            if max(map(abs, score.ravel().tolist()), default=0) >= 2**63:
                raise OverflowError("a product is beyond 64 bits")
            score = score.astype(np.int64)
        ids = c_id[rows]
        if not len(ids):
            return
        usable = ids[None, :] != q_id[queries][:, None]
        least = bound[queries].astype(score.dtype)
        if len(ids) > k:
            lowest = score.min() - 1 if exact else np.iinfo(np.int64).min
            part = np.partition(np.where(usable, score, lowest), len(ids) - k, axis=1)[:, len(ids) - k]
            least = np.maximum(least, part)
        at, col = np.nonzero(usable & (score >= least[:, None]))
        s = score[at, col].astype(np.int64)
        order = np.lexsort((ids[col], -s, at))
        at, col, s = at[order], col[order], s[order]
        first = np.searchsorted(at, np.arange(len(queries)))
        top = np.arange(len(at)) - first[at] < k
        out.append((q_id[queries][at[top]], ids[col[top]], s[top]))

    steep = np.flatnonzero((cosine >= STEEP) & (cosine <= 1))
    for n in steep.tolist():  # coordinate pruning
        u = q[n] / q_len[n]
        near = np.sqrt(max(0.0, 2 - 2 * cosine[n])) + 1e-9
        rows = np.arange(len(c))
        for f in np.argsort(-np.abs(u), kind="stable")[:FOCUS]:
            rows = rows[np.abs(unit[rows, f] - u[f]) <= near]
        verify(np.array([n]), rows)
    flat = np.flatnonzero(cosine < STEEP)  # length pruning; queries that need rows of a like number go together
    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(cosine > 0, bound / q_len * (1 - 1e-9), 0.0)
    rows_of = np.where(need > 0, np.searchsorted(-c_len, -need, "right"), len(c))
    flat = flat[np.argsort(rows_of[flat], kind="stable")]
    for i in range(0, len(flat), 256):
        part = flat[i : i + 256]
        verify(part, slice(0, int(rows_of[part[-1]])))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate([o[n] for o in out]) for n in range(3))
