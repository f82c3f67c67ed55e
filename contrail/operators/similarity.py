"""Exact top-k cosine search over a vector table, each query with its own filters.

A counted, small query set travels to the tasks: each scans its base rows once by matrix product and hands on
only k candidates per query.  A larger set goes through cells.  Base rows of equal filter values whose nearest
pivot is the same form a cell, cut into bounded pieces by their distance to the pivot; queries of equal filters
and the same nearest pivot form blocks.  A row x of a piece and a query q are at least |d(q, p) - d(p, x)| apart
(triangle inequality), so the ranges of these distances, a few numbers a piece and a block, tell which pieces a
block can use.  Nearest pieces that hold k rows are searched first; their k-th scores are the bounds by which the
other pieces are left out.  A task serves many blocks (a lane) and a share of the pieces, which pass by it nearest
first while it keeps the k best rows of each query.  So a piece is copied once a lane that uses it, a block once a
share, and a query brings k rows from each share, however many pieces there are.  Both ways are exact.

Vectors that are null or hold a null or a value that is not finite take no part; a query meets vectors of its own
width.  A filter value that is null in a query lets every row pass; otherwise the row's value has to be equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from contrail.session import broadcast_if_small, ensure_checkpoint_dir

QUERY_LIMIT = 4_096  # queries whose vectors travel to every task; more go through cells
BLOCK_QUERIES, CELL_VALUES = 1_024, 1 << 20  # queries of a block, and numbers in the vectors of a piece
PIVOTS = 32
LANE_VALUES = 1 << 22  # numbers in the vectors of the queries that one task holds, about
TASKS_A_CORE = 3
CHUNK = 4_096  # base rows that meet a block at once
SLACK, SCORE_SLACK = 1e-6, 1e-11  # of distances and of scores, far above their rounding

_SCHEMA = T.StructType([
    T.StructField("query_id", T.LongType()), T.StructField("id", T.LongType()), T.StructField("score", T.DoubleType()),
])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Top k columns per row, ties by smaller id.  Rounding makes equal vectors tie exactly."""
    scores = np.round(scores, 12)
    if scores.shape[1] > k:
        floor = np.partition(scores, -k, axis=1)[:, -k][:, None]
        cols = np.flatnonzero((scores >= floor).any(axis=0))
        scores, ids = scores[:, cols], ids[cols]
    order = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, axis=1), ids[order]


def _hits(query: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of results without those that a filter has ruled out."""
    query, ids, scores = np.repeat(query, ids.shape[1]), ids.ravel(), scores.ravel()
    real = scores > -np.inf
    return {"query_id": query[real], "id": ids[real], "score": scores[real]}


def _prepared(df: DataFrame, key: str, name: str, vector: str, filters: list[str]) -> DataFrame:
    """name, vec, width and filter values (strings) of the rows that take part."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    kept = df.where(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite)
    return kept.select(F.col(key).cast("long").alias(name), x.alias("vec"), F.size(x).alias("width"), *[F.col(c).cast("string").alias(f"f{i}") for i, c in enumerate(filters)])


def top_k(
    queries: DataFrame, base: DataFrame, k: int = 5, query_id: str = "query_id", base_id: str = "id",
    vector: str = "embedding", where: Column | None = None, filters: Mapping[str, str] | None = None, query_limit: int = QUERY_LIMIT,
    block_queries: int = BLOCK_QUERIES, cell_values: int = CELL_VALUES,
) -> DataFrame:
    """(query_id, id, score, rank): the k most similar base rows of each query; ids are integers.

    ``where`` holds for all queries; ``filters`` maps columns of the base to columns of the queries."""
    filters = dict(filters or {})
    if where is not None:
        base = base.where(where)
    queries = _prepared(queries, query_id, "query_id", vector, list(filters.values()))
    base = _prepared(base, base_id, "id", vector, list(filters))
    held = queries.limit(query_limit + 1).collect()
    if len(held) <= query_limit:
        found = _by_scan(held, base, k, len(filters))
    else:
        found = _by_cells(queries, base, k, len(filters), block_queries, cell_values)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# -- scan --------------------------------------------------------------------------------------------


def _by_scan(held: list, base: DataFrame, k: int, n_filters: int) -> DataFrame:
    spark = base.sparkSession
    if not held:
        return spark.createDataFrame([], _SCHEMA)
    groups = []
    for width in sorted({r["width"] for r in held}):
        rows = [r for r in held if r["width"] == width]
        wanted = [np.array([r[f"f{i}"] for r in rows], dtype=object) for i in range(n_filters)]
        groups.append((width, np.array([r["query_id"] for r in rows]), _unit(np.array([list(r["vec"]) for r in rows], dtype=float)), wanted))
    shared = spark.sparkContext.broadcast(groups)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.empty((len(q), 0)), np.empty((len(q), 0), dtype=np.int64)) for _, q, _, _ in shared.value]
        for b in batches:
            for g, (width, _, q, wanted) in enumerate(shared.value):
                part = b.filter(pc.equal(b.column("width"), width))
                if part.num_rows == 0:
                    continue
                x = _unit(part.column("vec").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(part.num_rows, -1))
                scores = q @ x.T
                for i, values in enumerate(wanted):
                    own = part.column(f"f{i}").to_numpy(zero_copy_only=False)
                    asks = np.array([v is not None for v in values])
                    scores[asks[:, None] & (values[:, None] != own[None, :])] = -np.inf
                s, i = _best(scores, part.column("id").to_numpy(), k)
                s, i = np.hstack([best[g][0], s]), np.hstack([best[g][1], i])
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best[g] = np.take_along_axis(s, order, axis=1), np.take_along_axis(i, order, axis=1)
        for (_, qid, _, _), (s, i) in zip(shared.value, best):
            if i.size:
                yield pa.RecordBatch.from_pydict(_hits(qid, i, s))

    return base.mapInArrow(scan, _SCHEMA)


# -- cells -------------------------------------------------------------------------------------------


def _by_cells(queries: DataFrame, base: DataFrame, k: int, n_filters: int, block_queries: int, cell_values: int) -> DataFrame:
    ensure_checkpoint_dir(base.sparkSession)
    values = [f"f{i}" for i in range(n_filters)]
    # A bounded number of vectors of each width, spread over the base by their hashes, serve as pivots.
    order = Window.partitionBy("width").orderBy(F.xxhash64("id"), "id", "vec")
    chosen = base.select("id", "width", "vec").withColumn("n", F.row_number().over(order)).where(F.col("n") <= PIVOTS).orderBy("width", "n").collect()
    pivots: dict[int, list] = {}
    for r in chosen:
        pivots.setdefault(r["width"], []).append(list(r["vec"]))
    if not pivots:
        return base.sparkSession.createDataFrame([], _SCHEMA)
    units = {w: _unit(np.array(v, dtype=float)) for w, v in pivots.items()}
    cells = _pieces(_placed(base, "id", units), "id", values, F.lit(cell_values) / F.col("width"))
    blocks = _pieces(_placed(queries, "query_id", units), "query_id", values, F.lit(block_queries))
    cells, blocks = cells.checkpoint(), blocks.checkpoint()
    pairs = _bounded_pairs(blocks, cells, values)
    # The nearest pieces that together hold k rows give every query of a block its first k-th score.
    near = Window.partitionBy("block").orderBy("least", "cell")
    pairs = pairs.withColumn("before", F.coalesce(F.sum("rows").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).checkpoint()
    first = _searched(blocks, cells, pairs.where(F.col("before") < k).select("block", "cell", "least"), k)
    kth = Window.partitionBy("block", "query_id").orderBy(F.desc("score"), "id")
    kth_score = first.withColumn("n", F.row_number().over(kth)).where(F.col("n") == k).groupBy("block").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n"))
    bounds = blocks.select("block", F.size("ids").alias("asked")).join(kth_score, "block", "left")
    bounds = bounds.select("block", F.when(F.col("n") == F.col("asked"), F.col("worst")).alias("worst"))  # all queries of the block have k
    rest = pairs.where(F.col("before") >= k).join(broadcast_if_small(bounds), "block")
    # Unit vectors at distance d have a product of 1 - d * d / 2.
    reach = 1 - F.pow(F.greatest(F.col("least") - SLACK, F.lit(0.0)), 2) / 2
    rest = rest.where(F.col("worst").isNull() | (reach >= F.col("worst")))
    return first.unionByName(_searched(blocks, cells, rest.select("block", "cell", "least"), k)).drop("block")


def _placed(df: DataFrame, key: str, units: dict[int, np.ndarray]) -> DataFrame:
    """Vectors with the distances of their unit vectors to the pivots of their width: pivot (the nearest), away, to_pivots."""
    shared = df.sparkSession.sparkContext.broadcast(units)
    fields = [f for f in df.schema.fields if f.name != "vec"]
    number = T.FloatType() if df.schema["vec"].dataType.elementType == T.FloatType() else T.DoubleType()
    schema = T.StructType([*fields, T.StructField("vec", T.ArrayType(number)), T.StructField("pivot", T.IntegerType()), T.StructField("away", T.DoubleType()),
                           T.StructField("to_pivots", T.ArrayType(T.DoubleType()))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width in np.unique(batch.column("width").to_numpy()).tolist():
                part, pivots = batch.filter(pc.equal(batch.column("width"), width)), shared.value.get(width)
                if pivots is None:  # queries of a width that the base has not
                    continue
                own = part.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                own = own if own.dtype == np.float32 else own.astype(float)
                x = _unit(own.astype(float))
                away = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * x @ pivots.T, 0))
                nearest = away.argmin(axis=1)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.ravel())) for m in (own, away)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(f.name) for f in fields], lists[0], pa.array(nearest.astype(np.int32)), pa.array(away[np.arange(len(away)), nearest]), lists[1]],
                    names=[*[f.name for f in fields], "vec", "pivot", "away", "to_pivots"])

    return df.mapInArrow(place, schema)


def _pieces(placed: DataFrame, key: str, values: list[str], size: Column) -> DataFrame:
    """Rows of equal filter values and pivot in pieces of about ``size`` by distance: cell or block, ids, vecs, nearest, farthest, low and high of to_pivots."""
    group = ["width", *values, "pivot"]
    name = "cell" if key == "id" else "block"
    # Shares of a group's distances: a row for each group.  Equal distances are split by a hash.
    shape = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("a"), F.max("away").alias("z"))
    steps = F.least(F.ceil(F.col("n") / size), F.lit(1_000)).cast("int")
    cut = shape.select(*[F.col(c).alias(f"_{c}") for c in group], "a", "z", steps.alias("steps"))
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    rows = placed if name == "block" else placed.drop("to_pivots")
    joined = rows.join(broadcast_if_small(cut), same).drop(*[f"_{c}" for c in group])
    share = (F.col("away") - F.col("a")) / F.greatest(F.col("z") - F.col("a"), F.lit(1e-12))
    joined = joined.withColumn("step", F.least(F.floor(share * F.col("steps")), F.col("steps") - 1)).drop("a", "z", "steps").checkpoint()
    # A step that still holds too many rows is dealt by a hash of the id.
    full = joined.groupBy(*group, "step").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("deals"))
    full = full.select(*[F.col(c).alias(f"_{c}") for c in (*group, "step")], "deals")
    dealt = joined.join(broadcast_if_small(full), same & (F.col("step") == F.col("_step"))).drop(*[f"_{c}" for c in (*group, "step")])
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64(key, "vec"), F.col("deals")))
    low, high = (F.array(*[f(F.get("to_pivots", F.lit(i))) for i in range(PIVOTS)]) for f in (F.min, F.max))
    extra = [low.alias("low"), high.alias("high")] if name == "block" else []
    rows = F.collect_list(F.struct(F.col(key).alias("id"), "vec"))  # bounded by ``size``, about
    out = dealt.groupBy(*group, "step", "deal").agg(rows.alias("r"), F.min("away").alias("nearest"), F.max("away").alias("farthest"), *extra)
    number = F.concat_ws("/", *[F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in (*group, "step", "deal")])
    kept = ["low", "high"] if name == "block" else ["nearest", "farthest", "pivot"]
    return out.select(number.alias(name), "width", *values, F.col("r.id").alias("ids"), F.flatten("r.vec").alias("vecs"), *kept)


def _bounded_pairs(blocks: DataFrame, cells: DataFrame, values: list[str]) -> DataFrame:
    """block, cell, least (no row and query are nearer), rows: pairs whose filters agree, by a few numbers each."""
    b = blocks.select("block", F.col("width").alias("_width"), *[F.col(v).alias(f"_{v}") for v in values], "low", "high")
    c = cells.select("cell", "width", *values, "pivot", "nearest", "farthest", F.size("ids").alias("rows"))
    agree = F.col("width") == F.col("_width")
    for v in values:
        agree = agree & (F.col(f"_{v}").isNull() | (F.col(v) == F.col(f"_{v}")))
    low, high = F.get("low", F.col("pivot")), F.get("high", F.col("pivot"))
    least = F.greatest(low - F.col("farthest"), F.col("nearest") - high, F.lit(0.0))
    return b.join(broadcast_if_small(c), agree).select("block", "cell", least.alias("least"), "rows")


def _dealt(blocks: DataFrame) -> tuple[int, int]:
    """Lanes of blocks and shares of cells: a lane fits a task, and all cores have work."""
    values = blocks.agg(F.coalesce(F.sum(F.size("vecs").cast("long")), F.lit(0))).first()[0]
    tasks = TASKS_A_CORE * blocks.sparkSession.sparkContext.defaultParallelism
    lanes = max(-(-values // LANE_VALUES), math.isqrt(tasks))
    return lanes, max(-(-tasks // lanes), 1)


def _searched(blocks: DataFrame, cells: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """block, query_id, id, score: for each query the k best rows of each share of the pairs' cells."""
    spark = blocks.sparkSession
    lanes, shares = _dealt(blocks)
    lane, share = (F.pmod(F.xxhash64(c), F.lit(n)).cast("int") for c, n in (("block", lanes), ("cell", shares)))
    task = lane * shares + share
    used = pairs.select("block", task.alias("task")).distinct()
    asking = blocks.join(broadcast_if_small(used), "block").select(
        "task", F.lit(0).alias("side"), "width", F.lit(0.0).alias("least"), "block", "ids", "vecs", F.lit(None).cast("array<struct<block:string,least:double>>").alias("asks"))
    asks = pairs.groupBy("cell", task.alias("task")).agg(F.min("least").alias("least"), F.collect_list(F.struct("block", "least")).alias("asks"))  # blocks of a lane
    offered = cells.join(asks.hint("shuffle_hash"), "cell").select(
        "task", F.lit(1).alias("side"), "width", "least", F.lit(None).cast("string").alias("block"), "ids", "vecs", "asks")
    met = asking.unionByName(offered).repartitionById(lanes * shares, F.col("task")).sortWithinPartitions("side", "width", "least")
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        schema = T.StructType([T.StructField("block", T.StringType()), *_SCHEMA.fields])
        return met.drop("task", "side", "least").mapInArrow(partial(_meet, k=k), schema).checkpoint()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


class _Block:
    """The queries of one block and the k best rows they have met."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.scores, self.found = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), dtype=np.int64)

    def meet(self, x: np.ndarray, ids: np.ndarray) -> None:
        s, k, floor = self.q @ x.T, self.k, self.scores[:, -1]
        if s.shape[1] > k and not np.isfinite(floor).all():
            floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k])
        row, col = np.nonzero(s >= (floor - SCORE_SLACK)[:, None])
        if not len(row):
            return
        rows = np.unique(row)
        at = np.concatenate([np.repeat(rows, k), row])
        scores = np.concatenate([self.scores[rows].ravel(), np.round(s[row, col], 12)])  # rounding makes equal vectors tie exactly
        found = np.concatenate([self.found[rows].ravel(), ids[col]])
        order = np.lexsort((found, -scores, at))
        at = at[order]
        best = order[np.arange(len(at)) - np.searchsorted(at, at) < k]
        self.scores[rows], self.found[rows] = scores[best].reshape(-1, k), found[best].reshape(-1, k)


def _meet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Blocks come first, then cells by width and distance."""
    blocks: dict[str, _Block] = {}
    waiting: list[tuple[np.ndarray, np.ndarray, dict[str, float]]] = []

    def meet() -> None:
        asked: dict[str, list[int]] = {}
        for n, (_, _, asks) in enumerate(waiting):
            for block, least in asks.items():
                reach = 1 - max(least - SLACK, 0.0) ** 2 / 2
                if reach >= blocks[block].scores[:, -1].min() - SCORE_SLACK:
                    asked.setdefault(block, []).append(n)
        for block, wanted in asked.items():
            ids, x = (np.concatenate([waiting[n][i] for n in wanted]) for i in range(2))
            for at in range(0, len(ids), CHUNK):
                blocks[block].meet(x[at : at + CHUNK], ids[at : at + CHUNK])
        waiting.clear()

    for batch in batches:
        for n in range(batch.num_rows):
            width, block, ids, vecs, asks = (batch.column(c)[n] for c in ("width", "block", "ids", "vecs", "asks"))
            ids, x = ids.values.to_numpy(), _unit(vecs.values.to_numpy().astype(float).reshape(-1, width.as_py()))
            if asks.is_valid:
                if waiting and (waiting[0][1].shape[1] != x.shape[1] or sum(len(w[0]) for w in waiting) >= CHUNK):
                    meet()
                waiting.append((ids, x, {a["block"]: a["least"] for a in asks.as_py()}))
            else:
                blocks[block.as_py()] = _Block(ids, x, k)
    meet()
    for name, block in blocks.items():
        hits = _hits(block.ids, block.found, block.scores)
        if len(hits["id"]):
            yield pa.RecordBatch.from_pydict({"block": [name] * len(hits["id"]), **hits}, schema=pa.schema(
                [("block", pa.string()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())]))


# -- comparison --------------------------------------------------------------------------------------


def matched_baselines(hits: DataFrame, names: DataFrame | None = None, shown: int = 5) -> DataFrame:
    """query_id, similar, similarity_scores (of the best ``shown``), n_compared; ``names`` (id, name) names the matches."""
    if names is not None:
        hits = hits.join(names, "id", "left")
    label = F.col("name") if names is not None else F.col("id")
    best = F.sort_array(F.collect_list(F.struct("rank", label.alias("name"), "score")))  # k at most
    out = hits.groupBy("query_id").agg(best.alias("b"), F.count(F.lit(1)).alias("n_compared"))
    return out.select("query_id", F.slice("b.name", 1, shown).alias("similar"), F.slice("b.score", 1, shown).alias("similarity_scores"), "n_compared")


def deviation_from_matches(
    current: DataFrame, base: DataFrame, k: int = 10, query_id: str = "query_id", base_id: str = "id",
    vector: str = "embedding", where: Column | None = None, threshold: float = 2.5, filters: Mapping[str, str] | None = None,
) -> DataFrame:
    """Match each query to its k nearest baselines, then compare the metric maps.

    Every row also tells the matches: similar (ids), similarity_scores, n_compared."""
    from contrail.plans.metrics import baseline_deviation

    ensure_checkpoint_dir(base.sparkSession)
    hits = top_k(current, base, k, query_id, base_id, vector, where, filters).checkpoint()  # read three times
    payload = base.select(F.col(base_id).cast("long").alias("id"), "metrics")
    found = baseline_deviation(
        current.select(F.col(query_id).cast("long").alias("query_id"), "metrics"),
        hits.join(payload, "id").select("query_id", "metrics"), "query_id", threshold,
    )
    return found.join(matched_baselines(hits), "query_id", "left")
