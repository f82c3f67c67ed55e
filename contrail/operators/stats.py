"""Statistical detectors over many series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from contrail.operators.series import Series, exact_quantile, open_series
from contrail.session import broadcast_if_small, ensure_checkpoint_dir

STD_FLOOR = 1e-10
# Standard channels (table, field, threshold); window 50.
STANDARD_CHANNELS = [
    ("GPS", "hdop", 3.0), ("BAT", "voltage_v", 4.0), ("BAT", "current_a", 3.5),
    ("NKF4", "var_ratio_vel", 3.0), ("ATT", "roll_deg", 4.0), ("ATT", "pitch_deg", 4.0),
]
STANDARD_WINDOW = 50


def rolling_zscore(series: Series, value: str, window: int = 100, threshold: float = 3.0) -> DataFrame:
    """Burst onsets where |value - moving mean| exceeds ``threshold`` moving deviations.

    Means are centred and divided by ``window`` throughout, also near the ends.  Series shorter
    than the window give nothing.  Adds ``z_score`` and ``severity`` (CRITICAL from 1.5 x on)."""
    lo, hi = -(window // 2), (window - 1) - window // 2

    def score(d: DataFrame, w) -> DataFrame:
        near = w.rowsBetween(lo, hi)
        d = d.withColumn("_m", F.sum(value).over(near) / window)
        d = d.withColumn("_q", F.pow(F.col(value) - F.col("_m"), 2))
        std = F.greatest(F.sqrt(F.sum("_q").over(near) / window), F.lit(STD_FLOOR))
        d = d.withColumn("z_score", F.abs(F.col(value) - F.col("_m")) / std)
        return d.withColumn("_was", F.lag("z_score").over(w) > threshold)

    s = series.with_df(series.df.where(F.col(value).isNotNull())).totals({"_all": F.count(F.lit(1))})
    s = s.with_df(s.df.where(F.col("_all") >= window)).framed(2 * window + 1, score)
    onset = s.df.where((F.col("z_score") > threshold) & ~F.coalesce("_was", F.lit(False)))
    sev = F.when(F.col("z_score") >= 1.5 * threshold, "CRITICAL").otherwise("WARNING")
    return s.with_df(onset.withColumn("severity", sev).drop("_m", "_q", "_was", "_all")).result()


def standard_channel_checks(telemetry) -> DataFrame:
    """Rolling z-score over the standard channels of all flights, in one long-form result."""
    out = None
    for table, field, threshold in STANDARD_CHANNELS:
        if not telemetry.has(table):
            continue
        hits = rolling_zscore(telemetry.series(table), field, STANDARD_WINDOW, threshold)
        hits = hits.select(
            "flight_id", "timestamp_us", F.lit(f"{table}.{field}").alias("field"), F.col(field).alias("value"),
            "z_score", F.lit("rolling_zscore").alias("method"), "severity",
        )
        out = hits if out is None else out.unionByName(hits)
    return out


def change_points(
    series: Series, value: str, min_size: int = 20, penalty: float = 10.0, variance_floor: float = 1e-3
) -> DataFrame:
    """Times of the last sample before the distribution shifts.

    Values are normalised per series.  At each boundary the ``min_size`` rows before and after are
    compared by a Gaussian likelihood ratio on mean and variance; a boundary counts when the ratio
    exceeds twice the penalty and is the largest within ``min_size`` rows.  Flat series and series
    shorter than twice ``min_size`` give nothing."""
    m = min_size
    s = series.with_df(series.df.where(F.col(value).isNotNull())).totals(
        {"_n": F.count(F.lit(1)), "_mu": F.avg(value), "_sd": F.stddev_pop(value)}
    )
    s = s.with_df(s.df.where((F.col("_n") >= 2 * m) & (F.col("_sd") >= 1e-10)))

    def score(d: DataFrame, w) -> DataFrame:
        d = d.withColumn("_z", (F.col(value) - F.col("_mu")) / F.col("_sd"))
        left, right, both = w.rowsBetween(1 - m, 0), w.rowsBetween(1, m), w.rowsBetween(1 - m, m)
        full = (F.count("_z").over(left) == m) & (F.count("_z").over(right) == m)

        def spread(frame):
            return F.log(F.greatest(F.var_pop("_z").over(frame), F.lit(variance_floor)))

        ratio = 2 * m * spread(both) - m * spread(left) - m * spread(right)
        d = d.withColumn("score", F.when(full, ratio))
        top = F.max("score").over(w.rowsBetween(-m, m))
        earlier = F.coalesce(F.max("score").over(w.rowsBetween(-m, -1)), F.lit(float("-inf")))
        peak = (F.col("score") == top) & (F.col("score") > earlier) & (F.col("score") > 2 * penalty)
        return d.withColumn("_peak", F.coalesce(peak, F.lit(False)))

    s = s.framed(3 * m + 1, score)
    return s.with_df(s.df.where("_peak").drop("_n", "_mu", "_sd", "_z", "_peak")).result()


def _lag_sums(a: np.ndarray, b: np.ndarray, max_lag: int) -> np.ndarray:
    """Sums of ``a[i + lag] * b[i]`` for each lag from -max_lag to max_lag; what lies outside counts as zero."""
    size = 1 << (len(a) + max_lag - 1).bit_length()  # so long that no lag wraps round into another
    circle = np.fft.irfft(np.fft.rfft(a, size) * np.conj(np.fft.rfft(b, size)), size)
    return circle[np.arange(-max_lag, max_lag + 1) % size]


def cross_correlation_lag(
    pairs: DataFrame, keys: Sequence[str], order: Sequence[str], a: str, b: str, max_lag: int,
    sample_rate_hz: float = 1.0, block: int = 16_384, max_rows: int | None = None,
) -> DataFrame:
    """Lag in [-max_lag, max_lag] that lines up ``b`` with ``a``, per key.

    ``pairs`` has both signals by position.  Each block of rows also receives ``max_lag`` rows from
    its neighbours, all lags of a block come from one product of transforms, and the partial sums per lag
    are added up: work is n log n whatever the lag, and a task holds a block and two times ``max_lag`` rows.
    Correlations are compared to nine decimals, and of equal ones the smallest lag is given, so that the
    rounding of transforms decides nothing."""
    keys = list(keys)
    s = open_series(pairs, keys, order, max_rows).totals(
        {"_n": F.count(F.lit(1)), "_ma": F.avg(a), "_sa": F.stddev_pop(a), "_mb": F.avg(b), "_sb": F.stddev_pop(b)}
    ).number("_i")
    pos, size = F.col("_i") - 1, max(block, 2 * max_lag, 1)
    z = {
        "_a": (F.col(a) - F.col("_ma")) / (F.col("_sa") + 1e-10),
        "_b": (F.col(b) - F.col("_mb")) / (F.col("_sb") + 1e-10),
    }
    home = F.floor(pos / size)
    targets = F.array_distinct(F.array(F.floor(F.greatest(pos - max_lag, F.lit(0)) / size), home, F.floor((pos + max_lag) / size)))
    rows = s.df.withColumns(z).select(*keys, pos.alias("_p"), "_a", "_b", "_n", home.alias("_home"), F.explode(targets).alias("_run"))

    key_fields = [pairs.schema[k] for k in keys]
    schema = T.StructType([*key_fields, T.StructField("lag", T.LongType()), T.StructField("_s", T.DoubleType()), T.StructField("_n", T.LongType())])

    def correlate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_p")
        own = (pdf["_home"] == pdf["_run"]).to_numpy()
        pos_ = pdf["_p"].to_numpy()
        bs = np.where(own, pdf["_b"].to_numpy(), 0.0)  # each row of b is owned by one block
        av = pdf["_a"].to_numpy()
        start, length = pos_[0], pos_[-1] - pos_[0] + 1
        fa, fb = np.zeros(length), np.zeros(length)
        fa[pos_ - start], fb[pos_ - start] = av, bs
        lags = np.arange(-max_lag, max_lag + 1)
        sums = _lag_sums(fa, fb, max_lag)
        head = {k: np.full(len(lags), pdf[k].iloc[0], dtype=object) for k in keys}
        return pd.DataFrame({**head, "lag": lags, "_s": sums, "_n": int(pdf["_n"].iloc[0])})

    sums = rows.groupBy(*keys, "_run").applyInPandas(correlate, schema)
    by_lag = sums.groupBy(*keys, "lag").agg(F.sum("_s").alias("_s"), F.max("_n").alias("_n")).where(F.abs("lag") < F.col("_n"))
    best = by_lag.groupBy(*keys).agg(
        F.max_by(F.struct("lag", "_s", "_n"), F.struct(F.round(F.col("_s") / F.col("_n"), 9), -F.col("lag"))).alias("r")
    )
    peak = F.col("r._s") / F.col("r._n")
    return best.select(
        *keys, F.col("r.lag").alias("lag_samples"), (F.col("r.lag") / F.lit(float(sample_rate_hz))).alias("lag_seconds"),
        peak.alias("peak_correlation"), (peak > 0.5).alias("is_significant"),
    )


# -- isolation forest ------------------------------------------------------------------------------

SAMPLE = 256
EULER = 0.5772156649015329


def _mean_path(n: np.ndarray) -> np.ndarray:
    """Expected path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = 2.0 * (np.log(np.maximum(n - 1, 1)) + EULER) - 2.0 * (n - 1) / np.maximum(n, 1)
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, big))


def _grow_tree(x: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """One random tree as flat arrays: feature, cut, left child, leaf path length."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    feature, cut, left, path = [], [], [], []

    def add() -> int:
        for lst, v in ((feature, -1), (cut, 0.0), (left, -1), (path, 0.0)):
            lst.append(v)
        return len(feature) - 1

    todo = [(add(), np.arange(len(x)), 0)]
    while todo:
        node, idx, depth = todo.pop()
        lo, hi = x[idx].min(axis=0), x[idx].max(axis=0)
        open_ = np.flatnonzero(hi > lo)
        if depth >= limit or len(idx) <= 1 or len(open_) == 0:
            path[node] = depth + float(_mean_path(len(idx)))
            continue
        pick, at = rng.random(2).tolist()
        f = int(open_[int(pick * len(open_))])
        c = min(float(lo[f] + at * (hi[f] - lo[f])), float(np.nextafter(hi[f], lo[f])))  # the largest value always goes right
        below = x[idx, f] <= c
        feature[node], cut[node] = f, c
        left[node] = add()
        right = add()
        todo += [(left[node], idx[below], depth + 1), (right, idx[~below], depth + 1)]
    return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left), "path": np.array(path)}


def _tree_hash(base: np.ndarray, tree: int) -> np.ndarray:
    """A number from 0 to 1 for each row and tree, from the row's hash."""
    z = base.astype(np.uint64) + np.uint64((tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def _closed(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A tree whose leaves lead to themselves, so that all rows take the same number of steps."""
    leaf = tree["feature"] < 0
    number = np.arange(len(leaf))
    return {"feature": np.where(leaf, 0, tree["feature"]), "cut": np.where(leaf, np.inf, tree["cut"]), "left": np.where(leaf, number, tree["left"]), "path": tree["path"]}


def _tree_depth(tree: dict[str, np.ndarray], x: np.ndarray, steps: int) -> np.ndarray:
    """Path length of each row in a closed tree of at most ``steps`` levels."""
    flat, row, node = x.ravel(), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.int64)
    for _ in range(steps):
        node = tree["left"][node] + (flat[row + tree["feature"][node]] > tree["cut"][node])
    return tree["path"][node]


def _forest(whole: DataFrame, sizes: DataFrame, keys: list[str], features: list[str], unique: list[str], n_trees: int, seed: int) -> DataFrame:
    """keys, tree, feature, cut, left, path (flat arrays), size: trees, each grown from SAMPLE rows of its key.

    Every tree draws from all rows: its sample are the rows with the smallest hashes of (row, tree).  A share
    of the hashes that holds about four times the sample goes on; nothing else leaves the scan."""
    share = F.least(F.lit(1.0), F.lit(4.0 * SAMPLE) / F.col("_n"))
    cols = [F.col(f).cast("double").alias(f) for f in features]
    sized = whole.join(broadcast_if_small(sizes), keys).select(*keys, F.xxhash64(*unique, F.lit(seed)).alias("_h"), share.alias("_share"), *cols)
    fields = [whole.schema[k] for k in keys]
    kept = [*keys, *features]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, limit = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("_h", "_share"))
            rows, trees, hashes = [], [], []
            for tree in range(n_trees):
                h = _tree_hash(base, tree)
                at = np.flatnonzero(h <= limit)
                rows.append(at)
                trees.append(np.full(len(at), tree, np.int32))
                hashes.append(h[at])
            part = batch.take(pa.array(np.concatenate(rows)))
            columns = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(trees)), pa.array(np.concatenate(hashes))], names=[*kept, "_tree", "_h"])

    low = sized.mapInArrow(draw, T.StructType([
        *fields, *[T.StructField(f, T.DoubleType()) for f in features], T.StructField("_tree", T.IntegerType()), T.StructField("_h", T.DoubleType())]))
    w = Window.partitionBy(*keys, "_tree").orderBy("_h", *features)
    sample = low.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= SAMPLE)
    schema = T.StructType([
        *fields, T.StructField("tree", T.IntegerType()), T.StructField("feature", T.ArrayType(T.LongType())), T.StructField("cut", T.ArrayType(T.DoubleType())),
        T.StructField("left", T.ArrayType(T.LongType())), T.StructField("path", T.ArrayType(T.DoubleType())), T.StructField("size", T.LongType()),
    ])

    def grow(pool: pd.DataFrame) -> pd.DataFrame:
        pool, number = pool.sort_values("_k"), int(pool["_tree"].iloc[0])
        tree = _grow_tree(pool[features].to_numpy(dtype=float), np.random.default_rng([seed, number]))
        return pd.DataFrame({**{k: [pool[k].iloc[0]] for k in keys}, "tree": [number], **{c: [v] for c, v in tree.items()}, "size": [len(pool)]})

    return sample.groupBy(*keys, "_tree").applyInPandas(grow, schema)


FOREST_KEYS = 64  # forests (about a megabyte each) that travel to every task


def isolation_scores(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], unique: Sequence[str],
    n_trees: int = 100, min_rows: int = 20, seed: int = 42, chunk_rows: int = 50_000, forest_keys: int = FOREST_KEYS,
) -> DataFrame:
    """Isolation score per complete row (more negative = more isolated), one forest per key.

    Each tree is grown from 256 rows drawn from all rows of its key.  The forests of up to ``forest_keys`` keys travel
    to the tasks, which score the rows where they are; forests of more keys meet their rows in chunks of bounded size,
    so a key of any size is spread."""
    keys, features, unique = list(keys), list(features), list(unique)
    if len(features) < 2 or any(f not in df.columns for f in features):
        return df.limit(0).withColumn("score", F.lit(None).cast("double"))
    ensure_checkpoint_dir(df.sparkSession)
    whole = df
    for f in features:
        whole = whole.where(F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double")))
    for k in keys:
        whole = whole.where(F.col(k).isNotNull())
    sizes = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_rows).checkpoint()
    forest = _forest(whole, sizes, keys, features, unique, n_trees, seed).checkpoint()
    schema = T.StructType([*df.schema.fields, T.StructField("score", T.DoubleType())])
    if sizes.limit(forest_keys + 1).count() <= forest_keys:
        return _score_in_place(whole, forest, keys, features, schema)
    return _score_in_chunks(whole, forest, sizes, keys, features, unique, seed, chunk_rows, schema)


def _score(x: np.ndarray, trees: list[dict[str, np.ndarray]], size: int) -> np.ndarray:
    depth, steps = np.zeros(len(x)), int(np.ceil(np.log2(max(size, 2))))
    for tree in trees:
        depth += _tree_depth(tree, x, steps)
    return -np.power(2.0, -depth / len(trees) / (float(_mean_path(size)) or 1.0))


_TREE = ("feature", "cut", "left", "path")


def _score_in_place(whole: DataFrame, forest: DataFrame, keys: list[str], features: list[str], schema: T.StructType) -> DataFrame:
    grown: dict[tuple, tuple[list, int]] = {}
    for r in forest.orderBy(*keys, "tree").toLocalIterator():  # n_trees rows for each of at most ``forest_keys`` keys
        trees = grown.setdefault(tuple(r[k] for k in keys), ([], r["size"]))[0]
        trees.append(_closed({c: np.asarray(r[c]) for c in _TREE}))
    sent = whole.sparkSession.sparkContext.broadcast(grown)
    names = whole.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(names.index(c))
            x = np.stack([column(f).cast(pa.float64()).to_numpy(zero_copy_only=False) for f in features], axis=1)
            rows: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(column(k).to_pylist() for k in keys))):
                rows.setdefault(key, []).append(i)
            scores, known = np.empty(len(x)), np.zeros(len(x), bool)
            for key, at in rows.items():
                if key in sent.value:
                    scores[at], known[at] = _score(x[at], *sent.value[key]), True
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*names, "score"])
            yield out.filter(pa.array(known))

    return whole.mapInArrow(score, schema)


def _score_in_chunks(whole: DataFrame, forest: DataFrame, sizes: DataFrame, keys: list[str], features: list[str], unique: list[str], seed: int, chunk_rows: int,
                     schema: T.StructType) -> DataFrame:
    chunks = F.greatest(F.ceil(F.col("_n") / chunk_rows), F.lit(1))
    sized = sizes.select(*keys, chunks.alias("_chunks"))
    rows = whole.join(broadcast_if_small(sized), keys).withColumn("_chunk", F.pmod(F.xxhash64(*unique, F.lit(seed)), F.col("_chunks")).cast("long"))
    names = whole.columns
    copies = forest.join(broadcast_if_small(sized), keys).select(
        *[F.col(k).alias(f"_to_{k}") for k in keys], "tree", *_TREE, "size",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("_to_chunk"),
    )

    def score(data: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        if data.empty or trees.empty:
            return data[names].astype(object).head(0).assign(score=0.0)
        flat = [_closed({c: np.asarray(getattr(row, c)) for c in _TREE}) for row in trees.sort_values("tree").itertuples(index=False)]
        return data[names].assign(score=_score(data[features].to_numpy(dtype=float), flat, int(trees["size"].iloc[0])))

    to = [*[f"_to_{k}" for k in keys], "_to_chunk"]
    return rows.groupBy(*keys, "_chunk").cogroup(copies.groupBy(*to)).applyInPandas(score, schema)


def isolation_anomalies(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], order: Sequence[str],
    contamination: float = 0.05, n_trees: int = 100, critical_at: float = -0.15, max_rows: int | None = None,
) -> DataFrame:
    """Outlier groups (at most five rows apart) among the rows below the contamination quantile.

    A group has the time of its middle outlier (``middle``) and the feature values of its first one (``features``)."""
    ensure_checkpoint_dir(df.sparkSession)
    keys, order, features = list(keys), list(order), list(features)
    # scores are read twice (cut-off and rows); Python work is not repeated
    scored = isolation_scores(df, keys, features, order, n_trees)
    if any(f not in df.columns for f in features) or len(features) < 2:
        values = F.create_map().cast("map<string,double>")
    else:
        values = F.create_map(*[c for f in features for c in (F.lit(f), F.col(f).cast("double"))])
    scored = scored.select(*keys, *order, values.alias("_features"), "score").checkpoint()
    cut = exact_quantile(scored, keys, "score", contamination, max_rows).withColumnRenamed("score", "_cut")
    s = open_series(scored, keys, order, max_rows).number("_rn")
    outliers = s.result().join(broadcast_if_small(cut), keys).where(F.col("score") < F.col("_cut")).select(*keys, *order, "_rn", "_features", "score")
    # Outliers in order: a gap of more than five rows begins a group; the outlier in its middle is known by its number.
    o = open_series(outliers.checkpoint(), keys, order, max_rows).shift({"_rn0": "_rn"}).number("_at")
    fresh = F.coalesce(F.col("_rn") - F.col("_rn0") > 5, F.lit(True))
    o = o.with_df(o.df.withColumn("_head", F.when(fresh, F.struct(F.col("_at").alias("at"))))).carry({"g": "_head"})
    rows = o.result().withColumn("_g", F.col("g_prev.at"))
    group = rows.groupBy(*keys, "_g").agg(
        F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), F.count(F.lit(1)).alias("n"), F.min("score").alias("value"),
        F.min_by("_features", "_at").alias("features"))
    middle = rows.join(group.select(*keys, "_g", F.col("n").alias("_size")), [*keys, "_g"]).where(F.col("_at") == F.col("_g") + F.expr("_size div 2"))
    middle = middle.select(*keys, "_g", F.col(order[0]).alias("middle"))
    return group.join(middle, [*keys, "_g"]).select(
        *keys, "start", "end", "middle", "n", "value", "features",
        F.lit(",".join(features)).alias("field"), F.lit("isolation_forest").alias("method"),
        F.when(F.col("value") > critical_at, "WARNING").otherwise("CRITICAL").alias("severity"),
    )
