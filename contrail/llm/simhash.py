"""SimHash near-duplicates by tiled exact comparison of fingerprints.

Equal fingerprints are one row before anything is compared.  Fingerprints are dealt into tiles by their
population counts: the counts of their four 16-bit words.  Two fingerprints within the radius have counts
within the radius, in sum over the words, so only such tile pairs are compared; inside a pair, rows are in
order of their whole count and column ranges beyond the radius are skipped.  What is left is compared
exactly, by exclusive or and bit counts.  A tile is cut into blocks of bounded size, a block pair is one
unit of work, and of the links in it only a spanning forest leaves the task, which keeps every connection.

``near_groups`` finds documents whose word shingles have a similarity of 0.8 or more.  There each shingle counts once,
tiles are classes of shingle counts (sets of similarity s have sizes within a factor s), tiles are compared on
128 bits within 48, and what is left on 512 bits within 128 (140 for sets of four shingles).  By binomial count both
together lose less than 1 in 500,000 pairs at 0.8, whatever the sets' sizes.
Forest links are taken closest first and then checked exactly on the texts.  Documents that are connected with a
link that failed are compared once more, and there every candidate between documents not yet in one group is checked.

Documents without words have fingerprint 0 and link like any other.  Rows with a null doc_id get the group of
their fingerprint and never name one.  In ``simhash_groups`` rows that repeat a doc_id count as one document in links;
``near_groups`` links texts, whatever their doc_ids.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import append_columns, column_values, join_copies, map_batches, materialise, text_or_empty, texts_of
from contrail.session import broadcast_if_small

BLOCK, ROWS = 16_384, 512  # fingerprints of a block, and of the rows compared at a time
HASHES = 1 << 20  # shingle hashes of a block whose sets are compared
CHUNK = 32_768  # shingle hashes unpacked at a time
FEW, FEW_BITS = 5, 12  # sets below so many shingles may differ in so many more bits
WORDS, LEAD = 8, 2  # 64-bit words of a set's fingerprint, and those that tiles are compared on


# -- fingerprints ------------------------------------------------------------------------------------


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of ``width`` words, of all words if there are fewer, repeats included."""
    words = text.encode("utf-8", "replace").lower().split()  # on bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(w) for w in zip(*(words[k:] for k in range(width)))] if len(words) >= width else [b" ".join(words)]
    return np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that more than half of the hashes have."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, text: str = "text") -> DataFrame:
    """All columns and ``fp``, the fingerprint (its unsigned bits as a bigint)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        prints = [fingerprint(shingle_hashes(t, width)) for t in texts_of(batch, text)]
        return [pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())]

    return append_columns(docs, "fp bigint", run)


def set_fingerprints(docs: DataFrame, width: int, text: str = "text") -> DataFrame:
    """All columns, a fingerprint of 512 bits (fps, eight words) of the distinct shingles, and how many there are (n)."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [np.unique(shingle_hashes(t, width)) for t in texts_of(batch, text)]
        words = [fingerprint(_mixed(h, k)) for h in sets for k in range(WORDS)]
        flat = pa.array(np.array(words, np.uint64).view(np.int64), pa.int64())
        ends = pa.array(np.arange(0, len(words) + 1, WORDS), pa.int32())
        return [pa.ListArray.from_arrays(ends, flat), pa.array([len(h) for h in sets], pa.int64())]

    return append_columns(docs, "fps array<bigint>, n bigint", run)


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th hash of each: a bijection whose bits do not follow those of the others."""
    z = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


# -- tiles -------------------------------------------------------------------------------------------


def popcount_tile(fp: str = "fp") -> Column:
    """The counts of the four 16-bit words as one number (17 values each)."""
    words = [F.bit_count(F.shiftrightunsigned(fp, 16 * k).bitwiseAND(0xFFFF)).cast("long") for k in range(4)]
    return sum((w * 17**k for k, w in enumerate(words)), F.lit(0).cast("long"))


def popcount_neighbours(tile: str, radius: int) -> Column:
    """Tiles within the radius, each unordered pair of tiles from one side only."""
    spans = [d for d in np.ndindex(*(2 * radius + 1,) * 4) if sum(abs(x - radius) for x in d) <= radius]
    offsets = sorted(tuple(x - radius for x in d) for d in spans if tuple(x - radius for x in d) >= (0, 0, 0, 0))
    words = [F.floor(F.col(tile) / 17**k) % 17 for k in range(4)]
    found = []
    for d in offsets:
        inside = [(words[k] + d[k]).between(0, 16) for k in range(4) if d[k]]
        ok = inside[0] if inside else F.lit(True)
        for c in inside[1:]:
            ok = ok & c
        found.append(F.when(ok, F.col(tile) + F.lit(sum(x * 17**k for k, x in enumerate(d))).cast("long")))
    return F.array_compact(F.array(*found))


def size_tile(n: str, similarity: float) -> Column:
    """Class of a set's size; similar sets are in one class or in the next."""
    return F.floor(F.log(F.col(n) + 1.0) / float(np.log(1 / similarity))).cast("long")


def _block_pairs(nodes: DataFrame, tile: Column, neighbours: Column, blocks: Column, columns: Sequence[str]) -> DataFrame:
    """A row for every two blocks that may hold links: the columns as lists in order of bit counts, same, and those of the other block.

    ``blocks``: how many a tile is cut into.  Columns that are lists are flattened.
    """
    tiled = nodes.withColumn("tile", tile)
    # One row for each tile there is: at most 17^4, or one for each class of sizes.
    blocks = tiled.groupBy("tile").agg(blocks.cast("int").alias("blocks"))
    dealt = tiled.join(F.broadcast(blocks), "tile").withColumn("block", F.pmod(F.xxhash64("id", "fps"), F.col("blocks")).cast("int"))
    ones = sum((F.coalesce(F.bit_count(F.get("fps", F.lit(k))), F.lit(0)) for k in range(1, LEAD)), F.bit_count(F.get("fps", F.lit(0))))
    members = F.sort_array(F.collect_list(F.struct(ones.alias("ones"), "id", *[c for c in columns if c != "id"])))  # a block's rows
    lists = [F.flatten(f"m.{c}").alias(c) if dict(nodes.dtypes)[c].startswith("array") else F.col(f"m.{c}").alias(c) for c in columns]
    packed = materialise(dealt.groupBy("tile", "block").agg(members.alias("m")).select("tile", "block", *lists), "simhash-blocks")
    # Every block visits the blocks of its own and the neighbouring tiles; a block pair of one tile is met once.
    visits = packed.withColumn("to", F.explode(neighbours)).join(F.broadcast(blocks.select(F.col("tile").alias("to"), "blocks")), "to")
    visits = visits.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    visits = visits.where((F.col("to") != F.col("tile")) | (F.col("at") >= F.col("block")))
    same = ((F.col("to") == F.col("tile")) & (F.col("at") == F.col("block"))).alias("same")
    visits = visits.select(F.col("to").alias("tile"), F.col("at").alias("block"), same, *[F.col(c).alias(f"{c}_2") for c in columns])
    return packed.join(visits.hint("shuffle_hash"), ["tile", "block"]).drop("tile", "block")


def tile_links(nodes: DataFrame, tile: Column, neighbours: Column, radius: int, wide: int = 0, similarity: float = 0.0) -> DataFrame:
    """a, b: spanning forests of the links within the radius between ``nodes`` (id, fps, n).

    With ``wide``, links also have to lie within it on all words and in sizes, and the closest are taken first.
    """
    spark = nodes.sparkSession
    pairs = _block_pairs(nodes, tile, neighbours, F.ceil(F.count("*") / BLOCK), ("fps", "id", "n"))
    run = partial(_compare, radius=radius, wide=wide, similarity=similarity)
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "64")
    try:
        return materialise(pairs.mapInArrow(run, "a bigint, b bigint").distinct(), "simhash-links")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def _compare(batches: Iterator[pa.RecordBatch], radius: int, wide: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [], []
        for i in range(batch.num_rows):
            fps, node, n, same, fps2, node2, n2 = (batch.column(k)[i] for k in range(7))
            fps, node, n, fps2, node2, n2 = (c.values.to_numpy() for c in (fps, node, n, fps2, node2, n2))
            rows, columns = (np.ascontiguousarray(f.view(np.uint64).reshape(len(x), -1).T) for f, x in ((fps, node), (fps2, node2)))
            x, y = block_links(rows, columns, n, n2, same.as_py(), radius, wide, similarity)
            p, q = node[x], node2[y]
            a.append(np.maximum(p, q)[p != q])
            b.append(np.minimum(p, q)[p != q])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)) for c in (a, b)], names=["a", "b"])


def block_links(rows: np.ndarray, columns: np.ndarray, n: np.ndarray, n2: np.ndarray, same: bool, radius: int,
                wide: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) of links that connect all that the links of two blocks connect.

    ``rows`` and ``columns`` have 64 bits of each fingerprint in a line, and fingerprints in order of their bit counts.
    """
    size = rows.shape[1]
    parent = np.arange(size + (0 if same else columns.shape[1]))
    shift = 0 if same else size
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i, j, d in near_pairs(rows, columns, n, n2, same, radius, wide, similarity):
        for x, y in _forest(parent, i, j + shift, d if wide else None):
            out.append((x, y - shift))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def near_pairs(rows: np.ndarray, columns: np.ndarray, n: np.ndarray, n2: np.ndarray, same: bool, radius: int,
               wide: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All places (row, column) within the radii and their distances, rows ascending, some rows at a time."""
    counts, counts2 = (np.bitwise_count(x).sum(axis=0, dtype=np.int64) for x in (rows[:LEAD], columns[:LEAD]))
    size = rows.shape[1]
    for top in range(0, size, ROWS):
        part = rows[:, top : top + ROWS]
        low = np.searchsorted(counts2, counts[top] - radius, "left")
        high = np.searchsorted(counts2, counts[min(top + ROWS, size) - 1] + radius, "right")
        low = max(low, top) if same else low
        if low >= high:
            continue
        bits = np.bitwise_count(part[0][:, None] ^ columns[0][None, low:high])
        for a, b in zip(part[1:LEAD], columns[1:LEAD]):
            bits += np.bitwise_count(a[:, None] ^ b[None, low:high])
        i, j = np.nonzero(bits <= radius)
        d = bits[i, j]
        i, j = i + top, j + low
        if same:
            later = j > i
            i, j, d = i[later], j[later], d[later]
        if wide:
            for a, b in zip(rows[LEAD:], columns[LEAD:]):
                d = d + np.bitwise_count(a[i] ^ b[j]).astype(np.int16)
            small, large = np.minimum(n[i], n2[j]), np.maximum(n[i], n2[j])
            near = (small >= similarity * large) & (d <= wide + np.where(small < FEW, FEW_BITS, 0))
            i, j, d = i[near], j[near], d[near]
        yield i, j, d


def _forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray, d: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of joining each group by its first (or closest) link to another; ``parent`` holds the groups' names."""
    while len(i):
        a, b = parent[i], parent[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        if not len(i):
            return
        d = d[apart] if d is not None else None
        rank = np.arange(len(i)) if d is None else np.lexsort((np.arange(len(i)), d)).argsort()
        best = np.full(len(parent), len(i), np.int64)
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        by_rank = np.argsort(rank)
        chosen = by_rank[np.unique(best[best < len(i)])]
        yield i[chosen], j[chosen]
        # Groups that the chosen links connect get their smallest name.
        x, y, name = a[chosen], b[chosen], np.arange(len(parent))
        while True:
            least = np.minimum(name[x], name[y])
            before = name.copy()
            np.minimum.at(name, x, least)
            np.minimum.at(name, y, least)
            name = name[name]
            if (name == before).all():
                break
        parent[:] = name[parent]


# -- groups ------------------------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """id, root: the smallest id that each linked id reaches; links are a > b.

    Each round sends an id's other parents to its smallest one and every id to its parent's parent; a written
    table ends the round.  It is over when each id has one parent and no parent has a parent.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    while True:
        least = materialise(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("parents")), "components-least")
        grand = least.select(F.col("a").alias("b"), F.col("m").alias("up"))
        stepped = edges.join(grand, "b", "left").join(least.select("a", "m", "parents"), "a")
        if stepped.where("up IS NOT NULL OR parents > 1").limit(1).count() == 0:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        up = F.coalesce(F.col("up"), F.col("b"))
        links_out = F.array(
            F.struct(F.col("a"), F.least("m", up).alias("b")),
            F.struct(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")),
            F.struct(F.greatest("m", up).alias("a"), F.least("m", up).alias("b")),
        )
        edges = materialise(stepped.select(F.explode(links_out).alias("e")).select("e.a", "e.b").where("a <> b").distinct(), "components")


def simhash_groups(docs: DataFrame, radius: int = 2, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row: components of fingerprints that differ in at most ``radius`` bits."""
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    prints = materialise(fingerprints(chosen, width).select("doc_id", "fp"), "simhash-prints")
    # A fingerprint's node is its smallest doc_id, so the smallest node of a component is its name.
    nodes = prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"))
    nodes = materialise(nodes, "simhash-nodes")
    points = nodes.select("id", "fp", F.array("fp").alias("fps"), F.lit(0).cast("long").alias("n"))
    found = components(tile_links(points, popcount_tile("fp"), popcount_neighbours("tile", radius), radius))
    groups = materialise(nodes.join(found, "id", "left").select("fp", "copies", F.coalesce("root", "id").alias("component_id")), "simhash-groups")
    return join_copies(prints, groups, "fp").select("doc_id", "fp", "component_id")


def near_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, radius: int = 48, wide: int = 128, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, component_id, first of every row: texts connected by links of at least that similarity of shingle sets.

    ``first``: the row's text is that of the group's smallest doc_id, the smallest digest where that id has several of its texts.
    """
    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    prints = materialise(set_fingerprints(chosen, width).select("doc_id", "digest", "fps", "n"), "near-prints")
    nodes = prints.where("doc_id IS NOT NULL").groupBy("digest", "fps", "n").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialise(nodes.withColumn("id", F.monotonically_increasing_id()), "near-nodes")  # one for each text, whatever its doc_id
    tile = size_tile("n", similarity)
    links = tile_links(nodes.select("id", "fps", "n"), tile, F.array(F.col("tile"), F.col("tile") + 1), radius, wide, similarity)
    held = _texts_of_links(links, chosen, nodes)
    passed = materialise(_verified(links, held, width, similarity), "near-passed")
    found = components(_rechecked(links, passed, held, nodes, width, similarity, radius, wide))
    found = materialise(found, "near-found")
    rooted = nodes.join(found.union(found.select("root", "root").distinct()), "id", "left").select("digest", "least", "root", "copies")
    # A row for each group of two texts or more.
    firsts = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("least", "digest")).alias("group"))
    groups = rooted.join(broadcast_if_small(materialise(firsts, "near-firsts")), "root", "left")
    component, is_first = F.coalesce("group.least", "least"), F.coalesce(F.col("group.digest") == F.col("digest"), F.lit(True))
    groups = materialise(groups.select("digest", component.alias("component_id"), is_first.alias("first"), "copies"), "near-groups")
    return join_copies(prints, groups, "digest").select("doc_id", "digest", "component_id", "first")


def _texts_of_links(links: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, text of the nodes that have links."""
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    keys = nodes.join(ends, "id", "left_semi").select("id", F.col("least").alias("doc_id"), "digest")
    return materialise(texts.join(broadcast_if_small(keys), ["doc_id", "digest"]).groupBy("id").agg(F.first("text").alias("text")), "near-texts")


def _verified(links: DataFrame, held: DataFrame, width: int, similarity: float) -> DataFrame:
    """The links whose documents have that similarity."""
    both = links.join(held.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    both = both.join(held.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: OrderedDict[int, np.ndarray] = OrderedDict()

        def shingles(node: int, text: str) -> np.ndarray:
            if node not in known:
                known[node] = np.unique(shingle_hashes(text, width))
                if len(known) > 200:
                    known.popitem(last=False)
            known.move_to_end(node)
            return known[node]

        for batch in batches:
            kept = []
            for a, b, x, y in zip(*(column_values(batch, c) for c in ("a", "b", "text_a", "text_b"))):
                p, q = shingles(a, x), shingles(b, y)
                common = len(np.intersect1d(p, q, assume_unique=True))
                if common >= similarity * (len(p) + len(q) - common):
                    kept.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([k[c] for k in kept], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return map_batches(both.select("a", "b", "text_a", "text_b"), run, "a bigint, b bigint")


def _rechecked(links: DataFrame, passed: DataFrame, held: DataFrame, nodes: DataFrame, width: int, similarity: float, radius: int, wide: int) -> DataFrame:
    """``passed`` and the links that failed ones have displaced from the forests.

    A candidate outside the forests joins documents that forest links connect; where all of these passed, it adds nothing.
    So only documents connected with a failed link are compared again, now with their shingle sets at hand: every
    candidate between two groups is checked, unless a checked one has joined them.
    """
    spark = links.sparkSession
    failed = materialise(links.join(passed, ["a", "b"], "left_anti"), "near-failed")
    if failed.isEmpty():
        return passed
    around = components(links)
    roots = materialise(around.join(failed.select(F.col("a").alias("id")), "id", "left_semi").select("root").distinct(), "near-roots")
    members = around.join(broadcast_if_small(roots), "root", "left_semi").select("id").union(roots.select(F.col("root").alias("id")))
    points = nodes.select("id", "fps", "n").join(members, "id", "left_semi").join(components(passed).withColumnRenamed("root", "label"), "id", "left")
    points = points.withColumn("label", F.coalesce("label", "id")).join(held, "id")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        sets = [np.unique(shingle_hashes(t, width)) for t in texts_of(batch, "text")]
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        ends = pa.array(np.cumsum([0, *map(len, sets)]), pa.int32())
        return [pa.ListArray.from_arrays(ends, pa.array(flat, pa.int64()))]

    points = materialise(append_columns(points, "hashes array<bigint>", run).drop("text"), "near-sets")
    tile, blocks = size_tile("n", similarity), F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / HASHES, F.lit(1)))
    pairs = _block_pairs(points, tile, F.array(F.col("tile"), F.col("tile") + 1), blocks, ("fps", "id", "n", "label", "hashes"))
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        run = partial(_compare_sets, radius=radius, wide=wide, similarity=similarity)
        return passed.union(materialise(pairs.mapInArrow(run, "a bigint, b bigint").distinct(), "near-rechecked"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def _compare_sets(batches: Iterator[pa.RecordBatch], radius: int, wide: int, similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i in range(batch.num_rows):
            cells = [batch.column(k)[i] for k in range(11)]
            same = cells.pop(5).as_py()
            fps, node, n, label, hashes, fps2, node2, n2, label2, hashes2 = (c.values.to_numpy() for c in cells)
            rows, columns = (np.ascontiguousarray(f.view(np.uint64).reshape(len(x), -1).T) for f, x in ((fps, node), (fps2, node2)))
            x, y = checked_links(near_pairs(rows, columns, n, n2, same, radius, wide, similarity), n, n2, label, label2, hashes, hashes2, similarity)
            a.append(np.maximum(node[x], node2[y]))
            b.append(np.minimum(node[x], node2[y]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (a, b)], names=["a", "b"])


def checked_links(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], n: np.ndarray, n2: np.ndarray, label: np.ndarray,
                  label2: np.ndarray, hashes: np.ndarray, hashes2: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of that similarity that join all groups (labels) which such pairs join."""
    _, group = np.unique(np.concatenate([label, label2]), return_inverse=True)
    names, numbers = np.unique(np.concatenate([hashes, hashes2]), return_inverse=True)
    parent, marks = np.arange(len(group)), np.zeros(len(names), bool)
    group, group2, numbers, numbers2 = group[: len(n)], group[len(n) :], numbers[: len(hashes)], numbers[len(hashes) :]
    start, start2 = (np.cumsum(x) - x for x in (n, n2))
    out: list[tuple[int, int]] = []
    for i, j, _ in pairs:
        apart = parent[group[i]] != parent[group2[j]]
        i, j = i[apart], j[apart]
        row, first = np.unique(i, return_index=True)
        for x, to in zip(row.tolist(), np.split(j, first[1:])):
            to = to[parent[group2[to]] != parent[group[x]]]
            if not len(to):
                continue
            own = numbers[start[x] : start[x] + n[x]]
            marks[own] = True
            ends = np.cumsum(n2[to])
            places = np.arange(ends[-1]) + np.repeat(start2[to] - ends + n2[to], n2[to])
            seen = np.concatenate([[0], np.cumsum(marks[numbers2[places]])])
            marks[own] = False
            common = seen[ends] - seen[ends - n2[to]]
            for y in to[common >= similarity * (n[x] + n2[to] - common)].tolist():
                old, new = parent[group2[y]], parent[group[x]]
                if old != new:
                    parent[parent == old] = new
                    out.append((x, y))
    links = np.array(out, np.int64).reshape(-1, 2)
    return links[:, 0], links[:, 1]


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is that of the smallest doc_id of its group.

    Rows with a null doc_id stay, and of rows that repeat a doc_id with the same text one stays: that with the smallest
    hash of all columns.  Rows that repeat a doc_id with a text of another group stay as well.
    """
    grouped = near_groups(docs, doc_id=doc_id, text=text)
    row = ["__doc_id", "__digest"]
    keyed = docs.withColumns({"__doc_id": F.col(doc_id).cast("long"), "__digest": F.unhex(F.sha2(text_or_empty(text), 256))})
    # The smallest doc_id of a text; larger ones are copies.
    others = grouped.where("doc_id IS NOT NULL AND (NOT first OR doc_id <> component_id)").select(F.col("doc_id").alias("__doc_id"), F.col("digest").alias("__digest"))
    left = keyed.join(broadcast_if_small(materialise(others.distinct(), "near-dropped")), row, "left_anti")
    repeated = keyed.where("__doc_id IS NOT NULL").groupBy(*row).count().where("count > 1").select(*row)
    repeated = materialise(repeated, "near-repeated")
    if repeated.isEmpty():
        return left.select(*docs.columns)
    again = left.join(broadcast_if_small(repeated), row, "left_semi")
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind]
    again = again.groupBy(*row).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("r")).select("r.*")
    return left.join(broadcast_if_small(repeated), row, "left_anti").select(*docs.columns).unionByName(again)
