"""Prefix trie of conversations by time-forward processing.

A node is a distinct sequence of first turns; its name is (smallest member, depth), for a conversation has one node
at a depth.  Sequences are compared by sums of hashes of (depth, turn), 192 bits taken from SHA-256 digests of the
turns, so prefixes of a long conversation are running sums, and those are made block by block.

Subtree totals: nodes are dealt into shards, ranges of their names, and each shard is sorted externally (by
Spark's sort) in reverse level order.  A task streams through it: a node takes the messages for it from a priority
queue, which keeps what exceeds its memory in sorted temporary runs, and sends its total to its parent through
the queue.  Messages for nodes of other shards leave it, one for each shard and target.  These targets form a smaller
tree: each hangs below the node at which its own shard's message leaves.  It is solved the same way, and its totals come
into the shards as further messages in a second pass.  A shard is bounded; where the tree of
messages is small, or does not get smaller, it is one shard, whose memory the queue bounds.

Turns are ordered by their number, null first, ties by role and text; a null role or text is empty.  Rows without
a conversation id take no part.  A conversation without turns is a member of the root.  An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import marshal
import tempfile
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contrail.llm.common import RANKS, column_values, join_groups, map_batches, materialise, ranked
from contrail.session import broadcast_if_small

WORD = r"[^\x20\x09-\x0D]+"
SUMS = 6  # 32-bit hashes that are summed
MANY = 1000  # children of a node that are told its name by a broadcast or a join of their own
IDS = 4096  # conversation ids joined to one text
QUEUE, RUN = 100_000, 1000  # messages a queue keeps in memory, and those read from a run at a time
SHARD_LEAST, SHARD_MOST = 1000, 200_000  # nodes of a shard


# -- sequences ---------------------------------------------------------------------------------------


def numbered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """c, rank, content (digest), words of every turn in order."""
    rows = turns.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("c"), F.col(turn).alias("turn"), *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(a) for x, a in ((role, "role"), (text, "text"))])
    content = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    return ranked(rows, ["c", "turn", "role", "text"], [F.col("c"), content.alias("content"), words.alias("words")], "trie-turns")


def rebuilt(turns: DataFrame, base_of: Column, head_of: Column) -> tuple[DataFrame, DataFrame]:
    """Sequences (c, block, depth, content, words) and conversations (c, length).

    The first ``head_of`` turns of a conversation c are those of conversation ``base_of`` (all if it has fewer, none if there is
    none), then its own follow after its first ``head_of``.  A group of (c, block) has RANKS rows and a head at most.
    """
    convs = materialise(turns.groupBy("c").agg(F.min("rank").alias("start"), F.count("*").alias("n")).select("*", head_of.alias("h"), base_of.alias("b")), "trie-convs")
    sizes = convs.select(F.col("c").alias("b"), F.col("n").alias("base_n"))
    convs = convs.join(sizes, "b", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0)))).drop("base_n")
    convs = materialise(convs, "trie-heads")
    numbered = join_groups(turns, convs.select("c", "start", "n", "h", "m"), "c").withColumn("d", F.col("rank") - F.col("start") + 1)
    numbered = materialise(numbered.select("c", "d", "content", "words", "h", "m"), "trie-numbered")
    own = numbered.where("d > h").select("c", F.expr(f"(d - 1) div {RANKS}").alias("block"), (F.col("d") - F.col("h") + F.col("m")).alias("depth"), "content", "words")
    most = convs.agg(F.max("h")).first()[0] or 0
    heads = numbered.where(F.col("d") <= most).select(F.col("c").alias("b"), F.col("d").alias("depth"), "content", "words")
    heads = heads.join(convs.where("m > 0").select("c", "b", "m"), "b").where("depth <= m")
    heads = heads.select("c", F.lit(0).cast("long").alias("block"), "depth", "content", "words")
    return own.unionByName(heads), convs.select("c", (F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


def _key(depth: Column, sums: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat_ws(",", depth.cast("string"), *[s.cast("string") for s in sums]), 256))


def _root() -> Column:
    return _key(F.lit(0), [F.lit(0)] * SUMS)


def prefix_rows(sequences: DataFrame, lengths: DataFrame) -> DataFrame:
    """c, depth, key, up (key of the prefix without the last turn), words, last of every prefix but the empty one."""
    halves = []
    for k in range(SUMS // 2):
        x = F.xxhash64("depth", "content", F.lit(k))
        halves += [F.shiftrightunsigned(x, 32), x.bitwiseAND(0xFFFFFFFF)]
    hashed = sequences.select("*", *[x.alias(f"x{k}") for k, x in enumerate(halves)])
    inner = Window.partitionBy("c", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    totals = hashed.groupBy("c", "block").agg(*[F.sum(f"x{k}").alias(f"t{k}") for k in range(SUMS)])
    later = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # Only conversations with several blocks have carries: a row for each RANKS of their turns.
    long = sequences.where("block > 0").select("c").distinct()
    carries = totals.join(long, "c", "left_semi").select("c", "block", *[F.sum(f"t{k}").over(later).alias(f"t{k}") for k in range(SUMS)]).where("block > 0")
    rows = hashed.select("*", *[F.sum(f"x{k}").over(inner).alias(f"s{k}") for k in range(SUMS)]).join(carries, ["c", "block"], "left")
    here = [F.col(f"s{k}") + F.coalesce(f"t{k}", F.lit(0)) for k in range(SUMS)]
    before = [s - F.col(f"x{k}") for k, s in enumerate(here)]
    rows = rows.select("c", "block", "depth", "words", _key(F.col("depth"), here).alias("key"), _key(F.col("depth") - 1, before).alias("up"))
    # The last turn of a conversation: its depth is the length; block by block, as one conversation may hold many rows.
    ends = lengths.select("c", F.col("length").alias("depth"), F.lit(True).alias("last"))
    return materialise(rows.join(ends, ["c", "depth"], "left").select("c", "depth", "key", "up", "words", F.coalesce("last", F.lit(False)).alias("last")), "trie-prefixes")


# -- nodes -------------------------------------------------------------------------------------------


def trie_nodes(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """key, conv, depth, parent, members, ends, words: a row for each node."""
    found = rows.groupBy("key").agg(F.min("c").alias("conv"), F.max("depth").alias("depth"), F.count("*").alias("members"), F.count_if("last").alias("ends"),
                                    F.max("words").alias("words"), F.max("up").alias("up"))
    top = lengths.agg(F.min("c").alias("conv"), F.count("*").alias("members"), F.count_if(F.col("length") == 0).alias("ends")).where("members > 0")
    top = top.select(_root().alias("key"), "conv", F.lit(0).cast("long").alias("depth"), "members", "ends", F.lit(0).cast("long").alias("words"), F.lit(None).cast("binary").alias("up"))
    nodes = materialise(found.unionByName(top), "trie-nodes")
    names = nodes.select(F.col("key").alias("up"), F.col("conv").alias("parent"))
    below = nodes.where("depth > 0")
    # Nodes with many children, at most one in MANY of all.
    large = below.groupBy("up").count().where(F.col("count") >= MANY).join(names, "up").select("up", "parent")
    marked = below.join(broadcast_if_small(materialise(large, "trie-large")), "up", "left")
    rest = marked.where("parent IS NULL").drop("parent").join(names, "up")
    columns = ["key", "conv", "depth", "parent", "members", "ends", "words"]
    top = nodes.where("depth = 0").withColumn("parent", F.lit(None).cast("long"))
    return materialise(marked.where("parent IS NOT NULL").select(columns).unionByName(rest.select(columns)).unionByName(top.select(columns)), "trie-named")


def ends_digests(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """key, ends_sha256: SHA-256 of the ids of the conversations that end at a node, ascending, joined by commas.

    Ids in order are dealt into ranges whatever their node; a node within one range is done there, and for others texts
    of IDS ids are left to hash one after the other.
    """
    ends = rows.where("last").select("key", "c").union(lengths.where("length = 0").select(_root().alias("key"), "c"))
    ordered = ends.repartitionByRange("key", "c").sortWithinPartitions("key", "c")
    parts = materialise(map_batches(ordered, _join_ids, "key binary, first bigint, ids string, digest string"), "trie-ends")
    cut = parts.where("digest IS NULL").select("key", "first", "ids").repartition("key").sortWithinPartitions("key", "first")
    whole = map_batches(cut, _hash_ids, "key binary, ends_sha256 string")
    return parts.where("digest IS NOT NULL").select("key", F.col("digest").alias("ends_sha256")).union(whole)


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal keys as a digest, or as texts where a run may go on in another partition or is long."""
    key, ids, texts, first_run = None, [], 0, True
    for batch in batches:
        out: list[tuple] = []
        for k, c in zip(column_values(batch, "key"), column_values(batch, "c")):
            if k != key or len(ids) == IDS:
                if ids:
                    text, open_run = ",".join(map(str, ids)), first_run or texts or k == key
                    out.append((key, ids[0], text, None) if open_run else (key, ids[0], None, hashlib.sha256(text.encode()).hexdigest()))
                if k != key:
                    texts, first_run = 0, key is None
                else:
                    texts += 1
                key, ids = k, []
            ids.append(c)
        yield _rows(out, ("key", "first", "ids", "digest"), (pa.binary(), pa.int64(), pa.string(), pa.string()))
    if ids:
        yield _rows([(key, ids[0], ",".join(map(str, ids)), None)], ("key", "first", "ids", "digest"), (pa.binary(), pa.int64(), pa.string(), pa.string()))


def _hash_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = None, None
    for batch in batches:
        out = []
        for k, text in zip(column_values(batch, "key"), column_values(batch, "ids")):
            if k == key:
                state.update(b"," + text.encode())
                continue
            if state is not None:
                out.append((key, state.hexdigest()))
            key, state = k, hashlib.sha256(text.encode())
        yield _rows(out, ("key", "ends_sha256"), (pa.binary(), pa.string()))
    if state is not None:
        yield _rows([(key, state.hexdigest())], ("key", "ends_sha256"), (pa.binary(), pa.string()))


def _rows(rows: list[tuple], names: tuple[str, ...], types: tuple[pa.DataType, ...]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=list(names))


# -- totals ------------------------------------------------------------------------------------------


class SpillingQueue:
    """Priority queue of tuples; beyond ``limit`` in memory they are sorted runs in temporary files, merged as they are read."""

    def __init__(self, limit: int = QUEUE):
        self.limit, self.heap, self.fronts = limit, [], []

    def push(self, item: tuple) -> None:
        heappush(self.heap, item)
        if len(self.heap) > self.limit:
            run = self._run(sorted(self.heap))
            self.heap = []
            self._advance(run)

    def _run(self, items: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()  # in the task's own folder, gone with the queue
        for i in range(0, len(items), RUN):
            marshal.dump(items[i : i + RUN], file)
        blocks = range(0, len(items), RUN)
        file.seek(0)
        return (item for _ in blocks for item in marshal.load(file))

    def _advance(self, run: Iterator[tuple]) -> None:
        front = next(run, None)
        if front is not None:
            heappush(self.fronts, (front, id(run), run))

    def first(self) -> tuple | None:
        if self.fronts and (not self.heap or self.fronts[0][0] < self.heap[0]):
            return self.fronts[0][0]
        return self.heap[0] if self.heap else None

    def pop(self) -> tuple:
        if self.fronts and (not self.heap or self.fronts[0][0] < self.heap[0]):
            front, _, run = heappop(self.fronts)
            self._advance(run)
            return front
        return heappop(self.heap)


ID = ("level", "a", "b")
UP = ("up_level", "up_a", "up_b")
NODE_FIELDS = "shard bigint, level bigint, a bigint, b string, up_level bigint, up_a bigint, up_b string, leaves bigint, saved bigint, kids bigint, message boolean"
SENT_FIELDS = "leaves_shard boolean, shard bigint, to_shard bigint, level bigint, a bigint, b string, leaves bigint, saved bigint, kids bigint"
_SENT_TYPES = (pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
_SENT_NAMES = ("leaves_shard", "shard", "to_shard", "level", "a", "b", "leaves", "saved", "kids")


def _forward(batches: Iterator[pa.RecordBatch], bounds: list[tuple], queue: int) -> Iterator[pa.RecordBatch]:
    """Nodes and messages of shards in reverse level order -> totals of nodes, and the messages that leave a shard, summed by target."""
    shard, waiting = None, SpillingQueue(queue)
    out: list[tuple] = []

    def sent(until: tuple | None) -> None:
        """Messages for places before ``until``: no such node is in this shard."""
        while (head := waiting.first()) is not None and (until is None or head[:3] < until):
            leaves, saved, kids = take(head[:3])
            name = (-head[0], head[1], head[2])
            out.append((True, shard, bisect_right(bounds, (name[1], name[0], name[2])) - 1, *name, leaves, saved, kids))

    def take(place: tuple) -> tuple[int, int, int]:
        leaves = saved = kids = 0
        while (head := waiting.first()) is not None and head[:3] == place:
            waiting.pop()
            leaves, saved, kids = leaves + head[3], saved + head[4], kids + head[5]
        return leaves, saved, kids

    for batch in batches:
        for at, level, a, b, up_level, up_a, up_b, leaves, saved, kids, message in zip(*(c.to_pylist() for c in batch.columns)):
            if at != shard:
                sent(None)
                shard = at
            place = (-level, a, b)
            if message:
                waiting.push((*place, leaves, saved, kids))
                continue
            sent(place)
            more = take(place)
            leaves, saved = leaves + more[0], saved + more[1]
            out.append((False, shard, shard, level, a, b, leaves, saved, more[2]))
            if up_level is not None:
                waiting.push((-up_level, up_a, up_b, leaves, saved, 1))
        yield _rows(out, _SENT_NAMES, _SENT_TYPES)
        out = []
    sent(None)
    if out:
        yield _rows(out, _SENT_NAMES, _SENT_TYPES)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a shard from the top down -> for each target of messages the node at which its own shard's message leaves, if any."""
    shard, exits = None, {}
    for batch in batches:
        out = []
        for at, level, a, b, up_level, up_a, up_b, _, _, _, message in zip(*(c.to_pylist() for c in batch.columns)):
            if at != shard:
                shard, exits = at, {}  # bounded by the nodes of a shard
            if message:
                out.append((at, level, a, b, *(exits[level, a, b] or (None, None, None))))
            else:
                up = (up_level, up_a, up_b)
                exits[level, a, b] = None if up_level is None else exits.get(up, up)
        yield _rows(out, ("to_shard", *ID, *UP), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))


def subtree_totals(nodes: DataFrame, shard_nodes: int | None = None, queue: int = QUEUE) -> DataFrame:
    """level, a, b, leaves, saved, kids: sums over subtrees and the number of children.

    ``nodes``: level, a, b (together the name), up_level, up_a, up_b (the parent; null: none), leaves, saved (own values).
    """
    spark = nodes.sparkSession
    order = ["a", "level", "b"]
    placed = ranked(nodes, order, [F.col(c) for c in (*ID, *UP, "leaves", "saved")], "forward-nodes")
    count = placed.count()
    if shard_nodes is None:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        shard_nodes = min(max(-(-count // parts), SHARD_LEAST), SHARD_MOST)
    shards = max(1, -(-count // shard_nodes))
    placed = placed.select(F.expr(f"rank div {shard_nodes}").alias("shard"), *ID, *UP, "leaves", "saved", F.lit(0).cast("long").alias("kids"), F.lit(False).alias("message"))
    placed = materialise(placed, "forward-shards")
    # The first name of each shard: three values a shard.
    firsts = placed.groupBy("shard").agg(F.min(F.struct(*order)).alias("x")).orderBy("shard").collect() if shards > 1 else []
    bounds = [tuple(r["x"]) for r in firsts]
    forward = partial(_forward, bounds=bounds, queue=queue)

    def in_shards(rows: DataFrame, down: bool) -> DataFrame:
        level = F.col("level") if down else F.col("level").desc()
        return rows.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", level, "a", "b", F.col("message") if down else F.col("message").desc())

    first = materialise(map_batches(in_shards(placed, False), forward, SENT_FIELDS), "forward-first")
    if shards == 1:
        return first.where("NOT leaves_shard").select(*ID, "leaves", "saved", "kids")
    left = first.where("leaves_shard")
    targets = left.select(F.col("to_shard").alias("shard"), *ID).distinct()
    nothing = {c: F.lit(None).cast("string" if c == "up_b" else "long") for c in UP} | {c: F.lit(0).cast("long") for c in ("leaves", "saved", "kids")}
    asked = targets.withColumns(nothing | {"message": F.lit(True)}).select(placed.columns)
    exits = map_batches(in_shards(placed.unionByName(asked), True), _exits, "to_shard bigint, level bigint, a bigint, b string, up_level bigint, up_a bigint, up_b string")
    # Messages of one shard to one target are a node of the tree across shards.
    across = left.select("shard", *ID, "leaves", "saved").join(materialise(exits, "forward-exits"), list(ID))
    across = across.select("level", "a", F.concat_ws("/", "b", F.col("shard").cast("string")).alias("b"), "up_level", "up_a",
                           F.when(F.col("up_level").isNotNull(), F.concat_ws("/", "up_b", F.col("to_shard").cast("string"))).alias("up_b"), "leaves", "saved")
    across = materialise(across, "forward-across")
    n = across.count()
    solved = subtree_totals(across, max(n, 1) if n <= SHARD_LEAST or 2 * n > count else None, queue)
    own = solved.select(F.lit(None).cast("long").alias("shard"), "level", "a", F.regexp_replace("b", "/[0-9]+$", "").alias("b"), "leaves", "saved", F.lit(0).cast("long").alias("kids"))
    told = own.union(left.select(F.col("to_shard").alias("shard"), *ID, F.lit(0).cast("long"), F.lit(0).cast("long"), "kids"))
    told = told.groupBy(*ID).agg(F.max("shard").alias("shard"), *[F.sum(c).alias(c) for c in ("leaves", "saved", "kids")])
    told = told.withColumns({c: nothing[c] for c in UP} | {"message": F.lit(True)}).select(placed.columns)
    second = map_batches(in_shards(placed.unionByName(materialise(told, "forward-told")), False), forward, SENT_FIELDS)
    return second.where("NOT leaves_shard").select(*ID, "leaves", "saved", "kids")


def prefix_trie(turns: DataFrame, base_of: Column, head_of: Column, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                shard_nodes: int | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    ``base_of`` and ``head_of``: which conversation (of ``c``) lends how many first turns; ``c`` and 0 leave it as it is.
    """
    sequences, lengths = rebuilt(numbered_turns(turns, conv_id, turn, role, text), base_of, head_of)
    rows = prefix_rows(sequences, lengths)
    nodes = trie_nodes(rows, lengths)
    flat = nodes.select(F.col("depth").alias("level"), F.col("conv").alias("a"), F.lit("").alias("b"),
                        F.when(F.col("depth") > 0, F.col("depth") - 1).alias("up_level"), F.col("parent").alias("up_a"), F.when(F.col("depth") > 0, F.lit("")).alias("up_b"),
                        (F.col("ends") == F.col("members")).cast("long").alias("leaves"), ((F.col("members") - 1) * F.col("words")).alias("saved"))
    totals = subtree_totals(flat, shard_nodes).select(F.col("level").alias("depth"), F.col("a").alias("conv"), "leaves", "saved", "kids")
    found = nodes.join(totals, ["depth", "conv"]).join(ends_digests(rows, lengths), "key", "left")
    return found.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("members").alias("n_convs"), F.col("kids").alias("n_children"),
                        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
