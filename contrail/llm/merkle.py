"""Merkle manifest of a dataset, and a recursive query that climbs it from every leaf.

Rows are leaves.  The leaves of a group are in order, and every FAN consecutive nodes of a level are hashed to
one node of the next, until one is left, the group's subroot; the subroots, in order of their groups, give the
root the same way.  Levels are written one by one as rows that name their parent and their place below it.

``climb`` verifies presented leaves against the stored levels: a recursive query ascends from each run of leaves
(the children of one node, FAN at most), and at each level puts down the siblings it passes and folds the hash
of every leaf of the run with them.  Leaves of one run have all siblings above their parent in common, so these
are carried once a run.  At the end siblings become the proof and the last fold is the root that the presented
leaf leads to.

A null value counts as ``-``.  The null group comes first and null ids come first in their group; rows that tie in
group and id go in the order of their hashes.  A lone leaf is the subroot of its group, a lone subroot the root; the
proof of a lone leaf is the hash of nothing.  An empty table has an empty manifest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrail.llm.common import fresh_path, join_groups, materialise, ranked
from contrail.session import broadcast_if_small

FAN = 8
# A node's number: that of its first leaf times 64, plus its level; levels above the subroots count from 32 on.
LEVELS, ABOVE = 64, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def value_text(c: Column) -> Column:
    """``-`` for a null, else the count of bytes, a colon and the value."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(value_text, values)), 256)


@dataclass
class Manifest:
    """runs: run, g, members (place, digest, id, presented), the run's parent and place; nodes: node, parent, place, kids (digests)."""

    runs: DataFrame
    nodes: DataFrame
    subroots: DataFrame  # g, subroot
    root: str | None


def _grow(cur: DataFrame, most: int, tag: int, name: str, top_parent: Column, top_place: Column, kept: Sequence[str] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Levels above ``cur`` (g, s, n, i, digest: node i of the n of tree g, whose first leaf is s), and g, digest of the trees' tops."""
    levels, tops, level = [], cur.where("n = 1").select("g", "digest"), 0
    while most > 1:
        level += 1
        members = F.sort_array(F.collect_list(F.struct(F.expr(f"CAST(i % {FAN} AS INT)").alias("place"), "digest", *kept)))  # FAN at most
        up = cur.where("n > 1").groupBy("g", "s", "n", F.expr(f"i div {FAN}").alias("at")).agg(members.alias("members"))
        up = up.select("g", "s", F.expr(f"(n + {FAN - 1}) div {FAN}").alias("n"), F.col("at").alias("i"), "members",
                       F.sha2(F.array_join("members.digest", ""), 256).alias("digest"))
        up = up.withColumn("node", F.expr(f"(s + i * {FAN**level}) * {LEVELS} + {tag + level}"))
        parent = F.expr(f"(s + i div {FAN} * {FAN ** (level + 1)}) * {LEVELS} + {tag + level + 1}")
        up = up.withColumn("parent", F.when(F.col("n") > 1, parent).otherwise(top_parent))
        up = up.withColumn("place", F.when(F.col("n") > 1, F.expr(f"i % {FAN}")).otherwise(top_place).cast("int"))
        levels.append(up := materialise(up, f"{name}-{level}"))
        tops = tops.union(up.where("n = 1").select("g", "digest"))
        cur, kept, most = up, (), -(-most // FAN)
    return levels, tops


def build(leaves: DataFrame, group: str = "group", leaf_id: str = "id") -> Manifest | None:
    """Manifest of ``leaves`` (group, id, digest, presented); None where there are none."""
    order = [group, leaf_id, "digest"]
    rows = ranked(leaves, order, [F.col(group).alias("group"), F.col(leaf_id).alias("id"), F.col("digest"), F.col("presented")], "merkle-leaves")
    groups = materialise(rows.groupBy("group").agg(F.min("rank").alias("start"), F.count("*").alias("n")), "merkle-groups")
    size = groups.agg(F.count("*").alias("groups"), F.max("n").alias("most")).first()
    if not size["groups"]:
        return None
    numbered = ranked(groups, ["group"], [F.col(c) for c in groups.columns], "merkle-numbers").withColumnRenamed("rank", "g")
    base = join_groups(rows, numbered, "group").select("g", F.col("start").alias("s"), "n", (F.col("rank") - F.col("start")).alias("i"), "digest", "id", "presented")
    several = F.lit(size["groups"] > 1)
    above = F.when(several, F.expr(f"g div {FAN} * {FAN} * {LEVELS} + {ABOVE + 1}"))
    place = F.when(several, F.expr(f"g % {FAN}"))
    levels, tops = _grow(base, size["most"], 0, "merkle-level", above, place, ("id", "presented"))
    subroots = materialise(tops.select("g", F.col("digest").alias("subroot")), "merkle-subroots")
    forest = subroots.select(F.lit(0).cast("long").alias("g"), F.lit(0).cast("long").alias("s"), F.lit(size["groups"]).cast("long").alias("n"),
                             F.col("g").alias("i"), F.col("subroot").alias("digest"))
    nothing = F.lit(None).cast("long")
    upper, root = _grow(forest, size["groups"], ABOVE, "merkle-top", nothing, nothing)
    lone = base.where("n = 1").select(F.expr(f"s * {LEVELS}").alias("run"), "g", F.array(F.struct(F.lit(0).alias("place"), "digest", "id", "presented")).alias("members"),
                                      above.alias("parent"), place.cast("int").alias("place"))
    runs = [lone, *(x.select(F.col("node").alias("run"), "g", "members", "parent", "place") for x in levels[:1])]
    kinds = ("node", "parent", "place", F.col("members.digest").alias("kids"))
    nodes = [x.select(*kinds) for x in [*levels[1:], *upper]]
    return Manifest(_union(runs), _union(nodes) if nodes else None, subroots, root.first()["digest"])


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _before(kids: Column | str, place: Column) -> Column:
    return F.array_join(F.slice(kids, F.lit(1), place), "")


def _after(kids: Column | str, place: Column) -> Column:
    return F.array_join(F.slice(kids, place + 2, F.lit(FAN)), "")


CLIMB = f"""
WITH RECURSIVE climb(run, step, parent, place, siblings, folded) AS (
    SELECT run, step, parent, place, siblings, folded FROM {{start}}
    UNION ALL
    SELECT c.run, c.step + 1, n.parent, n.place,
        concat(array_join(slice(n.kids, 1, c.place), ''), array_join(slice(n.kids, c.place + 2, {FAN}), '')),
        transform(c.folded, f -> sha2(concat(array_join(slice(n.kids, 1, c.place), ''), f, array_join(slice(n.kids, c.place + 2, {FAN}), '')), 256))
    FROM climb c JOIN {{nodes}} n ON n.node = c.parent)
SELECT run, step, siblings, folded FROM climb
"""


def climb(manifest: Manifest) -> DataFrame:
    """id, leaf, subroot, root, proof (all siblings in order of the climb, as one hash), folded_root, verified of every leaf."""
    spark = manifest.runs.sparkSession
    digests, hashed = F.col("members.digest"), F.col("run") % LEVELS > 0  # the lone leaf of a group is no run of a node
    first = F.transform("members", lambda m, k: F.when(hashed, F.sha2(F.concat(_before(digests, k), m["presented"], _after(digests, k)), 256)).otherwise(m["presented"]))
    start = manifest.runs.select("run", F.lit(0).alias("step"), "parent", "place", F.lit("").alias("siblings"), first.alias("folded"))
    start = materialise(start, "merkle-start")
    path = start.select("run", "step", "siblings", "folded")
    if manifest.nodes is not None:
        limit = spark.conf.get("spark.sql.cteRecursionRowLimit")
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # a row for each run and level; the depth is that of the tree
        try:
            path = materialise(spark.sql(CLIMB, start=start, nodes=manifest.nodes), "merkle-climb")
        finally:
            spark.conf.set("spark.sql.cteRecursionRowLimit", limit)
    steps = F.transform(F.sort_array(F.collect_list(F.struct("step", "siblings"))), lambda x: x["siblings"])  # one for each level
    path = path.groupBy("run").agg(F.array_join(steps, "").alias("upper"), F.max_by("folded", "step").alias("folded"))
    found = manifest.runs.join(path, "run").join(broadcast_if_small(manifest.subroots), "g")
    proof = lambda k: F.sha2(F.concat(_before(digests, k), _after(digests, k), "upper"), 256)
    leaves = F.transform("members", lambda m, k: F.struct(m["id"].alias("id"), m["digest"].alias("leaf"), proof(k).alias("proof"), F.get("folded", k).alias("folded_root")))
    rows = found.select("subroot", F.inline(leaves))
    root = F.lit(manifest.root)
    return rows.select("id", "leaf", "subroot", root.alias("root"), "proof", "folded_root", (F.col("folded_root") == root).alias("verified"))


def document_leaves(docs: DataFrame, tampered: Column, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang",
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """group, id, digest and what is presented for it: rows where ``tampered`` holds come with A-Z of the text in lower case."""
    altered = [F.translate(F.col(c).cast("string"), UPPER, LOWER) if c == text else F.col(c) for c in columns]
    digest = row_hash([F.col(c) for c in columns])
    presented = F.when(F.coalesce(tampered, F.lit(False)), row_hash(altered)).otherwise(digest)
    return docs.select(F.col(group).alias("group"), F.col(doc_id).alias("id"), digest.alias("digest"), presented.alias("presented"))


def manifest_rows(docs: DataFrame, tampered: Column, doc_id: str = "doc_id") -> DataFrame:
    """Build the manifest of ``docs`` and climb it from every leaf."""
    manifest = build(document_leaves(docs, tampered, doc_id=doc_id))
    if manifest is None:
        kind = docs.schema[doc_id].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"id {kind}, leaf string, subroot string, root string, proof string, folded_root string, verified boolean")
    return climb(manifest)


def write_manifest(manifest: Manifest, path: str | None = None) -> str:
    """The levels above the runs as one Parquet table; returns its path."""
    path = path or fresh_path(manifest.runs.sparkSession, "manifest")
    runs = manifest.runs.select(F.col("run").alias("node"), "parent", "place", F.col("members.digest").alias("kids"))
    (runs if manifest.nodes is None else runs.unionByName(manifest.nodes)).write.parquet(path)
    return path
