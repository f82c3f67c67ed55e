"""Shared helpers: tables, batches, written intermediate tables and files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.session import broadcast_if_small, shared_folder

# Texts may be long, so a batch holds few of them.
BATCH_ROWS = 1000
# Consecutive ranks that meet their group's row in one place, so that a hot group is spread.
RANKS = 1024
# Copies of a key from which its rows are joined apart from the others.
COPIES = 500


def load(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Arrow batches of rows with texts stay small whatever the session's default is."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    return small_batches(df).mapInArrow(fn, schema)


def append_columns(df: DataFrame, fields: str, fn: Callable[[pa.RecordBatch], list[pa.Array]]) -> DataFrame:
    """All columns of ``df`` and those that ``fn`` makes of a batch; columns of the same names are replaced."""
    added = T.StructType.fromDDL(fields)
    kept = df.select(*[c for c in df.columns if c not in added.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *fn(batch)], names=[*batch.schema.names, *added.names])

    return map_batches(kept, run, T.StructType([*kept.schema.fields, *added.fields]))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """Whole texts, null as empty."""
    return [t or "" for t in column_values(batch, column)]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: computed once, safe from lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder; called in tasks, so it must be one that all executors share."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def column_values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def ranked(df: DataFrame, order: list[str], kept: list[Column], name: str) -> DataFrame:
    """The columns ``kept`` and ``rank``, the place of each row (from 0) in the order of the columns ``order``.

    One range shuffle and one written table; equal rows may come in any order.  Nulls come first.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(sorted_rows.select(*kept, F.monotonically_increasing_id().alias("rank")), name)
    part = F.shiftright("rank", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One row for each partition of the written table.
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    joined = placed.join(F.broadcast(starts), part == F.col("part"))
    return joined.withColumn("rank", F.col("before") + F.col("rank").bitwiseAND((1 << 33) - 1)).drop("part", "before")


def join_groups(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Ranked rows with the columns of their group (key, start, n): the group of ``n`` ranks from ``start`` on.

    A group's row meets its rows by blocks of ranks, so the rows of a hot group are spread.
    """
    spread = groups.withColumn("block", F.explode(F.sequence(F.expr(f"start div {RANKS}"), F.expr(f"(start + n - 1) div {RANKS}"))))
    spread = spread.withColumnRenamed(key, "group_key")
    same = F.col("group_key").eqNullSafe(F.col(key)) & (F.col("block") == F.expr(f"rank div {RANKS}"))
    return rows.join(spread, same).drop("group_key", "block")


def join_copies(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of their group (left join); ``groups`` has unique keys and counts of their ``copies``.

    Keys with COPIES rows or more, at most one in COPIES of all, meet their rows where these are: their rows aren't
    dealt by the key.
    """
    values = [c for c in groups.columns if c not in (key, "copies")]
    large = materialise(groups.where(F.col("copies") >= COPIES).select(key, F.struct(*values).alias("large")), "large-groups")
    marked = rows.join(broadcast_if_small(large), key, "left")
    common = marked.where("large IS NULL").drop("large").join(groups.drop("copies").hint("merge"), key, "left")
    return marked.where("large IS NOT NULL").select(*rows.columns, "large.*").unionByName(common.select(*rows.columns, *values))
