"""Telemetry tables on shared storage.

Layout: ``<root>/<TYPE>/batch=<id>/flight_bucket=<n>/*.parquet``.  A directory per flight would leave
millions of tiny files; buckets bound the files of a batch, and sorting by flight and time lets
row-group statistics prune to one flight and time range.  Writing a batch again replaces it.

Beside the rows, a batch keeps for each flight how many rows a table has and from when to when (``series_stats``), so
time ranges and the size of the longest series are known without reading rows; and ``flight_index`` names the batches
that hold a flight as a whole.  Of these the newest counts: rows of older ones are left out when tables are read."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.operators.align import nearest_join
from contrail.operators.runs import every_nth
from contrail.operators.series import open_series
from contrail.schema import FLIGHT, ORDER, SEQ, TABLES, TS, conform, empty_table
from contrail.session import broadcast_if_small

BUCKET, BATCH = "flight_bucket", "batch"
BUCKETS = 256
DERIVED, INDEX, STATS = "derived", "flight_index", "series_stats"
# Error conditions that mean a table has no files yet.
NO_FILES = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


class TelemetryStore:
    """Any path Spark can reach: local, HDFS or an object store."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _bucket(self, flight: Column) -> Column:
        return F.pmod(F.xxhash64(flight), F.lit(self.buckets)).cast("int")

    def buckets_of(self, flights: DataFrame) -> list[int]:
        """Buckets that hold these flights; at most ``buckets`` numbers."""
        return sorted(r[0] for r in flights.select(self._bucket(F.col(FLIGHT))).distinct().collect())

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _folder(self, path: str, batch: str | None) -> str:
        """Names of batches begin with a letter, so that they are read as text."""
        name = batch or uuid.uuid4().hex
        return f"{path}/{BATCH}={name if name.startswith('b') else 'b' + name}"

    def write(self, table: str, df: DataFrame, batch: str | None = None) -> None:
        """Add rows as a new batch, or in place of the batch of that name.

        Range partitioning on (bucket, flight, time) spreads a long flight over several files."""
        rows = conform(df, table).withColumn(BUCKET, self._bucket(F.col(FLIGHT)))
        batch = batch or uuid.uuid4().hex
        folder = self._folder(self.path(table), batch)
        (
            rows.repartitionByRange(BUCKET, FLIGHT, TS)
            .sortWithinPartitions(BUCKET, FLIGHT, TS, SEQ)
            .write.mode("overwrite").partitionBy(BUCKET).parquet(folder)
        )
        # Two columns of what was written, a row for each flight.
        stored = self.spark.read.schema(f"{FLIGHT} string, {TS} bigint, {BUCKET} int").parquet(folder)
        counts = stored.groupBy(BUCKET, FLIGHT).agg(F.count(F.lit(1)).alias("rows"), F.min(TS).alias("start_us"), F.max(TS).alias("end_us"))
        self._write_small(counts, self._folder(f"{self.root}/{STATS}/{table}", batch))

    @staticmethod
    def _write_small(rows: DataFrame, folder: str) -> None:
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(folder)

    def register_flights(self, flights: DataFrame, batch: str) -> None:
        """The batch holds these flights as a whole and replaces what older batches hold of them."""
        rows = flights.select(FLIGHT).distinct().select(self._bucket(F.col(FLIGHT)).alias(BUCKET), FLIGHT, F.lit(time.time_ns()).alias("at"))
        self._write_small(rows, self._folder(f"{self.root}/{INDEX}", batch))

    def _read_small(self, path: str, schema: str, buckets: Iterable[int] | None) -> DataFrame | None:
        """None where nothing has been written yet."""
        try:
            df = self.spark.read.parquet(path).select(F.col(BATCH).cast("string").alias(BATCH), BUCKET, *schema.split())
        except AnalysisException as e:
            if e.getCondition() not in NO_FILES:
                raise
            return None
        return df if buckets is None else df.where(F.col(BUCKET).isin(list(buckets)))

    def replaced(self, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """(flight, batch) of flights that a newer batch holds as a whole; None where there are none."""
        index = self._read_small(f"{self.root}/{INDEX}", f"{FLIGHT} at", buckets)
        if index is None:
            return None
        newest = index.groupBy(FLIGHT).agg(F.max(F.struct("at", BATCH)).alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1")
        old = index.join(newest, FLIGHT).where(F.col(BATCH) != F.col(f"newest.{BATCH}")).select(FLIGHT, BATCH)
        return None if old.isEmpty() else old

    def _current(self, df: DataFrame, buckets: Iterable[int] | None) -> DataFrame:
        old = self.replaced(buckets)
        if old is None:
            return df
        return df.withColumn(BATCH, F.col(BATCH).cast("string")).join(broadcast_if_small(old), [FLIGHT, BATCH], "left_anti")

    def stats(self, table: str, buckets: Iterable[int] | None = None) -> DataFrame | None:
        """flight, rows, start_us, end_us of the rows that ``load`` gives; None for a table that has not been written."""
        parts = self._read_small(f"{self.root}/{STATS}/{table}", f"{FLIGHT} rows start_us end_us", buckets)
        if parts is None:
            return None
        return self._current(parts, buckets).groupBy(FLIGHT).agg(F.sum("rows").alias("rows"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"))

    def largest_series(self, tables: Iterable[str], buckets: Iterable[int] | None = None) -> dict[str, int]:
        """Most rows that a flight has in each table."""
        found = {t: self.stats(t, buckets) for t in tables}
        return {t: 0 if s is None else s.agg(F.max("rows")).first()[0] or 0 for t, s in found.items()}

    def load(self, table: str, flights: str | Sequence[str] | None = None, columns: Sequence[str] | None = None,
             start_us: int | None = None, end_us: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """Projection, bucket pruning and time range reach the scan; an absent table is empty, and so
        is one that lacks a column asked for (NULL there)."""
        try:
            df = self.spark.read.parquet(self.path(table))
        except AnalysisException as e:
            if table not in TABLES or e.getCondition() not in NO_FILES:
                raise
            df = empty_table(self.spark, table).withColumn(BUCKET, F.lit(0))
        if buckets is not None:
            df = df.where(F.col(BUCKET).isin(list(buckets)))
        if flights is not None:
            ids = [flights] if isinstance(flights, str) else list(flights)
            asked = sorted({r[0] for r in self.spark.createDataFrame([(i,) for i in ids], "f string").select(self._bucket(F.col("f"))).collect()})
            df = df.where(F.col(BUCKET).isin(asked) & F.col(FLIGHT).isin(ids))
            buckets = asked if buckets is None else [b for b in buckets if b in asked]
        if BATCH in df.columns:
            df = self._current(df, buckets)
        if start_us is not None:
            df = df.where(F.col(TS) >= start_us)
        if end_us is not None:
            df = df.where(F.col(TS) <= end_us)
        df = df.drop(BATCH, BUCKET)
        if columns is not None:
            if any(c not in df.columns for c in columns):
                none = F.lit(None).cast("double")
                return df.limit(0).select(*[F.col(c) if c in df.columns else none.alias(c) for c in columns])
            df = df.select(*columns)
        return df

    def load_many(self, tables: Iterable[str], flights=None, **bounds) -> dict[str, DataFrame]:
        return {t: self.load(t, flights, **bounds) for t in tables}

    def available_types(self) -> list[str]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.root)
        system = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in system.listStatus(root) if s.isDirectory()] if system.exists(root) else []
        return sorted(n for n in names if n not in (DERIVED, INDEX, STATS))

    def time_range(self, table: str = "ATT", flights=None) -> DataFrame:
        """(flight, start_us, end_us) as kept at writing; flights that were asked for but have no rows get 0, 0."""
        found = self.stats(table)
        if found is None:
            found = self.load(table).groupBy(FLIGHT).agg(F.min(TS).alias("start_us"), F.max(TS).alias("end_us"))
        found = found.select(FLIGHT, "start_us", "end_us")
        if flights is None:
            return found
        ids = [flights] if isinstance(flights, str) else list(flights)
        asked = self.spark.createDataFrame([(i,) for i in ids], f"{FLIGHT} string")
        return asked.join(found, FLIGHT, "left").fillna({"start_us": 0, "end_us": 0})

    def plot_channels(self, channels: Sequence[str], flights=None, start_us=None, end_us=None, max_points: int = 2000) -> DataFrame:
        """``TYPE.field`` channels thinned per flight: (flight, channel, timestamp_us, value)."""
        by_type: dict[str, list[str]] = {}
        for c in channels:
            if "." in c:
                table, field = c.split(".", 1)
                by_type.setdefault(table, []).append(field)
        out = None
        for table, fields in by_type.items():
            df = self.load(table, flights, start_us=start_us, end_us=end_us)
            fields = [f for f in fields if f in df.columns]
            if not fields:
                continue
            thin = every_nth(open_series(df.select(FLIGHT, *ORDER, *fields), [FLIGHT], ORDER), max_points)
            long = unpivot(thin, [FLIGHT, TS], {f"{table}.{f}": f for f in fields})
            out = long if out is None else out.unionByName(long)
        return out if out is not None else self.spark.createDataFrame([], f"{FLIGHT} string, channel string, {TS} long, value double")

    def register_views(self, flights=None) -> list[str]:
        """One temporary view per table, for ``spark.sql``."""
        names = [t for t in self.available_types() if t in TABLES]
        for t in names:
            self.load(t, flights).createOrReplaceTempView(t)
        return names

    def query(self, sql: str, flights=None) -> DataFrame:
        self.register_views(flights)
        return self.spark.sql(sql)

    def aligned(self, main: str, others: Sequence[str], fields: dict[str, list[str]], window_us: int = 100_000,
                flights=None, start_us=None, end_us=None) -> DataFrame:
        """Nearest row of each other table beside every main row, ``TYPE_field`` names."""
        base = self.load(main, flights, start_us=start_us, end_us=end_us).select(
            FLIGHT, *ORDER, *[F.col(f).alias(f"{main}_{f}") for f in fields.get(main, [])]
        )
        sides = {t: (self.load(t, flights), fields[t]) for t in others if fields.get(t)}
        out = nearest_join(base, sides, [FLIGHT], tolerance=window_us) if sides else base
        return out.drop(SEQ, *[f"{t}_{TS}" for t in sides])

    def write_derived(self, name: str, df: DataFrame, batch: str | None = None) -> None:
        """Derived results by name, one row set per flight, laid out like the telemetry."""
        rows = df.withColumn(BUCKET, self._bucket(F.col(FLIGHT)))
        order = [BUCKET, FLIGHT, *[c for c in (TS, "start_us") if c in df.columns]]
        path = self._folder(f"{self.root}/derived/{name}", batch)
        rows.repartitionByRange(*order).write.mode("overwrite").partitionBy(BUCKET).parquet(path)

    def read_derived(self, name: str, flight: str | None = None) -> DataFrame:
        df = self._current(self.spark.read.parquet(f"{self.root}/derived/{name}"), None)
        return (df if flight is None else df.where(F.col(FLIGHT) == flight)).drop(BATCH, BUCKET)

    def export_json(self, name: str, path: str) -> None:
        """One JSON document per row."""
        df = self.read_derived(name)
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def unpivot(df: DataFrame, keep: Sequence[str], channels: dict[str, str]) -> DataFrame:
    """Wide to long in one projection."""
    pairs = F.array(*[F.struct(F.lit(n).alias("channel"), F.col(c).cast("double").alias("value")) for n, c in channels.items()])
    return df.select(*keep, F.explode(pairs).alias("_p")).select(*keep, "_p.*")
