"""Catalog of flights, investigations, hypotheses, anomalies, baselines and evidence.

Tables only grow: an update appends a newer version, a delete appends a tombstone, and readers see
the latest version of what is not deleted.  Readers therefore never meet a half-written rewrite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of each catalog table; the first one identifies a row.
_DDL = {
    "flights": "flight_id string, sha256 string, filename string, file_size long, format string, autopilot string, "
               "vehicle_class string, fw_version string, uploaded_at timestamp, flight_start_time timestamp, duration_s double, "
               "status string, message_types array<string>, missing_critical array<string>, parameter_count int, raw_path string",
    "investigations": "investigation_id string, flight_id string, query string, status string, started_at timestamp, "
                      "completed_at timestamp, root_cause string, contributing_factors array<string>, recommendations array<string>, "
                      "confidence string, report_path string, iteration_count int, agent_findings map<string,string>, open_questions array<string>",
    "hypotheses": "hypothesis_id string, investigation_id string, agent_name string, text string, confidence double, status string, "
                  "evidence array<string>, reasoning string, created_at timestamp, updated_at timestamp",
    "anomalies": "anomaly_id string, flight_id string, investigation_id string, timestamp_us long, end_timestamp_us long, severity string, "
                 "category string, rule_name string, description string, raw_values map<string,double>, detected_by string, correlation_hint string",
    "baselines": "baseline_id string, vehicle_type string, phase string, flight_id string, metrics map<string,double>, "
                 "embedding array<float>, notes string, is_healthy boolean, created_at timestamp",
    "evidence": "evidence_id string, investigation_id string, evidence_type string, text string, embedding array<float>, metadata map<string,string>",
    "tombstones": "flight_id string",
}
# Values a new row starts with.
_DEFAULTS = {"flights": {"status": "uploaded", "parameter_count": 0}, "investigations": {"status": "queued", "iteration_count": 0},
             "hypotheses": {"status": "forming", "confidence": 0.0}, "baselines": {"is_healthy": True}}


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def append(self, table: str, rows: DataFrame) -> None:
        """Insert rows, or newer versions of them.  Unknown columns are dropped, absent ones NULL."""
        schema = self.spark.createDataFrame([], _DDL[table]).schema
        key = schema.fields[0].name
        if key not in rows.columns:
            rows = rows.withColumn(key, F.expr("uuid()"))
        fill = _DEFAULTS.get(table, {})
        cols = []
        for f in schema:
            c = F.col(f.name) if f.name in rows.columns else F.lit(None)
            if f.name in fill and f.name not in rows.columns:
                c = F.lit(fill[f.name])
            cols.append(c.cast(f.dataType).alias(f.name))
        rows.select(*cols, F.current_timestamp().alias("_version")).write.mode("append").parquet(f"{self.root}/{table}")

    def _raw(self, table: str) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.root}/{table}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # an unreadable table is not an empty one
                raise
            return self.spark.createDataFrame([], _DDL[table] + ", _version timestamp")

    def read(self, table: str) -> DataFrame:
        """Latest version of each row of flights that still exist."""
        rows = self._raw(table)
        key, *rest = [c for c in rows.columns if c != "_version"]
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_version").alias("r")).select(key, "r.*")
        gone = self._raw("tombstones").select("flight_id").distinct()
        if "flight_id" in latest.columns:
            return latest.join(gone, "flight_id", "left_anti").select(key, *rest)
        if "investigation_id" in latest.columns:
            dead = self._raw("investigations").join(gone, "flight_id", "left_semi").select("investigation_id").distinct()
            return latest.join(dead, "investigation_id", "left_anti").select(key, *rest)
        return latest

    def update(self, table: str, row_id: str, **values) -> None:
        """Append a new version of one row with some columns changed; an unknown id does nothing."""
        rows = self.read(table)
        mine = rows.where(F.col(rows.columns[0]) == row_id)
        held = mine.collect()  # at most one row
        if held:
            one = self.spark.createDataFrame(held, rows.schema)
            known = {k: F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v]) for k, v in values.items() if k in rows.columns}
            self.append(table, one.withColumns(known) if known else one)

    def list_flights(self, limit: int = 50, offset: int = 0) -> DataFrame:
        return self.read("flights").orderBy(F.desc_nulls_last("uploaded_at"), "flight_id").offset(offset).limit(limit)

    def flight_by_hash(self, sha256: str) -> DataFrame:
        return self.read("flights").where(F.col("sha256") == sha256).limit(1)

    def anomalies(self, flight: str, severity: Sequence[str] | None = None, category: str | None = None) -> DataFrame:
        rows = self.read("anomalies").where(F.col("flight_id") == flight)
        if severity:
            rows = rows.where(F.col("severity").isin(list(severity)))
        if category:
            rows = rows.where(F.col("category") == category)
        return rows.orderBy("timestamp_us")

    def investigation_tree(self) -> DataFrame:
        """Flights with their investigations and hypotheses."""
        inv = self.read("investigations").select("investigation_id", "flight_id", F.col("status").alias("investigation_status"))
        hyp = self.read("hypotheses").select("hypothesis_id", "investigation_id", "text")
        return self.read("flights").select("flight_id", "filename").join(inv, "flight_id", "left").join(hyp, "investigation_id", "left")

    def delete_flight(self, flight: str) -> None:
        """Hide a flight and everything that belongs to it."""
        self.append("tombstones", self.spark.createDataFrame([(flight,)], "flight_id string"))

    def compact(self, target: str) -> None:
        """Write the live rows to a new root, without old versions and deleted flights."""
        for table in _DDL:
            if table != "tombstones":
                self.read(table).withColumn("_version", F.current_timestamp()).write.parquet(f"{target.rstrip('/')}/{table}")
