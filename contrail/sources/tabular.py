"""Generic CSV and JSON logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contrail.schema import TS

# Accepted time columns, first match wins.
TIME_ALIASES = ["timestamp_us", "TimeUS", "timestamp", "time_us", "time", "t"]
MICROSECOND_FLOOR = 1e12


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Header CSV.  Pass a schema at scale; inference reads the files twice."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path).withColumn("source_file", F.col("_metadata.file_path"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None, lines: bool = False) -> DataFrame:
    """A list of records or one record per file; ``lines`` reads splittable one-record-per-line files."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("source_file", F.col("_metadata.file_path"))


def time_column(df: DataFrame) -> str | None:
    return next((a for a in TIME_ALIASES if a in df.columns), None)


def normalize_time(df: DataFrame, file: str = "source_file") -> DataFrame:
    """Replace the time column by integer microseconds.

    Text is parsed as ISO time.  Numbers below 1e12 throughout a file are seconds; a column named
    in microseconds is never scaled.  The per-file maximum is an aggregate joined back, so a large
    file is not gathered in one task."""
    name = time_column(df)
    if name is None:
        return df
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        out = df.withColumn("_us", F.unix_micros(F.to_timestamp(name)))
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        out = df.withColumn("_us", F.unix_micros(F.col(name).cast("timestamp")))
    elif name.endswith("_us") or name == "TimeUS":
        out = df.withColumn("_us", F.col(name).cast("long"))
    else:
        tops = df.groupBy(file).agg(F.max(name).alias("_top"))
        scaled = F.when(F.col("_top") < MICROSECOND_FLOOR, F.col(name) * 1_000_000).otherwise(F.col(name))
        out = df.join(tops, file).withColumn("_us", scaled.cast("long")).drop("_top")
    return out.drop(name).withColumnRenamed("_us", TS)


def tabular_profile(df: DataFrame, file: str = "source_file") -> DataFrame:
    """Row count and time span per file, after normalisation."""
    return df.groupBy(file).agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.min(TS), F.lit(0)).alias("log_start_us"),
        F.coalesce(F.max(TS), F.lit(0)).alias("log_end_us"),
        F.coalesce(F.max(TS) - F.min(TS), F.lit(0)).alias("duration_us"),
    )
