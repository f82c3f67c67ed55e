"""Telemetry of many flights as the rules see it, and the anomaly row they all produce."""

from __future__ import annotations

from collections.abc import Mapping
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.operators.align import fallback_source
from contrail.operators.series import Series, open_series
from contrail.schema import ANOMALY, FLIGHT, ORDER, SERIES_KEYS, TS, conform, empty_table


class Telemetry:
    """Canonical tables by message type.  An absent table is empty; an absent column is NULL.

    ``"NKF4|XKF4"`` names a per-flight fallback: the second table serves flights the first lacks.
    ``largest``: rows of the longest flight of a table, as a store keeps them; such tables are not counted."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], max_rows: int | None = None, largest: Mapping[str, int] | None = None):
        self.spark = spark
        self.max_rows = max_rows
        self._raw = tables
        self._largest = dict(largest or {})
        self.table = cache(self._table)
        self.series = cache(self._series)

    def _table(self, name: str) -> DataFrame:
        if "|" in name:
            first, second = name.split("|")
            if first not in self._raw:
                return self.table(second)
            if second not in self._raw:
                return self.table(first)
            return fallback_source(self.table(first), self.table(second), FLIGHT)
        if name not in self._raw:
            return empty_table(self.spark, name)
        return conform(self._raw[name], name)

    def _series(self, name: str) -> Series:
        """One series per flight and sensor instance; the size check runs once per table."""
        return open_series(self.table(name), SERIES_KEYS, ORDER, self.max_rows, largest=self.largest(name))

    def flight_series(self, df: DataFrame, table: str | None = None) -> Series:
        """``df`` as one series per flight; ``table`` names the table that its rows come from."""
        return open_series(df, [FLIGHT], ORDER, self.max_rows, largest=self.largest(table) if table else None)

    def largest(self, *names: str) -> int | None:
        """Rows that a flight has at most in these tables together; None where it is not known."""
        parts = [n for name in names for n in name.split("|") if n in self._raw]
        return sum(self._largest[n] for n in parts) if all(n in self._largest for n in parts) and self._largest else None

    def has(self, name: str) -> bool:
        return any(n in self._raw for n in name.split("|"))


def emit(
    df: DataFrame,
    rule: str | Column,
    category: str | Column,
    severity: str | Column,
    description: Column,
    ts: str = TS,
    end: Column | None = None,
    channel: Column | None = None,
    raw: dict[str, Column] | Column | None = None,
    labels: dict[str, Column] | None = None,
    hint: str | Column = "",
) -> DataFrame:
    """Project rows to the anomaly record."""

    def text(x: str | Column) -> Column:
        return F.lit(x) if isinstance(x, str) else x

    def mapping(items: dict[str, Column] | Column | None, kind: str) -> Column:
        if isinstance(items, Column):
            return items
        pairs = [c for k, v in (items or {}).items() for c in (F.lit(k), v.cast(kind))]
        return F.create_map(*pairs) if pairs else F.create_map().cast(f"map<string,{kind}>")

    null = F.lit(None)
    cols = {
        "rule_name": text(rule), "category": text(category), "severity": text(severity), TS: F.col(ts),
        "end_timestamp_us": null if end is None else end, "channel": null if channel is None else channel,
        "description": description, "raw_values": mapping(raw, "double"), "labels": mapping(labels, "string"),
        "correlation_hint": text(hint),
    }
    return df.select(FLIGHT, *[c.alias(n) for n, c in cols.items()]).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in ANOMALY]
    )


def fmt(template: str, *args: Column | str) -> Column:
    return F.format_string(template, *args)
