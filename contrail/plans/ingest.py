"""From decoded messages to stored tables, events, phases and anomalies, for all new flights at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrail.plans.rules.common import Telemetry
from contrail.plans.rules.registry import run_rules
from contrail.plans.timeline import phases, timeline
from contrail.schema import FLIGHT
from contrail.session import broadcast_if_small
from contrail.sources.mapping import READERS
from contrail.sources.store import TelemetryStore


def batch_name(flights: DataFrame) -> str:
    """The same name for the same flights, in any order."""
    r = flights.agg(F.count(F.lit(1)), F.expr(f"bit_xor(xxhash64({FLIGHT}))"), F.expr(f"bit_xor(xxhash64({FLIGHT}, 1))")).first()
    return "b" + "-".join(f"{(v or 0) & (2**64 - 1):x}" for v in r)


def ingest(raw: DataFrame, log_format: str, store: TelemetryStore, batch: str | None = None) -> list[str]:
    """Map and store the flights of ``raw``, then derive from what was stored.

    Each canonical table reads only its message types, so keep ``raw`` partitioned by
    ``msg_type``.  Derived tables are computed from the stored columns, pruned to the buckets
    of the new flights, and the sizes of their series are those kept at writing.  Ingesting the same flights again,
    or a batch of the same name, replaces what the earlier run wrote; a flight that comes again in a batch with others
    is read from the newest batch alone.  Returns the tables written."""
    spark = raw.sparkSession
    tables = READERS[log_format](raw)
    flights = raw.select(FLIGHT).distinct()
    batch = batch or batch_name(flights)
    for name, df in tables.items():
        store.write(name, df, batch)
    store.register_flights(flights, batch)
    fresh, buckets = broadcast_if_small(flights), store.buckets_of(flights)
    stored = {n: store.load(n, buckets=buckets).join(fresh, FLIGHT, "left_semi") for n in tables}
    t = Telemetry(spark, stored, largest=store.largest_series(tables, buckets))
    store.write_derived("events", timeline(t), batch)
    # phases need only arming and crashes, which they derive on their own
    store.write_derived("phases", phases(t), batch)
    store.write_derived("anomalies", run_rules(t), batch)
    return sorted(tables)
