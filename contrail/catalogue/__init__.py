"""Named queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from contrail.catalogue import aligned, fleet, ordered, records, signals, text
from contrail.catalogue.base import Query

MODULES = (ordered, aligned, fleet, records, signals, text)
CATALOGUE: dict[str, Query] = {q.name: q for m in MODULES for q in m.QUERIES}
