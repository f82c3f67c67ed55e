"""Compare every catalogued query with its SQL: python -m contrail.check <sf_dir> [names...]."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from contrail.catalogue import CATALOGUE
from contrail.session import build_session


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or v.__class__.__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else f
    return v


def compare(got, want) -> str | None:
    """None when equal, else the first difference."""
    g_cols, g_rows = got
    w_cols, w_rows = want
    if sorted(g_cols) != sorted(w_cols):
        return f"columns {sorted(g_cols)} != {sorted(w_cols)}"
    order = [g_cols.index(c) for c in sorted(g_cols)], [w_cols.index(c) for c in sorted(w_cols)]
    a = sorted((tuple(_norm(r[i]) for i in order[0]) for r in g_rows), key=repr)
    b = sorted((tuple(_norm(r[i]) for i in order[1]) for r in w_rows), key=repr)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(diff)} rows differ, e.g. {diff[0]}" if diff else None


def main(sf: str, names: list[str]) -> int:
    spark = build_session("check", "8")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    bad = 0
    for name, q in CATALOGUE.items():
        if names and name not in names:
            continue
        try:
            t0 = time.time()
            df = q.run(spark, sf)
            rows = df.collect()
            t1 = time.time()
            problem, t2 = None, t1
            if q.sql is not None:
                cur = con.execute(q.sql)
                problem = compare((df.columns, rows), ([d[0] for d in cur.description], cur.fetchall()))
                t2 = time.time()
            state = "ROWS" if q.sql is None else "ok" if problem is None else "DIFF"
            if not rows:
                state += " EMPTY"
            print(f"{state:10s} {name:32s} {len(rows):7d} rows  spark {t1 - t0:6.2f}s  sql {t2 - t1:6.2f}s  {problem or ''}"[:600], flush=True)
            bad += problem is not None
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"FAIL       {name}: {type(e).__name__}: {str(e)[:500]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
