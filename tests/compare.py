"""Runs a query and its SQL side by side; also a command: python tests/compare.py SF_DIR NAME..."""

from __future__ import annotations

import glob
import math
import os
import sys
import time


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, bool):
        return str(v)
    return v if v is None or isinstance(v, str) else f"{float(v):.6g}" if isinstance(v, (int,)) else f"{float(v):.6g}" if v.__class__.__name__ == "Decimal" else str(v)


def rows_of(frame_rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in frame_rows), key=repr)


def duck(sf_dir: str, sql: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    r = c.execute(sql)
    return [d[0] for d in r.description], r.fetchall()


def compare(spark, sf_dir: str, name: str, query, sql: str | None) -> str:
    began = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - began
    if sql is None:
        return f"{name}: {len(got)} rows, no SQL, {took:.1f} s"
    cols, want = duck(sf_dir, sql)
    a, b = rows_of(got, df.columns), rows_of(want, cols)
    if sorted(cols) != sorted(df.columns):
        return f"{name}: COLUMNS DIFFER {sorted(df.columns)} {sorted(cols)}"
    if a != b:
        left, right = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
        return f"{name}: DIFFER {len(a)} / {len(b)} rows; only here {left}; only SQL {right}"
    return f"{name}: equal, {len(a)} rows, {took:.1f} s"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from conftest import make_session

    import __spark_entry__ as entry

    s = make_session()
    qs, sqls = entry.queries(), entry.oracle_sql()
    for n in sys.argv[2:] or qs:
        try:
            print(compare(s, sys.argv[1], n, qs[n], sqls.get(n)), flush=True)
        except Exception as e:  # a report, so go on
            print(f"{n}: ERROR {str(e)[:1500]}", flush=True)
