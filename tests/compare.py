"""Run registered queries and their SQL side by side: ``python -m tests.compare [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

from wakeline.fixtures import TABLES


def _norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (int,)):
        return repr(float(v)) if abs(v) < 2**53 else str(v)
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0 if v else 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple("" if x is None else x for x in t))


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def run_oracle(con, sql):
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else a short text of the difference; plus row count."""
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return None, len(got)
    cols, rows = run_oracle(con, sql)
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(cols)}", len(got)
    want = rows_of(cols, rows)
    if got == want:
        return None, len(got)
    a, b = set(got), set(want)
    ex = [sorted(a - b, key=str)[:3], sorted(b - a, key=str)[:3]]
    return f"rows {len(got)} vs {len(want)}; only spark {len(a - b)} {ex[0]}; only sql {len(b - a)} {ex[1]}; cols {sorted(cols)}", len(got)


def main():
    import __spark_entry__ as entry
    from wakeline.session import local_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session("compare")
    con = connect(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    bad = 0
    for n in names:
        t = time.time()
        try:
            diff, k = compare(spark, con, sf_dir, qs[n], sqls.get(n))
        except Exception as e:
            diff, k = f"{type(e).__name__}: {str(e)[:900]}", -1
        bad += diff is not None
        mark = "ok" if diff is None else "BAD"
        print(f"{mark:4}{n:34}{k:>8} rows {time.time() - t:6.1f}s{'' if n in sqls else '  (no sql)'}{'' if diff is None else '  ' + diff}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good")
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
