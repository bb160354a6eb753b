"""Run registered queries in Spark and their DuckDB oracles; compare results.

Usage: python tests/oracle_compare.py [sf_dir] [query ...]
Mirrors the driver's check: row count, column names, order-insensitive
value hash (columns sorted by name).
"""

from __future__ import annotations

import hashlib
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck_conn(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return "T" if v else "F"
    if isinstance(v, float):
        return f"{round(v, 6):.6f}"
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    return str(v)


def digest(columns, rows) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_norm(r[i]) for i in order) for r in rows)
    h = hashlib.sha256("\x1e".join(lines).encode()).hexdigest()[:16]
    return len(lines), h


def compare(spark, con, name, fn, sql, sf_dir, show_diff=True):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    t2 = time.time()
    n1, h1 = digest(cols, rows)
    n2, h2 = digest(dcols, drows)
    ok = sorted(cols) == sorted(dcols) and n1 == n2 and h1 == h2
    print(f"{'OK ' if ok else 'BAD'} {name:28s} spark={n1:6d} duck={n2:6d} {t1-t0:6.1f}s {t2-t1:5.1f}s"
          + ("" if sorted(cols) == sorted(dcols) else f" cols {sorted(cols)} vs {sorted(dcols)}"))
    if not ok and show_diff and sorted(cols) == sorted(dcols):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        dorder = sorted(range(len(dcols)), key=lambda i: dcols[i])
        a = set("\x1f".join(_norm(r[i]) for i in order) for r in rows)
        b = set("\x1f".join(_norm(r[i]) for i in dorder) for r in drows)
        names = [cols[i] for i in order]
        for x in sorted(a - b)[:3]:
            print("   spark only:", dict(zip(names, [s[:200] for s in x.split("\x1f")])))
        for x in sorted(b - a)[:3]:
            print("   duck  only:", dict(zip(names, [s[:200] for s in x.split("\x1f")])))
    return ok


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    only = [a for a in argv[1:] if not a.startswith("/")]
    from pagetide import get_spark
    import __spark_entry__ as entry

    spark = get_spark()
    con = duck_conn(sf_dir)
    qs = entry.queries()
    sqls = entry.oracle_sql()
    bad = []
    for name, fn in qs.items():
        if only and name not in only:
            continue
        if name not in sqls:
            t0 = time.time()
            n = fn(spark, sf_dir).count()
            print(f"ROW {name:28s} spark={n:6d} (no oracle) {time.time()-t0:6.1f}s")
            continue
        try:
            if not compare(spark, con, name, fn, sqls[name], sf_dir):
                bad.append(name)
        except Exception as e:  # noqa: BLE001
            print(f"ERR {name}: {str(e)[:600]}")
            bad.append(name)
    print("FAILED:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
