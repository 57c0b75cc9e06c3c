"""Compare registered queries with their SQL in DuckDB.  Usage: python tests/oracle_check.py [sf] [name-or-prefix ...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canon(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "~"
        return f"{round(v, 6) + 0.0:.6f}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    types = dict(df.dtypes)
    rows = sorted(tuple(canon(r[c]) for c in cols) for r in df.collect())
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(rows)} {t1 - t0:.1f}s", True
    timer = threading.Timer(float(os.environ.get('DUCK_LIMIT', '25')), con.interrupt)
    timer.start()
    try:
        res = con.execute(sql)
    finally:
        timer.cancel()
    names = [d[0] for d in res.description]
    dtypes = dict(zip(names, [str(d[1]) for d in res.description]))
    raw = res.fetchall()
    t2 = time.time()
    if sorted(names) != cols:
        return f"COLUMNS spark={cols} sql={sorted(names)}", False
    idx = [names.index(c) for c in cols]
    exp = sorted(tuple(canon(r[i]) for i in idx) for r in raw)
    bad = []
    for c in cols:
        s, d = types[c], dtypes[c]
        num = lambda x: x in ("DOUBLE", "FLOAT", "NUMBER") or x.startswith("DECIMAL")
        if (s in ("double", "float")) != (d in ("DOUBLE", "FLOAT")) or d == "HUGEINT" or d.startswith("DECIMAL") or d == "INTERVAL":
            bad.append((c, s, d))
        if s in ("bigint", "int") and (s == "bigint") != (d == "BIGINT"):
            bad.append((c, s, d))
    note = f" TYPES {bad}" if bad else ""
    ok = rows == exp and not bad
    msg = f"{'ok' if ok else 'MISMATCH'} rows={len(rows)} sql={len(exp)} spark {t1 - t0:.1f}s duck {t2 - t1:.1f}s{note}"
    if rows != exp:
        a, b = set(rows), set(exp)
        msg += f"\n   cols {cols}\n   spark-only {len(a - b)}: {[tuple(x[:80] for x in r) for r in sorted(a - b)[:3]]}\n   sql-only {len(b - a)}: {[tuple(x[:80] for x in r) for r in sorted(b - a)[:3]]}"
    if not rows:
        msg += "  EMPTY"
    return msg, ok


def main():
    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    want = args[1:]
    from engramlake.session import build_session

    spark = build_session("check", "local[8]", 8)
    import __spark_entry__ as e

    qs, sqls = e.queries(), e.oracle_sql()
    d = f"/root/testdata/sf{sf}"
    con = duck(d)
    bad = 0
    for name, fn in qs.items():
        mod = fn.__closure__ and registry_module(name)
        if want and not any(name.startswith(w) or mod == w for w in want):
            continue
        try:
            msg, ok = compare(spark, con, fn, sqls.get(name), d)
        except Exception as ex:  # noqa: BLE001
            msg, ok = "ERROR " + str(ex)[:700], False
        bad += not ok
        print(f"{name}: {msg}", flush=True)
    print("failed", bad)


def registry_module(name):
    import registry

    fn = registry.QUERIES.get(name)
    return fn and fn.__module__.split(".")[-1]


if __name__ == "__main__":
    main()
