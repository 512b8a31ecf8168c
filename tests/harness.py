"""Run registered queries, time them, and compare them with their oracle."""

from __future__ import annotations

import datetime as dt
import math
import signal
import sys
import time
from decimal import Decimal

import duckdb

from tenderflow.plans.adapters import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, Decimal)):
        return repr(round(float(v), 6))
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows), [columns[i] for i in order]


def compare(spark, name, fn, sql, sf_dir, con):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got, gc = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return f"ROWS {name} {len(got)} rows {t1 - t0:.1f}s", True, t1 - t0
    cur = con.execute(sql)
    want, wc = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    if gc != wc:
        return f"COLS {name} {gc} vs {wc}", False, t1 - t0
    if got != want:
        a, b = sorted(set(got) - set(want))[:2], sorted(set(want) - set(got))[:2]
        return f"DIFF {name} {len(got)} vs {len(want)} spark:{str(a)[:700]} duck:{str(b)[:700]}", False, t1 - t0
    return f"OK   {name} {len(got)} rows {t1 - t0:.1f}s oracle {t2 - t1:.1f}s", True, t1 - t0


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tenderflow.session import build_session

    sf = sys.argv[1]
    only = sys.argv[2].split(",") if len(sys.argv) > 2 and sys.argv[2] != "all" else None
    sf_dir = f"/root/testdata/{sf}"
    s = build_session(master="local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    s.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles = entry.oracle_sql()
    bad = 0

    def late(*_):
        raise TimeoutError(name)

    signal.signal(signal.SIGALRM, late)
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        signal.alarm(int(sys.argv[3]) if len(sys.argv) > 3 else 60)
        try:
            line, ok, _ = compare(s, name, fn, oracles.get(name), sf_dir, con)
        except BaseException as e:
            line, ok = f"FAIL {name} {type(e).__name__} {str(e)[:1200]}", False
            s.sparkContext.cancelAllJobs()
        signal.alarm(0)
        bad += not ok
        print(line, flush=True)
    print("bad", bad)
