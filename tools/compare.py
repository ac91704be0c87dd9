"""Local correctness loop: run each registered Spark query and its DuckDB
oracle on the same test tables and compare row multisets exactly.

usage: python tools/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from fitlake.plans.registry import oracle_sql, queries  # noqa: E402
from fitlake.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        return repr(v)
    if isinstance(v, decimal.Decimal):
        return str(v)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return repr([norm(x) for x in v])
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = build_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    qs, sqls = queries(), oracle_sql()
    ok = bad = 0
    for name in (names or sorted(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf)
            cols = df.columns
            srows = rows_of(cols, df.collect())
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"ROWS  {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.sql(sqls[name])
            ocols = res.columns
            orows = rows_of(ocols, res.fetchall())
        except Exception as e:  # noqa: BLE001
            print(f"FAIL  {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL  {name}: columns differ spark={cols} oracle={ocols}")
            bad += 1
            continue
        if srows == orows:
            print(f"OK    {name}: {len(srows)} rows {ts:.1f}s")
            ok += 1
        else:
            bad += 1
            sset, oset = set(srows), set(orows)
            print(f"FAIL  {name}: spark={len(srows)} oracle={len(orows)} cols={sorted(cols)}")
            for r in list(sset - oset)[:3]:
                print("   spark only :", r)
            for r in list(oset - sset)[:3]:
                print("   oracle only:", r)
    print(f"summary ok={ok} bad={bad}")


if __name__ == "__main__":
    main()
