"""Compare registered queries with their SQL in DuckDB.

    python check.py [--sf 0.01] [name ...]

Prints one line per query: rows, seconds on both sides, and OK or the first difference.
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

from shiftlens.plans.catalogue import all_queries
from shiftlens.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value:.9g}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("--root", default="/root/testdata")
    args = parser.parse_args()
    sf_dir = f"{args.root}/sf{args.sf}"
    spark = build_session("check", "local[8]", 8, {"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, query in all_queries().items():
        if args.names and not any(n in name for n in args.names):
            continue
        try:
            t0 = time.time()
            df = query.run(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            t1 = time.time()
            sql = query.oracle()
            if sql is None:
                print(f"{name:45s} rows={len(got):7d} spark={t1 - t0:6.2f}s  (no SQL)", flush=True)
                continue
            cur = con.execute(sql)
            want_names = [c[0] for c in cur.description]
            want = cur.fetchall()
            t2 = time.time()
            a, b = rows_of(df.columns, got), rows_of(want_names, want)
            ok = a == b and sorted(df.columns) == sorted(want_names)
            print(
                f"{name:45s} rows={len(got):7d}/{len(want):7d} spark={t1 - t0:6.2f}s duck={t2 - t1:6.2f}s "
                f"{'OK' if ok else 'DIFF'}",
                flush=True,
            )
            if not ok:
                bad += 1
                sa, sb = set(a), set(b)
                print("   columns", sorted(df.columns), sorted(want_names))
                print("   only spark", sorted(sa - sb)[:3])
                print("   only sql  ", sorted(sb - sa)[:3])
        except Exception as e:  # report and go on with the other queries
            bad += 1
            print(f"{name:45s} ERROR {str(e)[:1500]}", flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
