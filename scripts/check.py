"""Run registered queries beside their SQL in DuckDB and compare names, row counts and values."""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else float(f"{v:.12g}")
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return plain(float(v)) if v % 1 else int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(plain(row[i]) for i in order) for row in rows), key=lambda x: tuple((str(type(v)), str(v)) for v in x))


def compare(spark, con, name, fn, sql, sf_dir):
    start = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(x) for x in df.collect()]
    spent = time.time() - start
    if sql is None:
        return ("rows" if rows else "EMPTY"), len(rows), spent, ""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = [str(d[1]) for d in result.description]
    a, b = table(df.columns, rows), table(names, result.fetchall())
    if a[0] != b[0]:
        return "NAMES", len(rows), spent, f"{a[0]} vs {b[0]}"
    if len(a[1]) != len(b[1]):
        return "COUNT", len(rows), spent, f"{len(a[1])} vs {len(b[1])}"
    for x, y in zip(a[1], b[1]):
        if x != y:
            return "VALUES", len(rows), spent, f"{x} vs {y}"
    floats = {d[0] for d in zip(names, kinds) if d[1] in ("DOUBLE", "FLOAT")}
    ours = {n for n, k in df.dtypes if k in ("double", "float")}
    note = "" if floats == ours else f"float columns differ: {sorted(floats ^ ours)}"
    return ("ok" if rows else "ok-empty"), len(rows), spent, note


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--quiet", action="store_true")
    args = parser.parse_args()
    import duckdb
    from tablecraft.plans.catalogue import ORACLE, QUERIES
    from tablecraft.plans.catalogue.registry import TABLES
    from tablecraft.session import build_session

    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{args.sf}/{t}.parquet'")
    bad, counts = [], {}
    for name, fn in QUERIES.items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        try:
            status, n, spent, note = compare(spark, con, name, fn, ORACLE.get(name), args.sf)
        except Exception as e:
            status, n, spent, note = "ERROR", 0, 0.0, f"{type(e).__name__}: {str(e)[:900]}"
        counts[status] = counts.get(status, 0) + 1
        if status not in ("ok", "rows"):
            bad.append(name)
        if not args.quiet or status not in ("ok", "rows") or note:
            print(f"{status:8} {name:40} {n:8} {spent:6.1f}s {note}", flush=True)
    print(counts, "bad:", bad)


if __name__ == "__main__":
    main()
