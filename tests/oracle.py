"""Runs registered queries next to their SQL on DuckDB and compares whole results.

``python -m tests.oracle [name…]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

from draftlake.catalogue import load

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(folder: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data), [columns[i] for i in order]


def compare(spark, name, folder: str = SF):
    queries, oracles = load()
    t0 = time.time()
    df = queries[name](spark, folder)
    got, got_cols = rows(df.columns, [tuple(r) for r in df.collect()])
    seconds = time.time() - t0
    if name not in oracles:
        return True, f"rows={len(got)} (no oracle)", seconds
    cur = connection(folder).execute(oracles[name])
    cols = [d[0] for d in cur.description]
    want, want_cols = rows(cols, cur.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}", seconds
    if got != want:
        extra, lack = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return False, f"rows {len(got)} vs {len(want)}\n   only spark {extra}\n   only duck  {lack}", seconds
    return bool(got), f"rows={len(got)}", seconds


if __name__ == "__main__":
    from draftlake.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or list(load()[0])
    bad = []
    for n in names:
        try:
            ok, note, sec = compare(spark, n)
        except Exception as e:  # noqa: BLE001
            ok, note, sec = False, f"{type(e).__name__}: {str(e)[:700]}", 0.0
        print(f"{'ok  ' if ok else 'FAIL'} {n} {sec:.2f}s {note}", flush=True)
        bad += [] if ok else [n]
    print("failed:", bad)
