"""Run registered queries next to their SQL twins and compare whole results.

``python tests/oracle_check.py <sf_dir> [name ...]`` prints one line per query.
"""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return None if v != v else (int(v) if v == int(v) and abs(v) < 2**53 else v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(got_cols, got, want_cols, want):
    g, w = rows_of(got_cols, got), rows_of(want_cols, want)
    if g[0] != w[0]:
        return f"columns {g[0]} != {w[0]}"
    if g[1] == w[1]:
        return ""
    gs, ws = set(map(repr, g[1])), set(map(repr, w[1]))
    return (f"rows {len(g[1])} vs {len(w[1])}; only spark: {sorted(gs - ws)[:3]} only sql: {sorted(ws - gs)[:3]}")


def check(spark, con, sf_dir, name, fn, sql):
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    spent = time.time() - t
    if sql is None:
        return f"rows only: {len(got)}", spent
    cur = con.execute(sql)
    problem = compare(df.columns, got, [d[0] for d in cur.description], cur.fetchall())
    return problem or (f"ok {len(got)}" if got else "EMPTY"), spent


if __name__ == "__main__":
    import __spark_entry__ as e
    from telespark.plans.session import build_session
    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = build_session("8"), duck(sf)
    qs, sqls = e.queries(), e.oracle_sql()
    bad = 0
    for n in qs:
        if names and not any(n.startswith(p) for p in names):
            continue
        try:
            msg, spent = check(spark, con, sf, n, qs[n], sqls.get(n))
        except Exception as ex:  # report and go on
            msg, spent = f"FAILED {type(ex).__name__}: {str(ex)[:700]}", 0
        if not msg.startswith(("ok", "rows only")):
            bad += 1
        print(f"{spent:6.2f}s {n}: {msg}", flush=True)
    print("bad:", bad)
    spark.stop()
