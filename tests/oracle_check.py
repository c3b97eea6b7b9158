"""Run a query and its SQL on the same tables; compare rows, whatever their order."""

from __future__ import annotations

import glob
import os

import duckdb


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    fix = lambda v: round(float(v), 6) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr), [columns[i] for i in order]


def both(spark, query, sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    con.execute("set timezone = 'UTC'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = canonical(cur.fetchall(), names)
    df = query(spark, sf_dir)
    return canonical([tuple(r) for r in df.collect()], df.columns), want
