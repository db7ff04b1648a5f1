"""Rows of a query and of its DuckDB form, comparable."""

from __future__ import annotations

import math
import os

import duckdb


def normal(v):
    if hasattr(v, "item"):
        v = v.item()
    return (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


def rows_of(df) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(normal(r[c]) for c in cols) for r in df.collect()), key=repr)


def oracle_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    q = con.execute(sql)
    names = [d[0] for d in q.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(normal(r[i]) for i in order) for r in q.fetchall()), key=repr)
