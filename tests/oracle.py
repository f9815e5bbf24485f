"""Compares a query with its SQL on DuckDB: rows as multisets, floats to six places."""

from __future__ import annotations

import glob
import os
from decimal import Decimal

import duckdb
import numpy as np


def norm(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(norm, v))
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, Decimal, np.floating)):
        return round(float(v), 6)
    if isinstance(v, (int, np.integer)):
        return int(v)
    return str(v)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def differences(df, con, sql: str) -> tuple[list, list]:
    cols = sorted(df.columns)
    ours = sorted(repr(tuple(norm(r[c]) for c in cols)) for r in df.collect())
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    theirs = sorted(repr(tuple(norm(r[i]) for i in at)) for r in cur.fetchall())
    if ours == theirs:
        return [], []
    a, b = set(ours), set(theirs)
    return [x for x in ours if x not in b][:3] or ["repeated"], [x for x in theirs if x not in a][:3] or ["repeated"]
