"""Comparison of a query with its SQL over the same tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connection(folder: str):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    try:
        return round(float(value), 6)
    except (TypeError, ValueError):
        return str(value)


def bag(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def same(spark, folder: str, query, sql: str, con) -> None:
    df = query(spark, folder)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got, want = bag(df.columns, df.collect()), bag(names, cursor.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
