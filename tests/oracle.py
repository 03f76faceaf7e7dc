"""Runs a registered query and its SQL over the same tables and compares rows, by sorted column names."""

from __future__ import annotations

import datetime
import math
import os

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else (x + 0.0 if x else 0.0)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return datetime.datetime(x.year, x.month, x.day).isoformat()
    return x


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name: str, query, sql: str, folder: str) -> str | None:
    """What differs, or None."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [x[0] for x in result.description]
    want = rows_of(names, result.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{name}: {len(got)} and {len(want)} rows"
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{name}: {len(bad)} rows differ, such as {bad[0]}" if bad else None
