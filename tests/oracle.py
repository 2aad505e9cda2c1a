"""Holds a query's rows against those of its SQL."""

from __future__ import annotations

import math
import os

import duckdb


def rows_of(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def _plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return int(x) if isinstance(x, bool) else x


def normal(columns: list[str], rows) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark_df, con, sql: str) -> None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(names) == sorted(spark_df.columns)
    got = normal(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    want = normal(names, want)
    assert len(got) == len(want)
    assert got == want, next((a, b) for a, b in zip(got, want, strict=True) if a != b)
