"""Run registered queries against their SQL in DuckDB and compare all rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(sf: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = con.execute(sql)
    return [c[0] for c in cursor.description], cursor.fetchall()


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dt.date) and not isinstance(v, dt.datetime):
        return dt.datetime(v.year, v.month, v.day)
    return v


def normal(names: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def difference(spark, sf: str, run, sql: str) -> str | None:
    """None if both give the same rows, else a short description."""
    found = run(spark, sf)
    names, expected = oracle(sf, sql)
    if sorted(found.columns) != sorted(names):
        return f"columns {sorted(found.columns)} against {sorted(names)}"
    a = normal(found.columns, [tuple(r) for r in found.collect()])
    b = normal(names, expected)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}; first {a[:2]} against {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} against {y}"
    return None
