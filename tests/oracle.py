"""Runs a query and its oracle SQL on the same tables and compares rows."""

from __future__ import annotations

import datetime
import decimal
import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings chat_requests chat_messages metrics eval_items mixture_targets container_specs".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    if isinstance(value, float | decimal.Decimal):
        value = float(value)
        return "nan" if math.isnan(value) else f"{value:.6g}"
    if isinstance(value, int):
        return f"{float(value):.6g}" if abs(value) < 10**6 else str(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def compare(spark, con, folder: str, query, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    want = rows_of(names, found.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        here, there = set(got), set(want)
        extra, missing = sorted(here - there)[:3], sorted(there - here)[:3]
        return f"{len(got)} and {len(want)} rows; only here {extra}; only there {missing}"
    return ""
