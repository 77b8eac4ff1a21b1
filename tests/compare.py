"""Compares a query with its SQL the way the driver does: columns by name, rows in any order."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((plain(k), plain(v)) for k, v in x.items()))
    return bytes(x) if isinstance(x, (bytearray, bytes)) else x


def rows_of_sql(sql: str, folder: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{folder}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    con.execute(f"CREATE TABLE result__ AS {sql}")
    names = [r[0] for r in con.execute("DESCRIBE result__").fetchall()]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in con.execute("SELECT * FROM result__").fetchall())


def rows_of_spark(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[c]) for c in names) for r in df.collect())


def differences(df, sql: str, folder: str) -> str:
    a, b = rows_of_spark(df), rows_of_sql(sql, folder)
    if a[0] != b[0]:
        return f"columns {a[0]} against {b[0]}"
    if a[1] != b[1]:
        return f"{sum(a[1].values())} rows against {sum(b[1].values())}; only here {list((a[1] - b[1]).items())[:2]}; only there {list((b[1] - a[1]).items())[:2]}"
    return ""
