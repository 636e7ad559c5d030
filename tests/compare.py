"""Holds queries against their SQL: the same columns, and the same rows in any order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(d: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{d}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    return con


def plain(x: object) -> object:
    """A value whose equals are equal whatever engine they come from."""
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def rows(columns: list[str], data: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def difference(spark_columns: list[str], spark_rows: list[tuple], sql_columns: list[str], sql_rows: list[tuple]) -> str:
    """What differs, or an empty string; numbers may differ by two units of the sixth digit."""
    if sorted(spark_columns) != sorted(sql_columns):
        return f"columns {sorted(spark_columns)} and {sorted(sql_columns)}"
    a, b = rows(spark_columns, spark_rows), rows(sql_columns, sql_rows)
    if len(a) != len(b):
        return f"{len(a)} rows and {len(b)}: {[x for x in a if x not in set(b)][:2]} {[x for x in b if x not in set(a)][:2]}"
    key = [(repr([v for v in r if not isinstance(v, float)]), r) for r in a], [(repr([v for v in r if not isinstance(v, float)]), r) for r in b]
    for (_, x), (_, y) in zip(*map(sorted, key), strict=True):
        for u, v in zip(x, y, strict=True):
            if u != v and not (isinstance(u, (int, float)) and isinstance(v, (int, float)) and abs(u - v) <= 2.1e-6 * max(1, abs(u))):
                return f"{x} and {y}"
    return ""
