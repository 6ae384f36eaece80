"""Side-by-side check of a Spark result and its DuckDB restatement."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    return type(value).__name__


def _norm(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark_df, con, sql: str) -> str:
    """Empty string if equal, else what differs first."""
    result = con.execute(sql)
    sql_cols = [d[0] for d in result.description]
    sql_rows = result.fetchall()
    cols = spark_df.columns
    if sorted(cols) != sorted(sql_cols):
        return f"columns {sorted(cols)} != {sorted(sql_cols)}"
    a = rows_of(cols, [tuple(r) for r in spark_df.collect()])
    b = rows_of(sql_cols, sql_rows)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    names = sorted(cols)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    for x, y in zip(a, b):
        for name, v, w in zip(names, x, y):
            if v is not None and w is not None and _kind(v) != _kind(w):
                return f"type of {name}: {_kind(v)} != {_kind(w)} ({v!r}, {w!r})"
    return f"{len(bad)} of {len(a)} rows differ, {names}: {str(bad[0])[:900]}" if bad else ""
