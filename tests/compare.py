"""Order-insensitive comparison of a Spark query with its oracle SQL."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return ""
    if hasattr(x, "isoformat"):
        return pd.Timestamp(x).isoformat()
    if isinstance(x, float):
        return repr(0.0 if x == 0 else x)
    return str(x)


def rows(columns: list[str], data) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def spark_rows(df) -> list[tuple[str, ...]]:
    return rows(df.columns, df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple[str, ...]]]:
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    return columns, rows(columns, cur.fetchall())
