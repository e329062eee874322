"""Spark results against DuckDB's on the same Parquet files."""

import decimal
import math
from pathlib import Path

import duckdb


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v


def spark_rows(df) -> tuple[list[str], list[str]]:
    names = sorted(df.columns)
    return names, sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[str]]:
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    names = sorted(cols)
    return names, sorted(repr(tuple(plain(dict(zip(cols, r, strict=True))[c]) for c in names)) for r in cur.fetchall())
