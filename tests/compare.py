"""Comparison of a Spark result with DuckDB's answer to the SQL of the same query."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import numpy as np
from pyspark.sql import DataFrame, Row


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    """A value that compares alike, whichever engine it came from."""
    if isinstance(x, Row | tuple):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(map(plain, x.values()))
    if isinstance(x, list | np.ndarray):
        return tuple(map(plain, x))
    if isinstance(x, Decimal | np.floating | float):
        return "nan" if math.isnan(x) else round(float(x), 6) + 0.0
    if isinstance(x, np.integer):
        return int(x)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def ordered(rows: list[tuple]) -> list[tuple]:
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


def assert_same(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    names = sorted(df.columns)
    want = con.execute(sql)
    order = [d[0] for d in want.description]
    assert sorted(order) == names
    at = [order.index(n) for n in names]
    expected = ordered([tuple(r[i] for i in at) for r in want.fetchall()])
    found = ordered([tuple(r) for r in df.select(*names).collect()])
    assert len(found) == len(expected)
    for a, b in zip(found, expected, strict=True):
        assert a == b
