"""Runs a query and its SQL on DuckDB and compares the rows, order aside."""

import math
import os
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return v


def rows(columns: list[str], values) -> list[str]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr([plain(v[k]) for k in order]) for v in values)


def same(df, connection, sql: str) -> None:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    expected = rows(names, result.fetchall())
    assert len(got) == len(expected)
    assert got == expected
