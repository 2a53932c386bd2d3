"""Comparison of a query's rows with those of its DuckDB SQL."""

from __future__ import annotations

import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for name in os.listdir(folder):
        if name.endswith(".parquet"):
            con.execute(f"create view {name[:-8]} as select * from '{folder}/{name}'")
    return con


def _value(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    return float(x) if isinstance(x, int) or type(x).__name__ == "Decimal" else x


def same(df, sql: str, con: duckdb.DuckDBPyConnection) -> None:
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    names = sorted(columns)
    assert names == sorted(df.columns)
    got, want = df.select(*names).collect(), [[r[columns.index(c)] for c in names] for r in found.fetchall()]
    rows = [sorted((tuple(map(_value, r)) for r in part), key=repr) for part in (got, want)]
    assert len(rows[0]) == len(rows[1])
    assert rows[0] == rows[1]
