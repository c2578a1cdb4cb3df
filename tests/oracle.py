"""A query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{name}") else "")
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows: pd.DataFrame) -> pd.DataFrame:
    def cell(v):
        if v is None or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    rows = rows[sorted(rows.columns)]
    rows = rows.assign(**{c: [cell(v) for v in rows[c]] for c in rows.columns})
    return rows.sort_values(list(rows.columns), ignore_index=True)


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(plain(got), plain(want))
