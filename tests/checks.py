"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if Path(path).exists():
            con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if Path(path).is_dir() else ''}'")
    return con


def comparable(df: pd.DataFrame) -> list[tuple[str, ...]]:
    def plain(x: object) -> str:
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, float):
            return repr(round(x, 6) + 0.0)
        if isinstance(x, bool):
            return str(x)
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        return repr(float(x)) if str(x).lstrip("-").isdigit() else str(x)

    return sorted(tuple(plain(x) for x in row) for row in df[sorted(df.columns)].itertuples(index=False))


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    assert comparable(got) == comparable(want)
