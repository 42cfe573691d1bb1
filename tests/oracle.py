"""Runs oracle SQL in DuckDB and compares it with a Spark result."""

from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows as tuples over name-sorted columns, sorted; all kinds of missing values alike, -0.0 kept apart."""
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    rows = (tuple(repr(value) for value in row) for row in frame.itertuples(index=False, name=None))
    return sorted(rows)


def schema_of(frame: pd.DataFrame) -> dict[str, str]:
    return {name: str(frame[name].dtype) for name in sorted(frame.columns)}
