"""Side-by-side comparison of a query and its SQL on the same Parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item") and not getattr(v, "shape", ()):
        v = v.item()
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return round(float(v), 5) + 0.0
    return str(v)


def rows(frame) -> list:
    frame = frame.reindex(sorted(frame.columns), axis=1).astype(object)
    return sorted((tuple(_plain(v) for v in r) for r in frame.itertuples(index=False)), key=repr)
