"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_bool_dtype(s):
            df[c] = s.map(str)
        elif pd.api.types.is_numeric_dtype(s):
            df[c] = s.astype(float).map(lambda v: "" if np.isnan(v) else repr(v + 0.0))
        elif pd.api.types.is_datetime64_any_dtype(s):
            df[c] = s.astype("datetime64[us]").astype(str)
        else:
            df[c] = s.map(lambda v: "" if v is None or v is pd.NaT or v is pd.NA
                          or (isinstance(v, float) and np.isnan(v)) else str(v))
    return df.sort_values(list(df.columns), ignore_index=True)


def differences(got: pd.DataFrame, expected: pd.DataFrame) -> str:
    """Empty when both tables hold the same rows."""
    if sorted(got.columns) != sorted(expected.columns):
        return f"columns {sorted(got.columns)} != {sorted(expected.columns)}"
    if len(got) != len(expected):
        return f"rows {len(got)} != {len(expected)}"
    a, b = _plain(got), _plain(expected)
    wrong = (a != b).any(axis=1)
    if not wrong.any():
        return ""
    i = int(np.flatnonzero(wrong)[0])
    cells = {c: (a.at[i, c], b.at[i, c]) for c in a.columns if a.at[i, c] != b.at[i, c]}
    return f"{int(wrong.sum())} of {len(a)} rows differ, first: {cells}"
