"""Spark result vs DuckDB oracle comparison (order-insensitive, by column
name), shared by ``scripts/check_oracle.py`` and the test suite."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

from orderflow.sources.tables import TABLES, table_path


def oracle_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = table_path(sf_dir, t)
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v, digits=None):
    if v is None:
        return None
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        v = v.item()
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    if isinstance(v, float):
        if digits is not None:
            return round(v, digits)
        return v
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        return str(list(v))
    return v


def _rows(df: pd.DataFrame, digits=None):
    cols = sorted(df.columns)
    out = [tuple(_norm(r[c], digits) for c in cols) for _, r in df[cols].iterrows()]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


def compare(name, sdf: pd.DataFrame, odf: pd.DataFrame) -> tuple[bool, str]:
    if sorted(sdf.columns) != sorted(odf.columns):
        return False, f"columns spark={sorted(sdf.columns)} oracle={sorted(odf.columns)}"
    if len(sdf) != len(odf):
        return False, f"rows spark={len(sdf)} oracle={len(odf)}"
    a, b = _rows(sdf), _rows(odf)
    if a == b:
        return True, f"{len(sdf)} rows exact"
    a6, b6 = _rows(sdf, 6), _rows(odf, 6)
    if a6 == b6:
        return False, f"{len(sdf)} rows: float differences only"
    diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
    return False, f"value mismatch, e.g. {diff}"


