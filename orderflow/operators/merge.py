"""Keyed upsert merge (JN-6) — the batch core of the idempotent sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """WIN-1 / last write wins within one batch: ``max_by`` of the whole row
    (hash aggregate with partial aggregation; no sort of a hot key)."""
    cols = [c for c in df.columns if c not in key]
    return (df.groupBy(*key).agg(F.max_by(F.struct(*cols), order).alias("_v"))
            .select(*key, "_v.*"))


def upsert_merge(base: DataFrame, delta: DataFrame, key: list[str],
                 order: Column | None = None) -> DataFrame:
    """New rows replace stored rows with the same key; untouched stored rows
    stay. ``delta`` is first reduced to its latest row per key when an
    ordering is given."""
    if order is not None:
        delta = latest_per_key(delta, key, order)
    keep = base.join(delta.select(*key), key, "left_anti")
    return delta.unionByName(keep)
