"""Batch table sources.

``read_table`` is the single entry point to the driver's parquet tables; the
scan is lazy, so Catalyst prunes columns and pushes filters into it.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_serving_table(spark: SparkSession, path: str, **keys) -> DataFrame:
    """Scan a serving table written with ``partitionBy``; equality filters on
    partition columns prune directories before any file is opened (SRC-5)."""
    from pyspark.sql import functions as F
    df = spark.read.parquet(path)
    for k, v in keys.items():
        if v is not None:
            df = df.where(F.col(k) == F.lit(v))
    return df
