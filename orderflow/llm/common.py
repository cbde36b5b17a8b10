"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.session import checkpoint_root

#: Words are runs of characters other than space and TAB..CR.
WORD = r"[^\x20\x09-\x0D]+"
#: Files of the public tokenizers; a parameter of every operator that reads them.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table written to the cluster's shared checkpoint folder.

    The files stay until the folder is cleaned, like any checkpoint's.
    """
    spark = df.sparkSession
    checkpoint_root(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    write_once(df, path)
    return spark.read.schema(df.schema).parquet(path)


def write_once(df: DataFrame, path: str) -> None:
    """Write Parquet; the shuffle files of the write go when it ends, not when the driver's heap fills."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key)
    conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, was)


def apart(docs: DataFrame, used: set[str], replaced: set[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """``docs`` with only the ``used`` columns under their own names, so that no other can
    clash with a column an operator adds on the way, and a function that gives a result its
    input columns back, less the ``replaced`` ones, and the added ones behind them."""
    kept = [c for c in docs.columns if c.lower() not in replaced]
    safe = {c: c if c in used else f"in{i}" for i, c in enumerate(kept)}
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")

    def back(out: DataFrame, *added: Column) -> DataFrame:
        return out.select(*[F.col(safe[c]).alias(c) for c in kept], *added)

    return docs.select(*[quoted(c).alias(safe[c]) for c in kept]), back


def text_of(col: str = "text") -> Column:
    """A text, null as the empty one."""
    return F.coalesce(F.col(col), F.lit(""))


def row_key() -> Column:
    """Tells (doc_id, text) pairs apart; the id's length keeps the two from running into each other."""
    doc = F.col("doc_id").cast("string")
    return F.md5(F.concat(F.coalesce(F.length(doc), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(doc, F.lit("")), text_of()))


@lru_cache(maxsize=None)
def read_bytes(path: str) -> bytes:
    """A vocabulary file (about 1 MB), read on the driver and shipped with the tasks."""
    with open(path, "rb") as f:
        return f.read()
