"""A training corpus from ``documents``: filter, near-dedup, decontaminate, mix, shard.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs. All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.llm import fairqueue, histosort, quality, simhash, winnow
from orderflow.llm.common import table, text_of, write_once
from orderflow.session import checkpoint_root, ship_package

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 16


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that fail the base rules or a band go.

    Null and empty texts fail; repeated rows fare alike; an empty table stays empty.
    """
    ship_package(spark)
    return quality.quality(docs).where("quality.kept").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each component one row stays, of the document with the smallest id.

    A row without an id stays if its component has no id. Of rows that repeat with the
    winning id, or all lack one, a single one stays. Null and empty texts are one
    component; an empty table stays empty.
    """
    ship_package(spark)
    return simhash.near_duplicates(docs, shingle=3, max_bits=2, keep_one=True).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that hold a window of a benchmark item go.

    Null and empty texts hold none; repeated rows fare alike; without items all stay.
    """
    ship_package(spark)
    out = winnow.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where("leak.n_hit = 0").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: each document as many times as the mix takes it.

    Null and empty texts are never taken; a null source is one of its own; an empty table
    stays empty.
    """
    mixed = fairqueue.fair_mix(docs)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("copies")))
    return mixed.where("copies > 0").withColumn("_copy", copies).select(*COLUMNS)


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: 16 shards of near equal bytes; null texts count as empty, copies lie side by side."""
    rows = docs.withColumn("text_crc32", F.crc32(F.encode(text_of(), "UTF-8")))
    return histosort.histogram_shard(rows, SHARDS).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", keep_one_of_each_group),
    ("benchmark_decontamination", drop_leaks),
    ("source_mix", mix_sources),
    ("sharding", deal_shards),
]

#: Tokenizers and XXH64 are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read again."""
    checkpoint_root(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        write_once(stage(spark, docs, sf_dir), f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
