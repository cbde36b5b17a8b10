"""Micro-batch sinks at a batch's cost (SNK-2/3/4/6, STR-8, Q18).

A micro-batch writes its own rows and nothing else: ``foreachBatch`` overwrites
the batch's own ``batch_id=N`` directory, so a batch replayed after a restart
leaves the same files and the bytes written follow the batch, not the table;
they are kept for good, so they are compressed well.
An upsert is resolved on read: of a key's rows the latest by event order wins,
whichever batch brought it, so an older row that comes late changes nothing.
Readers are plain Parquet scans with one hash aggregate.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow.operators.merge import latest_per_key

BATCH = "batch_id"


def batch_path(path: str, batch_id: int) -> str:
    return os.path.join(path, f"{BATCH}={batch_id}")


def batch_append_sink(path: str, partition_by: tuple[str, ...] = ()):
    def write(batch: DataFrame, batch_id: int) -> None:
        out = batch.withColumn("_batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option("compression", "zstd")
        (out.partitionBy(*partition_by) if partition_by else out).parquet(batch_path(path, batch_id))
    return write


def read_batches(spark: SparkSession, path: str, upto: int | None = None) -> DataFrame:
    """All rows written so far, or those of the batches up to ``upto``."""
    df = spark.read.parquet(path).withColumn(BATCH, F.col(BATCH).cast("bigint"))
    return df if upto is None else df.where(F.col(BATCH) <= upto)


def read_latest(spark: SparkSession, path: str, key: list[str], order: Column | None = None,
                upto: int | None = None) -> DataFrame:
    """The row of each key that is latest by ``order``, the later batch on a tie."""
    df = read_batches(spark, path, upto)
    # the order is no column of its own: the rows that are sorted by key hold it once
    by = F.struct(*([order] if order is not None else []), F.col(BATCH))
    return latest_per_key(df.drop("_batch"), key, by).drop(BATCH)


def upsert_sink(path: str, key: list[str], order: Column, listing_path: str | None = None,
                listing_filter: Column | None = None, listing_by: tuple[str, ...] = ()):
    """SNK-2 (+ SNK-3 when ``listing_path`` is given): the batch, reduced to
    its latest row per key, is written once; the listing rows are taken from
    what was written, in directories by ``listing_by``. Read with
    ``read_latest(path, key, order)``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch_append_sink(path)(latest_per_key(batch, key, order), batch_id)
        if listing_path is not None:
            rows = batch.sparkSession.read.parquet(batch_path(path, batch_id))
            rows = rows if listing_filter is None else rows.where(listing_filter)
            batch_append_sink(listing_path, listing_by)(rows.drop("_batch"), batch_id)
    return write


def committed_batch(spark: SparkSession, checkpoint: str) -> int | None:
    """The newest batch the query of this checkpoint has finished, by Spark's
    own commit log (one file a batch); None before the first."""
    try:
        log = spark.read.text(os.path.join(checkpoint, "commits"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":     # only "no commit yet" means no batch
            raise
        return None
    return log.select(F.max(F.col("_metadata.file_name").cast("bigint"))).first()[0]


def recorded_version(spark: SparkSession, path: str, batch_id: int,
                     resolve: Callable[[], int | None]) -> int | None:
    """The version a micro-batch reads of another table: resolved at its first
    run and recorded, so that a replay reads the same one."""
    here = batch_path(path, batch_id)
    try:
        return spark.read.schema("version bigint").parquet(here).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    version = resolve()
    spark.range(1).select(F.lit(version).cast("bigint").alias("version")).write.mode("overwrite").parquet(here)
    return version


def kafka_sink(df: DataFrame, servers: str, topic: str, key_col: str, checkpoint: str):
    """SNK-1/SNK-5 on Kafka (where the connector is on the classpath): the
    record key is the business key (``order_id``), so consumers see one
    order's updates in order on one partition (Q15); the value is the row as
    JSON. Untested here: the connector jar is absent from this image."""
    out = df.select(F.col(key_col).cast("string").alias("key"),
                    F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("value"))
    return (out.writeStream.format("kafka")
            .option("kafka.bootstrap.servers", servers).option("topic", topic)
            .option("checkpointLocation", checkpoint).start())
