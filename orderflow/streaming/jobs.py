"""Streaming jobs (STR-1..12, SNK-1/4/5/8): the two chained queries of the
pipeline plus the dashboard push.

* ``start_order_state_job``: raw CDC lines -> parse (rejects to the dead
  letter sink) -> LSN dedup within the watermark -> keyed state fold ->
  enriched parquet sink (exactly-once file sink, SNK-1).
* ``start_backlog_job``: enriched directory as a stream -> backlog records ->
  event-time windows with a 30 s watermark, append mode (only closed windows)
  -> idempotent ``foreachBatch`` sink keyed by the window key (SNK-4).
* ``start_lifecycle_job``: one text stream per table topic, each with its own
  watermark, united into the whole order state (``streaming.lifecycle``).
* ``start_windows_job``: several window sizes from one pass, late rows as a
  second output (``streaming.windows``).
* ``start_inventory_state_job`` / ``start_order_supply_job``: the inventory
  position, and order lines that read it at a recorded version.
* ``start_dashboard_job``: every trigger recomputes the backlog summary from
  the metric table and stores it with the batch id (STR-10).

Each job gets its own checkpoint folder under ``spark.checkpoint.dir``
(replay from earliest = a fresh folder, STR-12).
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow import schemas as S
from orderflow.operators import backlog as BL
from orderflow.operators import cdc as CDC
from orderflow.session import stateful, unsorted_writes
from orderflow.streaming import fold as FOLD
from orderflow.streaming import lifecycle as LC
from orderflow.streaming import sinks as SK
from orderflow.streaming import windows as WIN
from orderflow.streaming.sources import parquet_stream, route_by_topic, text_stream

WINDOW_KEY = [*BL.KEY, "window_type", "window_start"]


def _trigger(w, available_now: bool, interval: str):
    return w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)


def dedup_stream(changes: DataFrame, strict: bool = False, lossless: bool = False) -> DataFrame:
    """STR-5 on a stream; null/0 LSN passes through.

    By default ``dropDuplicatesWithinWatermark`` on the keyed branch: state
    bounded by the watermark (Q12), rows behind it are dropped. ``lossless``
    keeps every key instead and drops nothing but redeliveries; the fold
    uses it, since a late event still belongs to its order."""
    image = F.coalesce(F.col("after"), F.col("before"))
    df = changes.withColumn("_pk", CDC.row_pk(F.col("source_table"), image))
    keyed = F.col("lsn").isNotNull() & (F.col("lsn") != 0)
    key = ["order_id", "lsn"] if strict else ["order_id", "source_table", "_pk", "lsn"]
    if lossless:
        kept = df.where(keyed).dropDuplicates(key)
    else:
        df = (df.withColumn("event_ts", F.col("ts").cast("timestamp"))
              .withWatermark("event_ts", S.WATERMARK_DELAY))
        kept = df.where(keyed).dropDuplicatesWithinWatermark(key)
    # event_ts stays: it carries the watermark to later stateful operators
    return kept.unionByName(df.where(~keyed)).drop("_pk")


def start_order_state_job(spark: SparkSession, raw_dir: str, out_dir: str, dlq_dir: str,
                          ckpt: str, available_now: bool = True,
                          interval: str = "30 seconds", max_files: int | None = None,
                          ttl_days: int | None = None):
    """``max_files`` bounds a micro-batch, which also bounds the rows one
    order contributes to a single call of the stateful function. Late and
    out-of-order events are folded at their event position. ``ttl_days`` is off
    by default: it expires idle orders from the state store by event time,
    which needs the watermark and so gives up events behind it."""
    parsed = CDC.parse_envelope(text_stream(spark, raw_dir, max_files))
    dlq = CDC.dead_letters(parsed, "cdc.public.orders")
    q_dlq = _trigger(dlq.writeStream.format("parquet")
                     .option("checkpointLocation", os.path.join(ckpt, "dlq")),
                     available_now, interval).start(dlq_dir)
    changes = dedup_stream(CDC.valid(parsed), lossless=not ttl_days)
    with stateful(spark):
        enriched = observe_fold(FOLD.stream_order_state(changes, ttl_days=ttl_days))
        q = _trigger(enriched.writeStream.format("parquet")
                     .option("checkpointLocation", os.path.join(ckpt, "fold")),
                     available_now, interval).start(out_dir)
    return q, q_dlq


def observe_fold(enriched: DataFrame) -> DataFrame:
    """AGG-14 live: per micro-batch row count, newest event time and pipeline
    latency percentiles (batch time - event time), reported in the query
    progress under ``observedMetrics["fold"]``. ``percentile_approx`` keeps
    the metric's memory bounded whatever the batch size."""
    lat = (F.unix_micros(F.current_timestamp()) -
           F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(1e6)
    return enriched.observe(
        "fold", F.count(F.lit(1)).alias("rows"), F.max("ts").alias("max_event_ts"),
        F.percentile_approx(lat, [0.5, 0.95, 0.99], 1000).alias("latency_p50_p95_p99_s"))


def enriched_schema() -> T.StructType:
    """Schema of the enriched directory (the fold's output, NTZ timestamps)."""
    return T.StructType([T.StructField(f.name, T.TimestampNTZType())
                         if f.name in ("ts", "expected_ship_date", "created_at", "updated_at")
                         else f for f in FOLD.OUT_SCHEMA.fields])


def windowed_backlog_stream(records: DataFrame, size: str, slide: str | None,
                            window_type: str) -> DataFrame:
    """STR-1/2/3: watermark + event-time window aggregate (append mode emits
    a window once the watermark passes its end)."""
    w = F.window(F.col("event_ts"), size, slide or size)
    r = (records.withColumn("event_ts", F.col("ts").cast("timestamp"))
         .withWatermark("event_ts", S.WATERMARK_DELAY))
    g = r.groupBy(*BL.KEY, w.alias("w")).agg(*BL._measures(r))
    return g.select(*BL.KEY, F.lit(window_type).alias("window_type"),
                    F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), *BL._finish(g))


def start_backlog_job(spark: SparkSession, enriched_dir: str, metrics_dir: str, ckpt: str,
                      as_of: Column, size: str = S.SLIDING_SIZE,
                      slide: str | None = S.SLIDING_SLIDE, window_type: str = "sliding_1h",
                      available_now: bool = True, interval: str = "30 seconds"):
    cl = parquet_stream(spark, enriched_dir, enriched_schema())
    rec = BL.backlog_records(cl, as_of)
    out = windowed_backlog_stream(rec, size, slide, window_type)
    return _trigger(out.writeStream.outputMode("append")
                    .option("checkpointLocation", ckpt)
                    .foreachBatch(SK.batch_append_sink(metrics_dir)),
                    available_now, interval).start()


def start_dashboard_job(spark: SparkSession, metrics_dir: str, summary_dir: str, ckpt: str,
                        metrics_schema, available_now: bool = True,
                        interval: str = "30 seconds", retention_days: int | None = None):
    """STR-10: on each trigger, recompute the summary from the whole metric
    table (not only the new rows) and store it under the batch id. As in the
    batch summary, ``retention_days`` is off unless asked for."""
    def push(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        m = SK.read_latest(spark, metrics_dir, WINDOW_KEY)
        if retention_days:
            newest = m.select(F.max("window_start")).scalar()
            m = m.where(F.col("window_start") >= newest - F.make_dt_interval(days=F.lit(retention_days)))
        summary = BL.backlog_summary(m).withColumn("type", F.lit("backlog_update"))
        SK.batch_append_sink(summary_dir)(summary, batch_id)
    src = spark.readStream.schema(metrics_schema).parquet(metrics_dir)
    return _trigger(src.writeStream.option("checkpointLocation", ckpt).foreachBatch(push),
                    available_now, interval).start()


def start_inventory_state_job(spark: SparkSession, events_dir: str, state_dir: str, ckpt: str,
                              schema: T.StructType, max_files: int | None = 1,
                              available_now: bool = True, interval: str = "30 seconds"):
    """STR-6/AGG-9 on a stream: inventory change events maintain the
    (sku, warehouse) position table, a batch's own rows at a time; read it
    with ``inventory_at``."""
    src = parquet_stream(spark, events_dir, schema, max_files)
    return _trigger(src.writeStream.option("checkpointLocation", ckpt)
                    .foreachBatch(SK.upsert_sink(state_dir, ["sku", "warehouse_id"], F.col("seq"))),
                    available_now, interval).start()


def inventory_at(spark: SparkSession, state_dir: str, version: int | None = None) -> DataFrame:
    """The position table after micro-batch ``version`` (default: all). Deletes
    are rows as well, so that an older event cannot bring a row back."""
    return SK.read_latest(spark, state_dir, ["sku", "warehouse_id"], F.col("seq"), version).where(F.col("op") != "d")


def start_order_supply_job(spark: SparkSession, lines_dir: str, schema: T.StructType, state_dir: str,
                           state_ckpt: str, out_dir: str, ckpt: str, max_files: int | None = None,
                           available_now: bool = True, interval: str = "30 seconds"):
    """JN-1/STR-6: order lines (``sku``, ``quantity``) joined with the supply of
    their SKU. The static side is resolved anew in each micro-batch, at the
    newest batch the inventory query has committed; that version is recorded
    and stands in each row, and a replayed batch reads the same one. Spark's
    measured sizes decide whether the supply is broadcast."""
    def write(batch: DataFrame, batch_id: int) -> None:
        v = SK.recorded_version(spark, os.path.join(out_dir, "versions"), batch_id,
                                lambda: SK.committed_batch(spark, state_ckpt))
        if v is None:
            supply = batch.select("sku", F.lit(0).cast(S.QTY).alias("available_qty")).where("false")
        else:
            supply = inventory_at(spark, state_dir, v).groupBy("sku").agg(F.sum("available_qty").alias("available_qty"))
        rows = batch.join(supply, "sku", "left").select(
            *batch.columns, "available_qty", F.lit(v).cast("bigint").alias("position_version"),
            (F.coalesce("available_qty", F.lit(0)) >= F.col("quantity")).alias("atp_feasible"))
        SK.batch_append_sink(os.path.join(out_dir, "rows"))(rows, batch_id)
    src = parquet_stream(spark, lines_dir, schema, max_files)
    return _trigger(src.writeStream.option("checkpointLocation", ckpt).foreachBatch(write),
                    available_now, interval).start()


def topic_changes(spark: SparkSession, sources: dict[str, str], max_files: int | None = None,
                  delay: str = S.WATERMARK_DELAY) -> DataFrame:
    """SET-1/STR-1: one stream per topic, each with its own event-time
    watermark, united. Spark takes the lowest of them for the operators behind
    (``spark.sql.streaming.multipleWatermarkPolicy`` = min, set in
    ``session.BASE_CONF``), so a slow source holds windows open."""
    streams = []
    for path in sources.values():
        ch = CDC.valid(CDC.parse_envelope(text_stream(spark, path, max_files)))
        streams.append(ch.withColumn("event_ts", F.col("ts").cast("timestamp")).withWatermark("event_ts", delay))
    return CDC.union_changes(*streams)


def start_lifecycle_job(spark: SparkSession, sources: dict[str, str], state_dir: str, ckpt: str,
                        listing_dir: str | None = None, max_files: int | None = None,
                        settle: int | None = None, ttl_days: int | None = None,
                        initial_state: DataFrame | None = None,
                        after_write: Callable[[int], None] | None = None, pages: int | None = None,
                        available_now: bool = True, interval: str = "30 seconds"):
    """The whole order state over any number of table topics; see
    ``streaming.lifecycle`` for what is written, how long state lives and how
    many ``pages`` the orders share."""
    with stateful(spark):
        rows = LC.fold_orders_stream(topic_changes(spark, sources, max_files), settle, ttl_days, initial_state, pages)
        rows = rows.observe("lifecycle", F.count(F.lit(1)).alias("rows"),
                            F.count_if(F.col("kind") == "order").alias("orders"))
        return _trigger(rows.writeStream.outputMode("update").option("checkpointLocation", ckpt)
                        .foreachBatch(LC.lifecycle_sink(state_dir, listing_dir, after_write)),
                        available_now, interval).start()


def start_table_windows_job(spark: SparkSession, sources: dict[str, str], out_dir: str, ckpt: str,
                            size: str = "30 days", max_files: int | None = None,
                            available_now: bool = True, interval: str = "30 seconds"):
    """Events per table and window over the united topics, in append mode: a
    window leaves once the watermark of the slowest topic has passed it."""
    ch = topic_changes(spark, sources, max_files)
    g = ch.groupBy(F.window("event_ts", size).alias("w"), "source_table").agg(F.count(F.lit(1)).alias("events"))
    out = g.select("source_table", F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                   F.col("w.end").cast("timestamp_ntz").alias("window_end"), "events")
    return _trigger(out.writeStream.outputMode("append").option("checkpointLocation", ckpt)
                    .foreachBatch(SK.batch_append_sink(out_dir)), available_now, interval).start()


def start_windows_job(spark: SparkSession, records: DataFrame, rows_dir: str, metrics_dir: str, ckpt: str,
                      specs: dict = WIN.SPECS, available_now: bool = True, interval: str = "30 seconds"):
    """Backlog windows of every size in ``specs`` and the late rows, from one
    stateful step over a stream of backlog records."""
    with stateful(spark):
        return _trigger(WIN.fold_windows(records, specs).writeStream.outputMode("append")
                        .option("checkpointLocation", ckpt)
                        .foreachBatch(WIN.window_sink(rows_dir, metrics_dir, specs)),
                        available_now, interval).start()


def start_topic_router_job(spark: SparkSession, root: str, out_dir: str, ckpt: str,
                           max_files: int | None = None, available_now: bool = True,
                           interval: str = "30 seconds"):
    """SRC-3: one subscription to all topics (directories ``topic=...`` of
    ``root``). A batch is routed to its topics' parsers in one write; rejects
    keep their topic as well."""
    def write(batch: DataFrame, batch_id: int) -> None:
        parsed = [CDC.parse_envelope(rows).withColumn("topic", F.lit(topic))
                  for topic, rows in route_by_topic(batch, S.TOPICS).items()]
        with unsorted_writes(batch.sparkSession):
            SK.batch_append_sink(out_dir, ("topic",))(CDC.union_changes(*parsed), batch_id)
    return _trigger(text_stream(spark, root, max_files).writeStream
                    .option("checkpointLocation", ckpt).foreachBatch(write),
                    available_now, interval).start()


def order_document(enriched: DataFrame) -> DataFrame:
    """PRJ-12 on the enriched stream: search document per state row (ISO
    timestamps, required non-empty order id)."""
    from orderflow.functions import expressions as X
    return enriched.where(F.coalesce(F.col("order_id"), F.lit("")) != "").select(
        "order_id", "customer_id", "customer_name", "channel", "business_unit",
        "product_family", "order_status", "priority_tier", "total_value", "currency",
        X.ts_to_iso(F.col("created_at")).alias("created_at"),
        X.ts_to_iso(F.col("updated_at")).alias("updated_at"),
        X.ts_to_iso(F.col("expected_ship_date")).alias("expected_ship_date"),
        F.col("version").alias("_seq"))


def start_index_sync_job(spark: SparkSession, enriched_dir: str, docs_dir: str, ckpt: str,
                         available_now: bool = True, interval: str = "2 seconds"):
    """SNK-6: documents upserted by ``order_id`` per micro-batch (2 s
    trigger in production); an order's highest version wins on read, and a
    replay of the same batch id rewrites the same rows."""
    docs = order_document(parquet_stream(spark, enriched_dir, enriched_schema()))
    return _trigger(docs.writeStream.option("checkpointLocation", ckpt)
                    .foreachBatch(SK.upsert_sink(docs_dir, ["order_id"], F.col("_seq"))),
                    available_now, interval).start()
