"""Inventory position, supply lookups, as-of enrichment and ATP (AGG-9/10/15,
LIM-7, JN-1/2/4/5/9).

Inventory change events come from adapter A: every lineitem row is a change
of its (sku, warehouse) row at ``l_shipdate`` carrying available (returned,
flag R), allocated (status F) and on-order (flag N) quantities; rows with
zero discount are deletes of that row (row-level delete is the default; the whole-SKU delete
of the original code is ``whole_sku=True``, Q16).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.functions.scan import segmented_scan, segmented_scan_multi
from orderflow.session import written
from orderflow.sources import adapters as A
from orderflow.sources.tables import read_table


def inventory_events(spark: SparkSession, sf_dir: str, sku: str | None = None) -> DataFrame:
    """Inventory change events; a numeric ``sku`` filters the native part
    key so the predicate reaches the parquet scan."""
    li = read_table(spark, sf_dir, "lineitem")
    if sku is not None:
        li = li.where(F.col("l_partkey") == F.lit(int(sku))) if sku.isdigit() \
            else li.where(F.col("l_partkey").cast("string") == F.lit(sku))
    q = F.col("l_quantity").cast(S.QTY)
    zero = F.lit(0).cast(S.QTY)
    return li.select(
        F.col("l_partkey").cast("string").alias("sku"),
        A.warehouse_of(F.col("l_suppkey")).alias("warehouse_id"),
        F.when(F.col("l_discount") == 0.0, "d").otherwise("u").alias("op"),
        F.col("l_shipdate").alias("ts"),
        F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                 "l_linestatus").alias("seq"),
        F.when(F.col("l_returnflag") == "R", q).otherwise(zero).alias("available_qty"),
        F.when(F.col("l_linestatus") == "F", q).otherwise(zero).alias("allocated_qty"),
        F.when(F.col("l_returnflag") == "N", q).otherwise(zero).alias("on_order_qty"))


def inventory_position(events: DataFrame, whole_sku: bool = False) -> DataFrame:
    """AGG-9: latest event per (sku, warehouse) via ``max_by`` (partial
    aggregation); a delete as latest event removes the row. With
    ``whole_sku`` a delete removes every warehouse row of the SKU written
    before it."""
    vals = ["op", "ts", "available_qty", "allocated_qty", "on_order_qty"]
    latest = (events.groupBy("sku", "warehouse_id")
              .agg(F.max_by(F.struct(*vals), F.col("seq")).alias("v"),
                   F.max("seq").alias("seq"))
              .select("sku", "warehouse_id", "seq", "v.*"))
    if whole_sku:
        last_del = (events.where(F.col("op") == "d").groupBy("sku")
                    .agg(F.max("seq").alias("del_seq")))
        latest = (latest.join(last_del, "sku", "left")
                  .where(F.col("del_seq").isNull() | (F.col("seq") > F.col("del_seq")))
                  .drop("del_seq"))
    return (latest.where(F.col("op") != "d")
            .select("sku", "warehouse_id", "available_qty", "allocated_qty", "on_order_qty",
                    F.col("ts").alias("updated_at")))


def inventory_deltas(events: DataFrame) -> DataFrame:
    """AGG-10: additive upsert — every event adds its quantities."""
    return events.groupBy("sku", "warehouse_id").agg(
        F.sum("available_qty").alias("available_qty"),
        F.sum("allocated_qty").alias("allocated_qty"),
        F.sum("on_order_qty").alias("on_order_qty"),
        F.count(F.lit(1)).alias("n_events"))


def supply_by_sku(position: DataFrame, sku: str | None = None) -> DataFrame:
    """LIM-7: all warehouses of a SKU (or every SKU), with SKU totals."""
    p = position if sku is None else position.where(F.col("sku") == sku)
    return p.groupBy("sku").agg(
        F.count(F.lit(1)).alias("warehouse_count"),
        F.sum("available_qty").alias("available_qty"),
        F.sum("allocated_qty").alias("allocated_qty"),
        F.sum("on_order_qty").alias("on_order_qty"),
        F.max("updated_at").alias("updated_at"))


def asof_inventory(lines: DataFrame, events: DataFrame, line_ts: Column) -> DataFrame:
    """JN-9: each line sees its SKU's supply as of its own time (inventory
    first on ties): the total over the warehouses whose latest event is no
    delete, their number, and the time of the SKU's newest event (0, 0 and
    null before the first). An event changes the total by what it adds to its
    warehouse's earlier row, so running sums per SKU carry the total forward:
    no pairwise join, and a hot SKU is split into time segments."""
    year = F.date_trunc("year", F.col("ts"))   # segments of the two-level prefix scans
    live = F.col("op") != "d"
    row = F.struct(F.when(live, F.col("available_qty")).otherwise(F.lit(0).cast(S.QTY)).alias("qty"),
                   live.cast("int").alias("live"))
    ev = segmented_scan(events.select("sku", "warehouse_id", "ts", "seq", row.alias("row")),
                        ["sku", "warehouse_id"], year, ["seq"], F.col("row"), "last", "was",
                        inclusive=False)
    zero = F.lit(0)
    # written once, as a few narrow columns: the second scan reads its input twice
    inv = written(ev.select("sku", "ts", (F.col("row.qty") - F.coalesce("was.qty", zero)).alias("d_qty"),
                            (F.col("row.live") - F.coalesce("was.live", zero)).alias("d_live")), "supply-changes")
    inv = inv.select("sku", "ts", F.lit(0).alias("side"), F.lit(None).cast("string").alias("line_id"), "d_qty", "d_live")
    ln = written(lines.select("sku", line_ts.alias("ts"), F.lit(1).alias("side"), "line_id"), "supply-lines")
    # a line sees all events of its time, in whatever order these lie
    u = segmented_scan_multi(inv.unionByName(ln, allowMissingColumns=True), ["sku"], year,
                             ["ts", "side"],
                             [("available", F.col("d_qty"), "sum"), ("count", F.col("d_live"), "sum"),
                              ("inv_ts", F.when(F.col("side") == 0, F.col("ts")), "max")])
    return u.where(F.col("side") == 1).select(
        "line_id", "sku", F.col("ts").alias("line_ts"), "inv_ts",
        F.col("count").cast("bigint").alias("warehouse_count"),
        F.col("available").alias("available_qty"))


def enrich_with_state(df: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """JN-1/JN-5: left join a keyed state snapshot. No broadcast hint: the
    planner (and AQE at runtime) broadcasts only after measuring the side."""
    return df.join(state, key, "left")


def atp_by_inventory(lines: DataFrame, position: DataFrame) -> DataFrame:
    """JN-2: demand per (order, sku) vs available supply per sku; pooled
    (total demand <= total available) and per-SKU (every SKU covered)."""
    demand = (lines.groupBy("order_id", "sku")
              .agg(F.sum(F.col("quantity").cast(S.QTY)).alias("demand")))
    supply = position.groupBy("sku").agg(F.sum("available_qty").alias("available"))
    j = demand.join(supply, "sku", "left").withColumn(
        "available", F.coalesce(F.col("available"), F.lit(0).cast(S.QTY)))
    return j.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("sku_count"),
        F.sum("demand").alias("total_demand"),
        F.sum("available").alias("total_available"),
        (F.sum("demand") <= F.sum("available")).alias("atp_pooled"),
        F.bool_and(F.col("demand") <= F.col("available")).alias("atp_per_sku"))
