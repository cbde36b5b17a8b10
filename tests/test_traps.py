"""Hand-written rows for the semantic traps and the idempotent sinks."""

import datetime as dt
import os
import uuid

from pyspark.sql import Row
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.functions import expressions as X
from orderflow.functions.quantiles import exact_quantiles
from orderflow.operators import cdc as CDC
from orderflow.operators import history as H
from orderflow.operators import inventory as INV
from orderflow.operators import state as ST
from orderflow.session import scratch_path
from orderflow.streaming import sinks as SK

T0 = dt.datetime(2024, 1, 1)


def test_q11_snapshot_rows_sharing_an_lsn_are_kept(spark):
    rows = [Row(order_id="A", source_table="order_line_items", op="r", ts=T0, lsn=9,
                before=None, after={"line_id": "L1"}),
            Row(order_id="A", source_table="order_line_items", op="r", ts=T0, lsn=9,
                before=None, after={"line_id": "L2"})]
    df = spark.createDataFrame(rows, S.CHANGE_EVENT)
    assert CDC.dedup_lsn(df).count() == 2
    assert CDC.dedup_lsn(df, strict=True).count() == 1


def test_q13_ship_dates_as_epoch_ms_or_iso(spark):
    df = spark.createDataFrame([("1700000000000",), ("2023-11-14 22:13:20",), ("junk",)], "t string")
    got = [r[0] for r in df.select(X.flexible_ts(F.col("t"))).collect()]
    assert got[0] == got[1] == dt.datetime(2023, 11, 14, 22, 13, 20) and got[2] is None


def test_asof_supply_is_the_total_of_live_warehouses(spark):
    def at(h):
        return T0 + dt.timedelta(days=20 * h)
    ev = spark.createDataFrame(
        [("S", "W0", "u", at(1), 1, 5), ("S", "W1", "u", at(2), 2, 7), ("S", "W0", "u", at(3), 3, 2),
         ("S", "W1", "d", at(4), 4, 9), ("S", "W1", "u", at(5), 5, 1)],
        "sku string, warehouse_id string, op string, ts timestamp_ntz, seq int, available_qty int")
    ev = ev.withColumn("available_qty", F.col("available_qty").cast(S.QTY))
    ln = spark.createDataFrame([(f"L{h}", "S", at(h)) for h in range(6)] + [("X", "other", at(3))],
                               "line_id string, sku string, at timestamp_ntz")
    got = {r.line_id: (r.inv_ts, r.warehouse_count, int(r.available_qty))
           for r in INV.asof_inventory(ln, ev, F.col("at")).collect()}
    assert got == {"L0": (None, 0, 0), "L1": (at(1), 1, 5), "L2": (at(2), 2, 12),
                   "L3": (at(3), 2, 9), "L4": (at(4), 1, 2), "L5": (at(5), 2, 3),
                   "X": (None, 0, 0)}


def test_quantiles_of_split_groups_equal_percentile(spark):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("g"),
        F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(977)) / 8.0).alias("x"))
    df = df.unionByName(spark.createDataFrame([("one", 4.5), ("none", None)], df.schema))
    probs = {"p00": 0.0, "p05": 0.05, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = exact_quantiles(df, ["g"], F.col("x"), probs)
    want = df.where("x is not null").groupBy("g").agg(
        F.count("x").alias("n"), *[F.percentile("x", p).alias(k) for k, p in probs.items()])
    def rows(d):
        return {r.g: [round(v, 9) for v in r[1:]] for r in d.collect()}
    assert rows(got) == rows(want) and set(rows(got)) == {"a", "b", None, "one"}


def test_a_null_status_is_a_stage_of_its_own(spark):
    rows = [Row(order_id="A", source_table="orders", op="u", ts=T0 + dt.timedelta(hours=2 * i),
                lsn=i + 1, before=None, after={"order_status": v} if v != "-" else {"channel": "x"})
            for i, v in enumerate(["CREATED", "ALLOCATED", "-", None, "ALLOCATED"])]
    hist = H.status_history(spark.createDataFrame(rows, S.CHANGE_EVENT))
    got = [(r.seq_no, r.prev_status, r.status) for r in hist.orderBy("seq_no").collect()]
    assert got == [(1, "CREATED", "ALLOCATED"), (2, "ALLOCATED", None), (3, None, "ALLOCATED")]
    line = [(r.seq_no, r.status, r.seconds_in_stage)
            for r in H.status_timeline(hist).orderBy("seq_no").collect()]
    assert line == [(1, "ALLOCATED", 14400.0), (2, None, 7200.0), (3, "ALLOCATED", None)]


def test_q16_row_level_delete_by_default_whole_sku_optional(spark):
    ev = spark.createDataFrame(
        [("S1", "WH-0", "u", T0, 1), ("S1", "WH-1", "u", T0, 2), ("S1", "WH-0", "d", T0, 3)],
        "sku string, warehouse_id string, op string, ts timestamp_ntz, n int")
    ev = ev.select("sku", "warehouse_id", "op", "ts", F.struct("ts", "n").alias("seq"),
                   *[F.lit(1).cast(S.QTY).alias(c)
                     for c in ("available_qty", "allocated_qty", "on_order_qty")])
    assert sorted(r["warehouse_id"] for r in INV.inventory_position(ev).collect()) == ["WH-1"]
    assert INV.inventory_position(ev, whole_sku=True).count() == 0


def test_q2_expected_ship_date_is_folded(spark):
    rows = [Row(order_id="A", source_table="orders", op="c", ts=T0, lsn=1, before=None,
                after={"expected_ship_date": "2024-02-01 00:00:00"})]
    st = ST.fold_orders(spark.createDataFrame(rows, S.CHANGE_EVENT)).collect()[0]
    assert st["expected_ship_date"] == dt.datetime(2024, 2, 1)


def test_upsert_sink_is_idempotent_on_replay(spark):
    path = scratch_path(spark, f"upsert-{uuid.uuid4().hex[:8]}")
    sink = SK.upsert_sink(path, ["k"], F.col("ts"))
    read = lambda: SK.read_latest(spark, path, ["k"], F.col("ts"))
    b0 = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "k string, ts int, v string")
    b1 = spark.createDataFrame([("a", 2, "z"), ("a", 3, "w")], "k string, ts int, v string")
    sink(b0, 0)
    sink(b1, 1)
    first = sorted(read().collect())
    sink(b1, 1)                                       # replay after a restart
    assert sorted(read().collect()) == first
    assert {r["k"]: r["v"] for r in first} == {"a": "w", "b": "y"}


def test_batch_append_sink_replay_and_latest(spark):
    path = scratch_path(spark, f"append-{uuid.uuid4().hex[:8]}")
    sink = SK.batch_append_sink(path)
    sink(spark.createDataFrame([("a", 1)], "k string, v int"), 0)
    sink(spark.createDataFrame([("a", 2), ("b", 5)], "k string, v int"), 1)
    sink(spark.createDataFrame([("a", 2), ("b", 5)], "k string, v int"), 1)
    got = {r["k"]: r["v"] for r in SK.read_latest(spark, path, ["k"]).collect()}
    assert got == {"a": 2, "b": 5}
    assert os.path.isdir(os.path.join(path, "batch_id=1"))


def test_scan_carries_rows_of_a_null_key_and_null_segment(spark):
    from orderflow.functions.scan import segmented_scan
    rows = [(k, seg, i, v) for k in (None, "a") for i, (seg, v) in enumerate([(None, 7), (1, 5), (1, None), (2, None), (3, 4), (3, None)])]
    df = spark.createDataFrame(rows, "k string, seg int, i int, v int")
    last = segmented_scan(df, ["k"], F.col("seg"), ["i"], F.col("v"), "last", "r").collect()
    total = segmented_scan(df, ["k"], F.col("seg"), ["i"], F.col("v"), "sum", "r", inclusive=False).collect()
    for k in (None, "a"):
        assert [r.r for r in sorted(last, key=lambda r: r.i) if r.k == k] == [7, 5, 5, 5, 4, 4]
        assert [r.r for r in sorted(total, key=lambda r: r.i) if r.k == k] == [0, 7, 12, 12, 12, 16]
