"""What the large runs write and shuffle, seen in their plans and files."""

import collections
import datetime as dt
import glob
import os
import uuid

from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.operators import state as ST
from orderflow.plans import queries as Q
from orderflow.session import scratch_path
from orderflow.sources import adapters as A
from orderflow.streaming import jobs as JOBS
from orderflow.streaming import sinks as SK


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_star_changes_read_lineitem_once(spark, sf):
    plan = _plan(Q.star_domain_changes(spark, sf))
    assert plan.count("lineitem.parquet") == 1
    got = {r.source_table: r.n for r in Q.star_domain_changes(spark, sf).groupBy("source_table").agg(F.count("*").alias("n")).collect()}
    li = A.read_table(spark, sf, "lineitem").join(A.read_table(spark, sf, "orders"), F.expr("l_orderkey = o_orderkey"))
    assert got["order_line_items"] == li.count() and got["allocation_records"] == li.where("l_linestatus = 'F'").count()
    assert got["shipments"] == li.where("o_orderstatus = 'F'").count()


def test_positions_of_star_events_are_ranks(spark, sf):
    """Each order's positions run from 1 without gaps, headers before their lines."""
    ev = Q._star_events(spark, sf).where("cast(order_id as int) < 300").select("order_id", "source_table", "op", "ts", "lsn", "after").collect()
    by = collections.defaultdict(list)
    for r in ev:
        assert r.after["order_id"] == r.order_id
        by[r.order_id].append((r.lsn, r.ts, r.source_table))
    for rows in by.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(1, len(rows) + 1))
        assert [x[1] for x in rows] == sorted(x[1] for x in rows)


def test_a_single_group_of_topics_is_written_in_place(spark):
    """compressed files, no shuffle of the JSON; the router sorts no rows by topic."""
    root = scratch_path(spark, f"group-{uuid.uuid4().hex[:8]}")
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"o{i}", t, "u", t0 + dt.timedelta(days=i), i, None, {"order_id": f"o{i}"}) for i in range(20) for t in S.TOPICS]
    ch = spark.createDataFrame(rows, S.CHANGE_EVENT).repartition(3)
    A.write_topics(ch, os.path.join(root, "raw"), 1, again=1 << 20)
    files = glob.glob(os.path.join(root.removeprefix("file:"), "raw", "topic=*", "part=*", "part-*"))
    assert len(files) == 3 * len(S.TOPICS) and all(f.endswith(".gz") for f in files)
    JOBS.start_topic_router_job(spark, os.path.join(root, "raw"), os.path.join(root, "out"), os.path.join(root, "ckpt")).awaitTermination()
    got = SK.read_batches(spark, os.path.join(root, "out")).groupBy("topic").count().collect()
    assert {r["topic"]: r["count"] for r in got} == dict.fromkeys(S.TOPICS, 20)
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_fold_of_children_carries_no_header_fields(spark, sf):
    """star_cdc_fold reads lineitem once, and orders twice (headers, the lines' status)."""
    plan = _plan(Q.QUERIES["star_cdc_fold"](spark, sf))
    assert plan.count("lineitem.parquet") == 1 and plan.count("orders.parquet") == 2


def test_orders_known_by_other_rows_only(spark):
    t0 = dt.datetime(2024, 1, 1)
    line = lambda o, i, op="u": (o, "order_line_items", op, t0, i, {"line_id": "1"} if op == "d" else None,
                                 None if op == "d" else {"line_id": "1", "quantity": "2"})
    rows = [("a", "orders", "u", t0, 1, None, {"order_id": "a"}), line("a", 2), line("b", 3), line("c", 4, "d"),
            ("d", "orders", "d", t0, 5, {"order_id": "d"}, None), (None, "orders", "u", t0, 6, None, {}), line(None, 7),
            ("e", None, "u", t0, 8, None, {})]
    st = ST.order_state(spark.createDataFrame(rows, S.CHANGE_EVENT))
    got = {r.order_id: (r.order_status, r.event_count, r.line_count, float(r.total_demand), r.created_at) for r in st.collect()}
    none = S.DEFAULT_STATUS
    assert got == {"a": (none, 2, 1, 2.0, t0), "b": (none, 1, 1, 2.0, None), "c": (none, 1, 0, 0.0, None), "d": (none, 1, 0, 0.0, None),
                   None: (none, 2, 0, 0.0, t0), "e": (none, 1, 0, 0.0, None)}


def test_asof_supply_scans_its_events_once(spark, sf):
    """what the second scan reads twice is written; only the rows of the first are sorted by position."""
    plan = _plan(Q.QUERIES["inventory_asof_orders"](spark, sf))
    assert plan.count("lineitem.parquet") == 0 and plan.count("supply-changes") >= 1
