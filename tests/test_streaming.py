"""Batch == stream parity over several micro-batches: backlog records are
split into time-ordered files and streamed one file per trigger; closed
windows (end <= final watermark) must equal the batch windows exactly."""

import os
import uuid

from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.operators import backlog as BL
from orderflow.operators import state as ST
from orderflow.session import scratch_path
from orderflow.sources import adapters as A
from orderflow.streaming import jobs as JOBS
from orderflow.streaming import sinks as SK


def test_stream_windows_equal_batch_over_time_ordered_batches(spark, sf):
    rec = BL.backlog_records(ST.order_changelog(A.change_stream(spark, sf)),
                             A.as_of_col(A.EVENTS_AS_OF)).drop("order_id")
    root = scratch_path(spark, f"parity-{uuid.uuid4().hex[:8]}")
    src = os.path.join(root, "records")
    bounds = ["2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-02-01"]
    for lo, hi in zip(bounds, bounds[1:]):           # one file per week, in time order
        (rec.where((F.col("ts") >= lo) & (F.col("ts") < hi)).coalesce(1)
         .write.mode("append").parquet(src))
    schema = spark.read.parquet(src).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(src)
    out = JOBS.windowed_backlog_stream(stream, S.SLIDING_SIZE, S.SLIDING_SLIDE, "sliding_1h")
    metrics = os.path.join(root, "metrics")
    q = (out.writeStream.outputMode("append").option("checkpointLocation",
                                                      os.path.join(root, "ckpt"))
         .foreachBatch(SK.batch_append_sink(metrics)).trigger(availableNow=True).start())
    q.awaitTermination()
    got = SK.read_latest(spark, metrics, JOBS.WINDOW_KEY)
    batches = spark.read.parquet(metrics).select("batch_id").distinct().count()
    assert batches >= 3                              # several micro-batches emitted windows
    max_ts = rec.agg(F.max("ts")).collect()[0][0]
    closed = F.col("window_end") <= F.lit(max_ts) - F.expr("INTERVAL 30 SECONDS")
    want = BL.backlog_windows(rec, S.SLIDING_SIZE, S.SLIDING_SLIDE, "sliding_1h").where(closed)
    cols = want.columns
    assert sorted(got.select(*cols).collect()) == sorted(want.collect())


def test_fold_job_reports_observed_metrics(spark, sf):
    from orderflow.plans import queries as Q
    root = scratch_path(spark, f"observe-{uuid.uuid4().hex[:8]}")
    raw = Q._write_raw(spark, sf, root)
    q, q_dlq = JOBS.start_order_state_job(spark, raw, os.path.join(root, "out"),
                                          os.path.join(root, "dlq"), os.path.join(root, "ckpt"))
    q.awaitTermination()
    q_dlq.awaitTermination()
    seen = [p["observedMetrics"]["fold"] for p in q.recentProgress
            if p.get("observedMetrics", {}).get("fold")]
    assert seen and sum(int(m["rows"]) for m in seen) == \
        spark.read.parquet(os.path.join(root, "out")).count()


def test_fold_with_state_ttl_matches_without(spark, sf):
    """With a 90-day TTL nothing in the 30-day fixture expires, so the
    changelog equals the TTL-free run; the event-time timeout is accepted."""
    from orderflow.plans import queries as Q
    root = scratch_path(spark, f"ttl-{uuid.uuid4().hex[:8]}")
    raw = Q._write_raw(spark, sf, root)
    outs = []
    for ttl in (None, S.RETENTION_DAYS["order_state"]):
        out = os.path.join(root, f"out-{ttl}")
        q, q_dlq = JOBS.start_order_state_job(spark, raw, out, os.path.join(root, f"dlq-{ttl}"),
                                              os.path.join(root, f"ckpt-{ttl}"), ttl_days=ttl)
        q.awaitTermination()
        q_dlq.awaitTermination()
        outs.append(sorted(spark.read.parquet(out).drop("total_value").collect()))
    assert outs[0] == outs[1]


def test_older_row_does_not_replace_a_newer_stored_one(spark):
    path = scratch_path(spark, f"upsert-{uuid.uuid4().hex[:8]}")
    sink = SK.upsert_sink(path, ["k"], F.col("ts"))
    for batch, rows in enumerate(([("a", 9), ("b", 1)], [("a", 5), ("c", 2)])):
        sink(spark.createDataFrame(rows, "k string, ts long"), batch)
        sink(spark.createDataFrame(rows, "k string, ts long"), batch)      # replay
    assert sorted(tuple(r) for r in SK.read_latest(spark, path, ["k"], F.col("ts")).collect()) == \
        [("a", 9), ("b", 1), ("c", 2)]


def test_an_unreadable_commit_log_is_an_error_not_an_empty_one(spark):
    import pytest
    ckpt = scratch_path(spark, f"marker-{uuid.uuid4().hex[:8]}")
    assert SK.committed_batch(spark, ckpt) is None
    folder = os.path.join(ckpt.replace("file:", ""), "commits")
    os.makedirs(folder)
    for name in ("0", "11"):
        with open(os.path.join(folder, name), "w") as f:
            f.write("v1\n{}")
    assert SK.committed_batch(spark, ckpt) == 11
    with open(os.path.join(folder, "no-batch"), "w") as f:
        f.write("v1")
    with pytest.raises(Exception):
        SK.committed_batch(spark, ckpt)


def test_fold_keeps_late_events_and_never_moves_back():
    import pandas as pd
    from orderflow.streaming import fold as FOLD

    class State:
        exists, hasTimedOut, value = False, False, None

        @property
        def get(self):
            return self.value

        def update(self, v):
            self.exists, self.value = True, v

    def chunk(*events):
        rows = []
        for ts, lsn, status in events:
            row = {"order_id": "o", "source_table": "orders", "op": "u", "ts": pd.Timestamp(ts, unit="s"),
                   "lsn": lsn, "is_header": True, "has_family": False, "v_family": None}
            for f in FOLD.VALUE_FIELDS:
                row[f"has_{f}"], row[f"v_{f}"] = f == "order_status", status if f == "order_status" else None
            rows.append(row)
        return pd.DataFrame(rows).astype({"lsn": "Int64"})

    state, seen = State(), []
    batches = ([chunk((100, 1, "CREATED")), chunk((300, 3, "SHIPPED"))], [chunk((200, 2, "ALLOCATED"))],
               [chunk((50, None, "DRAFT"), (400, 4, "CLOSED"))])
    for chunks in batches:
        for out in FOLD.fold_group(("o",), iter(chunks), state):
            seen += list(zip(out["order_status"], out["version"], out["created_at"].astype("int64")))
    assert [s for s, _, _ in seen] == ["CREATED", "SHIPPED", "SHIPPED", "SHIPPED", "CLOSED"]
    assert [v for _, v, _ in seen] == [1, 2, 3, 4, 5]
    assert pd.Timestamp(state.value[FOLD.STATE_FIELDS.index("created_at")]) == pd.Timestamp(50, unit="s")


def test_page_limits_are_errors(spark):
    import pytest
    from orderflow.operators import search as SR
    df = spark.createDataFrame([("o", "x")], "order_id string, updated_at string")
    for page, size in ((0, 20), (1, 0), (1, S.SEARCH_PAGE_MAX + 1)):
        with pytest.raises(ValueError):
            SR.search_page(df, page, size)
    with pytest.raises(ValueError):
        SR.orders_by_status(df, "a", "b", S.BY_STATUS_LIMIT_MAX + 1)
