"""What a task of an upsert stream reads and sorts."""

import glob
import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from orderflow import session
from orderflow.plans import queries as Q
from orderflow.streaming import sinks as SK

BYTES = "spark.sql.files.maxPartitionBytes"


def test_inventory_files_are_cut_small(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "SMALL_SPLIT", 4096)
    monkeypatch.setattr(Q, "SMALL_SPLIT", 4096)
    monkeypatch.setattr(Q, "_run_dir", lambda spark, name: str(tmp_path / name))
    before, seen, start = spark.conf.get(BYTES), [], Q.JOBS.start_inventory_state_job

    def started(spark, *args, **kw):
        seen.append(spark.conf.get(BYTES))
        return start(spark, *args, **kw)
    monkeypatch.setattr(Q.JOBS, "start_inventory_state_job", started)
    assert Q.QUERIES["stream_inventory_position"](spark, sf).count() > 0
    groups = [pq.ParquetFile(f).num_row_groups for f in glob.glob(os.path.join(tmp_path, "stream-inventory", "events", "*.parquet"))]
    assert len(groups) == Q.STREAM_PARTS * Q.STREAM_FILES and min(groups) > 1
    assert seen == ["4096"] and spark.conf.get(BYTES) == before


def test_the_order_is_sorted_once(spark, tmp_path):
    path = str(tmp_path)
    sink = SK.upsert_sink(path, ["k"], F.col("seq"))
    rows = lambda *r: spark.createDataFrame(r, "k int, seq struct<a:int,b:string>, v string")
    sink(rows((1, (1, "a"), "old"), (2, (5, "a"), "new")), 0)
    sink(rows((1, (1, "b"), "new"), (2, (4, "z"), "old")), 1)
    got = SK.read_latest(spark, path, ["k"], F.col("seq"))
    assert got.columns == ["k", "seq", "v"]
    assert sorted((r.k, r.v) for r in got.collect()) == [(1, "new"), (2, "new")]
    assert " _by#" not in got._jdf.queryExecution().executedPlan().toString()
