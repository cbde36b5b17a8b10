"""The streaming steps in a session that the package did not build."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PLAIN = """
    import datetime as dt, os, sys
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F
    at = lambda *p: os.path.join(os.getcwd(), *p)
    spark = SparkSession.builder.master("local[2]").config(map={
        "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.sql.shuffle.partitions": "1",
        "spark.sql.session.timeZone": "UTC", "spark.checkpoint.dir": at("kept"), "spark.sql.warehouse.dir": at("tables")}).getOrCreate()
    sys.path.insert(0, ROOT)
    from orderflow import schemas as S
    from orderflow.sources import adapters as A
    from orderflow.streaming import jobs as JOBS, lifecycle as LC, sinks as SK
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(f"o{i % 3}", "orders", "u", t0 + dt.timedelta(hours=i), i, None, {"order_id": f"o{i % 3}", "order_status": f"S{i}"}) for i in range(9)]
    A.write_topics(spark.createDataFrame(rows, S.CHANGE_EVENT), at("raw"), 1)
    JOBS.start_lifecycle_job(spark, {"orders": at("raw", "topic=orders")}, at("state"), at("ckpt")).awaitTermination()
    got = sorted((r.order_id, r.order_status) for r in LC.order_table(spark, at("state")).collect())
    assert got == [("o0", "S6"), ("o1", "S7"), ("o2", "S8")], got
    rec = spark.createDataFrame(
        [("o1", "EMEA", "f", "D1", "CREATED", 5, 1, True, t0 + dt.timedelta(hours=i)) for i in range(6)],
        "order_id string, bu string, product_family string, horizon string, status string, total_value long, priority int, atp_feasible boolean, ts timestamp_ntz")
    rec.write.parquet(at("rec"))
    stream = spark.readStream.schema(rec.schema).parquet(at("rec"))
    JOBS.start_windows_job(spark, stream, at("rows"), at("metrics"), at("ckpt-w")).awaitTermination()
    assert SK.read_batches(spark, at("metrics")).where("window_type = 'sliding_1h'").count() > 0
    assert spark.conf.get(store, None) == before
    spark.stop()
    print("whole")
"""


def test_keyed_state_in_a_plain_session(tmp_path):
    """No RocksDB setting, no PYTHONPATH, another working folder."""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYTHONPATH", "SPARK", "PYSPARK"))}
    code = f"ROOT = {ROOT!r}\n" + textwrap.dedent(PLAIN)
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert r.returncode == 0 and "whole" in r.stdout, r.stderr[-3000:]
