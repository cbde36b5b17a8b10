"""How the sinks of the streams store what they keep."""

import glob
import os
import uuid

import pyarrow.parquet as pq

from orderflow.session import scratch_path
from orderflow.streaming import sinks as SK


def test_sinks_compress_what_they_keep(spark):
    path = scratch_path(spark, f"zstd-{uuid.uuid4().hex[:8]}")
    SK.batch_append_sink(path)(spark.range(100), 0)
    files = glob.glob(os.path.join(path.removeprefix("file:"), "batch_id=0", "part-*.parquet"))
    assert {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in files} == {"ZSTD"}
