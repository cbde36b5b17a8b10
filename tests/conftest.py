import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderflow.session import build_session  # noqa: E402

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    extra = {}
    # tests are the one place that may pick their own checkpoint folder
    from pyspark.sql import SparkSession
    active = SparkSession.getActiveSession()
    if active is None or not active.conf.get("spark.checkpoint.dir", None):
        extra["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="orderflow-test-")
    s = build_session("local[4]", app="orderflow-tests", shuffle_partitions=4, extra=extra)
    yield s


@pytest.fixture(scope="session")
def sf():
    return SMOKE
