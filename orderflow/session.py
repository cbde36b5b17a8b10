"""SparkSession construction and cluster-facing settings.

Everything here is configuration: the library itself never starts a server
(the UI is off), never uses a machine-local folder when the cluster names a
shared one, and relies on AQE for runtime re-planning (partition coalescing,
skew-join splitting, broadcast conversion behind a measured size).
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STORE = "spark.sql.streaming.stateStore.providerClass"
COMPRESSION = "spark.sql.streaming.stateStore.rocksdb.compression"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Session defaults every query in this package assumes.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.executorEnv.PYTHONWARNINGS": "ignore::FutureWarning",
    # Broadcast only what the planner has measured below this bound; anything
    # larger falls back to a shuffle join. Fixed-domain lookups are hinted.
    "spark.sql.autoBroadcastJoinThreshold": str(32 * 1024 * 1024),
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    # a union of streams waits for the slowest of them
    "spark.sql.streaming.multipleWatermarkPolicy": "min",
    STORE: ROCKSDB,
}


def build_session(master: str | None = None, app: str = "orderflow",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the package defaults.

    ``master`` is only for local runs; on a cluster the launcher sets it.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and lineage-cutting tables.

    The cluster names it in ``spark.checkpoint.dir``; that value always wins.
    Where it is unset, a folder under the warehouse serves, unless that is a
    folder of the driver's own machine and executors run elsewhere.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        local = spark.sparkContext.master.startswith("local") or not d.startswith(("file:", "/"))
        if not local:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: its upstream
    runs once however often the result is scanned, and a lost executor costs
    no more than a read."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application.

    Spark serves the archive from the driver's own scratch space, as it does
    for ``--py-files``; installing the package on the cluster works as well.
    The Python process that ``transformWithState`` starts beside the driver
    reads no such archive; it finds the package where the driver has it.
    """
    sc = spark.sparkContext
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if home not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([*paths, home])
    if any(name.startswith("orderflow-") for name in sc._python_includes):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(sc._temp_dir, f"orderflow-{sc.applicationId}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def unsorted_writes(spark: SparkSession, directories: int = 16) -> Iterator[None]:
    """Around a write into a few directories: a task keeps a file open in each,
    in place of sorting its rows by directory first."""
    with _setting(spark, "spark.sql.maxConcurrentOutputFileWriters", str(directories)):
        yield


#: bytes of a file that one task reads, and of a row group, where wide rows are sorted whole
SMALL_SPLIT = 16 << 20


@contextmanager
def small_splits(spark: SparkSession) -> Iterator[None]:
    """Around runs whose tasks sort what they read: the rows of a task do not
    grow with the files. A file is cut between row groups only, so its writer
    sets ``parquet.block.size`` to ``SMALL_SPLIT`` as well."""
    with _setting(spark, "spark.sql.files.maxPartitionBytes", str(SMALL_SPLIT)):
        yield


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Around wide projections: HotSpot compiles no method of more than 8000
    bytes, so Spark makes one method per expression of such a projection."""
    with _setting(spark, "spark.sql.codegen.hugeMethodLimit", "8000"):
        yield


@contextmanager
def stateful(spark: SparkSession) -> Iterator[None]:
    """Around ``start()`` of a query with keyed state: the package is shipped and
    state lives in RocksDB, on disk, whatever the session was built with.
    ``transformWithState`` runs on no other store. A query takes a copy of the
    session's settings as it starts, so they are put back at once."""
    ship_package(spark)
    with _setting(spark, STORE, ROCKSDB), _setting(spark, COMPRESSION, "zstd"), small_methods(spark):
        yield


def scratch_path(spark: SparkSession, name: str) -> str:
    """A named location under the shared checkpoint folder."""
    return os.path.join(checkpoint_root(spark), name)
