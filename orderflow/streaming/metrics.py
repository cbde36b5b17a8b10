"""AGG-14/ST-10 live: what ``observe`` sees in each micro-batch, stored by batch id."""

from __future__ import annotations

import json
import threading

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from orderflow.streaming import sinks as SK

SCHEMA = "run_id string, metric string, finished_at string, input_rows bigint, observed string"


class ObservedMetrics(StreamingQueryListener):
    """One row per batch and named observation of the queries it hears of, in
    the batch's own directory, so a batch run again replaces its row. A row
    holds what was observed as JSON; ``read_metrics`` types it."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name, self.runs, self.ended = spark, path, name, set(), threading.Event()

    def follow(self, query) -> None:
        self.runs.add(str(query.runId))

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        seen = p.get("observedMetrics", {}).get(self.name)
        if seen is None:
            return
        row = (p["runId"], self.name, p["timestamp"], p["numInputRows"], json.dumps(seen))
        SK.batch_append_sink(self.path)(self.spark.createDataFrame([row], SCHEMA), p["batchId"])

    def onQueryTerminated(self, event) -> None:
        if not self.runs or str(event.runId) in self.runs:
            self.ended.set()


def read_metrics(spark: SparkSession, path: str, observed: str):
    """The stored rows with the observation as a struct of type ``observed``."""
    return SK.read_batches(spark, path).withColumn("observed", F.from_json("observed", observed)).drop("_batch")
