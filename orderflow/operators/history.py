"""Status history, lifecycle timeline and transition checks (WIN-2/3, ST-5, FLT-12).

History rows are produced in long form (one row per status change) rather
than collected into a per-order array, so no order's history is ever
gathered into a single value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.operators import state as ST
from orderflow.session import written


def status_history(changes: DataFrame, segment: str = "hour") -> DataFrame:
    """ST-5/WIN-2: an entry whenever a header event's status differs from the
    current one; the initial status is CREATED, so a first CREATED adds
    nothing. Events without the key neither add nor reset anything; a null
    status under the key is a status, as in the fold.

    The previous status and the entry number come from one scan in two levels:
    inside each (order, hour) a look back and a running count of changes, and
    over an order's hours the status and the count carried in. A hot order
    spreads over many tasks; the narrow input is written once and read twice."""
    ev = ST.prepare(changes).where(F.col("has_order_status"))
    ev = written(ev.select("order_id", "ts", "lsn", "seq", F.col("v_order_status").alias("status")), "status-events")
    # wrapped, so that a present null is a status as well
    own = F.struct(F.col("status").alias("s"))
    d = ev.withColumn("_key", F.struct("order_id", F.date_trunc(segment, F.col("ts")).alias("hour")))
    w = Window.partitionBy("_key").orderBy("seq")
    d = d.withColumn("_before", F.lag(own).over(w))
    inner = F.col("_before").isNotNull() & ~F.col("status").eqNullSafe(F.col("_before.s"))
    d = d.withColumn("_n", F.sum(inner.cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    hours = d.groupBy("_key").agg(F.min_by(own, "seq").alias("first"), F.max_by(own, "seq").alias("last"),
                                  F.max("_n").alias("n"))
    over = Window.partitionBy("_key.order_id").orderBy("_key.hour")
    came = F.lag("last").over(over)
    hours = hours.withColumn("_came", F.when(came.isNull(), F.lit(S.DEFAULT_STATUS)).otherwise(came["s"]))
    hours = hours.withColumn("_opens", (~F.col("first.s").eqNullSafe(F.col("_came"))).cast("bigint"))
    done = F.sum(F.col("_opens") + F.col("n")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    carry = hours.select("_key", "_came", (F.coalesce(done, F.lit(0)) + F.col("_opens")).alias("_base"))
    prev = F.when(F.col("_before").isNull(), F.col("_came")).otherwise(F.col("_before.s"))
    r = d.join(carry, "_key").withColumn("prev_status", prev)
    return (r.where(~F.col("status").eqNullSafe(F.col("prev_status")))
            .select("order_id", (F.col("_base") + F.col("_n")).alias("seq_no"), "status",
                    F.col("ts").alias("timestamp"), F.lit(S.HISTORY_SOURCE).alias("source"),
                    "prev_status", "lsn"))


def status_timeline(history: DataFrame) -> DataFrame:
    """WIN-3: time spent in each stage (until the next change; open stage null).

    Each entry goes to its own number and, as the end of the stage before, to
    the number before; the two meet in an aggregate on (order, number), so
    the entries of a hot order spread over many tasks."""
    own = F.struct(F.col("seq_no"), F.lit(1).alias("own"), F.col("status"),
                   F.col("timestamp").alias("entered_at"),
                   F.lit(None).cast("timestamp_ntz").alias("left_at"))
    ends = F.struct((F.col("seq_no") - 1).alias("seq_no"), F.lit(0).alias("own"),
                    F.lit(None).cast("string").alias("status"),
                    F.lit(None).cast("timestamp_ntz").alias("entered_at"),
                    F.col("timestamp").alias("left_at"))
    met = (history.select("order_id", F.explode(F.array(own, ends)).alias("e"))
           .groupBy("order_id", F.col("e.seq_no").alias("seq_no"))
           .agg(*[F.max(f"e.{c}").alias(c) for c in ("own", "status", "entered_at", "left_at")])
           .where("own = 1"))
    dur = (F.unix_micros(F.col("left_at").cast("timestamp")) -
           F.unix_micros(F.col("entered_at").cast("timestamp"))) / F.lit(1e6)
    return met.select("order_id", "seq_no", "status", "entered_at", "left_at",
                      dur.alias("seconds_in_stage"))


def legal_transitions(spark: SparkSession) -> DataFrame:
    """Fixed six-row table of allowed (from, to) pairs."""
    return spark.createDataFrame(S.LEGAL_TRANSITIONS, "from_status string, to_status string")


def illegal_transitions(spark: SparkSession, history: DataFrame) -> DataFrame:
    """FLT-12: changes whose (previous, new) pair is not a legal transition —
    a left-anti join against the fixed pairs table (broadcast: 6 rows)."""
    legal = F.broadcast(legal_transitions(spark))
    h = history.select("order_id", "seq_no", F.col("prev_status").alias("from_status"),
                       F.col("status").alias("to_status"), "timestamp")
    return h.join(legal, ["from_status", "to_status"], "left_anti")
