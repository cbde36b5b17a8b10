"""Fulfilment KPIs, exceptions and alerts (AGG-11/12, FLT-10/11, LIM-4).

Definitions (the source gives none): cycle time = ship date - created, in
days, non-negative pairs only; on time = ship date <= expected ship date;
shipped = SHIPPED or DELIVERED; exception = an open order past its expected
ship date (delayed), without a status change for 7 days (stuck), or still
CREATED with lines but no allocation (allocation failed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.functions import expressions as X
from orderflow.functions.quantiles import exact_quantiles
from orderflow.operators.orders import cycle_days

STUCK_DAYS = 7

# FIXED VALUES: alert thresholds per metric (scope 'ALL' applies to every unit)
THRESHOLDS = [
    ("open_backlog_value", "ALL", 500_000_000.0),
    ("exception_rate", "ALL", 0.67),
    ("cycle_time_p95_days", "ALL", 2120.0),
    ("open_backlog_value", "EUROPE", 400_000_000.0),
]


def _days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) -
            F.unix_micros(earlier.cast("timestamp"))) / F.lit(86400.0 * 1e6)


def exception_flags(state: DataFrame, as_of: Column) -> DataFrame:
    open_ = F.col("order_status").isin(*S.UNFULFILLED_STATUSES)
    return state.select(
        "*",
        (open_ & (F.col("expected_ship_date") < as_of)).alias("is_delayed"),
        (open_ & (F.col("updated_at") < as_of - F.expr(f"INTERVAL {STUCK_DAYS} DAYS")))
        .alias("is_stuck"),
        ((F.col("order_status") == "CREATED") & (F.col("line_count") > 0) &
         (F.col("allocation_count") == 0)).alias("is_alloc_failed"))


def exception_queue(state: DataFrame, as_of: Column) -> DataFrame:
    """FLT-10: one row per (order, exception type)."""
    f = exception_flags(state, as_of)
    kinds = F.array(
        F.when(F.col("is_delayed"), F.lit("delayed")),
        F.when(F.col("is_stuck"), F.lit("stuck")),
        F.when(F.col("is_alloc_failed"), F.lit("allocation_failed")))
    return (f.select("order_id", "business_unit", "order_status", "created_at",
                     "expected_ship_date", F.explode(F.filter(kinds, lambda k: k.isNotNull()))
                     .alias("exception_type"))
            .select("order_id", "business_unit", "order_status", "exception_type",
                    X.ratio(_days_between(as_of, F.col("created_at"))).alias("days_open"),
                    F.when(F.col("exception_type") == "delayed",
                           X.ratio(_days_between(as_of, F.col("expected_ship_date"))))
                    .alias("days_late")))


def fulfillment_daily(state: DataFrame, as_of: Column,
                      days: int = S.FULFILLMENT_DAYS_LIMIT) -> DataFrame:
    """AGG-11 per (business unit, metric date) + LIM-4 newest ``days`` dates."""
    f = exception_flags(cycle_days(state), as_of)
    shipped = F.col("order_status").isin(*S.SHIPPED_STATUSES)
    on_time = F.when(shipped & F.col("ship_date").isNotNull(),
                     (F.col("ship_date") <= F.col("expected_ship_date")).cast("int"))
    f = f.withColumn("metric_date", F.to_date("created_at"))
    g = f.groupBy("business_unit", "metric_date").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.count_if(shipped).alias("shipped_orders"),
        X.ratio(F.avg(on_time)).alias("on_time_rate"),
        F.count_if(F.col("is_delayed") | F.col("is_stuck") | F.col("is_alloc_failed"))
        .alias("exception_count"))
    q = exact_quantiles(f, ["business_unit", "metric_date"], F.col("cycle_days"),
                        {"p50": 0.5, "p95": 0.95}).drop("n")
    g = g.join(q, ["business_unit", "metric_date"], "left")
    w = Window.partitionBy("business_unit").orderBy(F.desc("metric_date"))
    return (g.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= days)
            .select("business_unit", "metric_date", "on_time_rate",
                    X.ratio(F.col("p50")).alias("cycle_time_p50"),
                    X.ratio(F.col("p95")).alias("cycle_time_p95"),
                    "exception_count", "total_orders", "shipped_orders"))


def cycle_time_histogram(state: DataFrame, bin_days: int = 30) -> DataFrame:
    """AGG-12: cycle-time distribution in fixed-width day bins."""
    c = cycle_days(state).where(F.col("cycle_days").isNotNull())
    b = F.floor(F.col("cycle_days") / F.lit(float(bin_days))).cast("bigint")
    return (c.groupBy(b.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n_orders"))
            .select("bin", (F.col("bin") * bin_days).alias("bin_start_days"), "n_orders"))


def unit_metrics(state: DataFrame, as_of: Column) -> DataFrame:
    """Per business unit: open backlog value, exception rate, cycle p95."""
    f = exception_flags(cycle_days(state), as_of)
    open_ = F.col("order_status").isin(*S.UNFULFILLED_STATUSES)
    g = f.groupBy("business_unit").agg(
        F.sum(F.when(open_, F.col("total_value"))).alias("open_value"),
        F.avg((F.col("is_delayed") | F.col("is_stuck") | F.col("is_alloc_failed"))
              .cast("int")).alias("exc_rate"))
    q = exact_quantiles(f, ["business_unit"], F.col("cycle_days"), {"p95": 0.95}).drop("n")
    g = g.join(q, "business_unit", "left")
    return g.select("business_unit", F.stack(
        F.lit(3),
        F.lit("open_backlog_value"), X.money_out(F.col("open_value")),
        F.lit("exception_rate"), X.ratio(F.col("exc_rate")),
        F.lit("cycle_time_p95_days"), X.ratio(F.col("p95"))).alias("metric", "value"))


def threshold_alerts(spark: SparkSession, metrics: DataFrame) -> DataFrame:
    """FLT-11: metrics over their threshold; a unit-specific threshold
    overrides the 'ALL' one. The thresholds table is fixed and tiny, so it
    is broadcast."""
    th = F.broadcast(spark.createDataFrame(THRESHOLDS, "metric string, scope string, "
                                                       "threshold double"))
    j = metrics.join(th, (metrics.metric == th.metric) &
                     ((th.scope == metrics.business_unit) | (th.scope == "ALL")))
    pick = F.row_number().over(Window.partitionBy("business_unit", metrics.metric)
                               .orderBy(F.when(th.scope == "ALL", 1).otherwise(0)))
    j = j.select("business_unit", metrics.metric.alias("metric"), "value", "scope",
                 "threshold", pick.alias("rn"))
    return j.where((F.col("rn") == 1) & (F.col("value") > F.col("threshold"))).drop("rn")
