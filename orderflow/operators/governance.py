"""Row scoping, retention, display labels, skew-safe totals, late data and
latency (FLT-8/9, PRJ-15, STR-7, STR-11, AGG-14, SNK-10)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.functions import expressions as X
from orderflow.functions.quantiles import exact_quantiles
from orderflow.functions.scan import segmented_scan

# FIXED VALUES: example entitlements (user -> business unit) for row scoping
ENTITLEMENTS = [
    ("ops_emea", "EUROPE"), ("ops_emea", "MIDDLE EAST"), ("ops_emea", "AFRICA"),
    ("ops_amer", "AMERICA"), ("ops_apac", "ASIA"),
]


def entitlements(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENTITLEMENTS, "user string, business_unit string")


def scope_to_user(df: DataFrame, grants: DataFrame, user: str) -> DataFrame:
    """FLT-8: keep rows of the user's business units (left-semi join; the
    grant list of one user is small and broadcast)."""
    mine = F.broadcast(grants.where(F.col("user") == user).select("business_unit"))
    return df.join(mine, "business_unit", "left_semi")


def retention(df: DataFrame, ts_col: str, as_of: Column, days: int) -> DataFrame:
    """FLT-9: TTL as a filter — rows newer than ``as_of - days``."""
    return df.where(F.col(ts_col) >= as_of - F.make_dt_interval(days=F.lit(days)))


def dashboard_labels(state: DataFrame) -> DataFrame:
    """PRJ-15: priority label, high-priority flag (tier <= 2), value in $K."""
    return state.select(
        "order_id", "priority_tier", X.priority_label(F.col("priority_tier")).alias("priority_label"),
        (F.col("priority_tier") <= 2).alias("high_priority"),
        F.round(F.col("total_value") / F.lit(1000), 0).cast("bigint").alias("value_k"),
        F.col("order_status"))


def hot_keys(df: DataFrame, key: str, share: float = S.HOT_KEY_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of all rows. At most ``1 / share``
    keys can qualify, so the result has a proven size bound (20 rows at 5 %)
    and may be broadcast. The total is a scalar subquery, not a collect."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.select(F.sum("_n")).scalar()
    return counts.where(F.col("_n") > F.lit(share) * total).select(key, F.lit(True).alias("_hot"))


def salted_totals(df: DataFrame, key: str, sum_col: Column, distinct_col: str,
                  salts: int = 32, share: float = S.HOT_KEY_SHARE) -> DataFrame:
    """STR-11: per-key count, sum and exact distinct count where hot keys are
    split over ``salts`` sub-keys by a hash of the distinct column — every
    distinct value lands in exactly one sub-key, so phase-2 sums of phase-1
    distinct counts are exact. Results equal the unsalted aggregation."""
    hot = F.broadcast(hot_keys(df, key, share))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(F.col(distinct_col)), F.lit(salts))) \
        .otherwise(F.lit(0))
    p1 = (df.join(hot, key, "left").withColumn("_salt", salt)
          .withColumn("_hot", F.coalesce(F.col("_hot"), F.lit(False)))
          .groupBy(key, "_salt", "_hot")
          .agg(F.count(F.lit(1)).alias("n"), F.sum(sum_col).alias("s"),
               F.count_distinct(distinct_col).alias("d")))
    return p1.groupBy(key).agg(
        F.sum("n").alias("n_rows"), X.money_out(F.sum("s")).alias("total_value"),
        F.sum("d").alias("n_distinct"), F.max("_hot").alias("is_hot"))


def late_rows(df: DataFrame, ts: str, arrival: str, order_tiebreak: str,
              delay_seconds: int = 30) -> DataFrame:
    """STR-7/SNK-10: rows whose event time is behind the watermark implied by
    everything that arrived before them (running max event time - delay).

    The running max is a global prefix over arrival order; it is computed
    with a two-level segmented scan (minute segments of arrival time), so no
    single task sees the whole stream."""
    s = segmented_scan(df, [], F.date_trunc("minute", F.col(arrival)), [arrival, order_tiebreak],
                       F.col(ts), "max", "_prev_max", inclusive=False)
    wm = F.col("_prev_max") - F.make_dt_interval(secs=F.lit(delay_seconds))
    return (s.withColumn("watermark", wm).where(F.col(ts) < F.col("watermark"))
            .withColumn("lateness_seconds",
                        (F.unix_micros(F.col("watermark").cast("timestamp")) -
                         F.unix_micros(F.col(ts).cast("timestamp"))) / F.lit(1e6))
            .drop("_prev_max"))


def latency_percentiles(df: DataFrame, group: str, latency_s: Column) -> DataFrame:
    """AGG-14: P50/P95/P99 of pipeline latency per group (exact, computed
    from distributed rank counts, see ``functions.quantiles``)."""
    q = exact_quantiles(df, [group], latency_s, {"p50_s": 0.5, "p95_s": 0.95, "p99_s": 0.99})
    return q.select(group, "n", *[X.ratio(F.col(c)).alias(c) for c in ("p50_s", "p95_s",
                                                                          "p99_s")])
