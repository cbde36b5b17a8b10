"""Backlog metrics (PRJ-7/8, AGG-1, AGG-2/3, AGG-16, STR-2/3/3b, LIM-3, WIN-5, JN-8).

Windowed backlog is computed with *panes*: records are first pre-aggregated
into tumbling panes of ``gcd(size, slide)`` (a hash aggregate with map-side
partial aggregation), and only the pane rows — not the raw records — are
expanded to the ``size / slide`` windows that contain them. All measures are
sums and counts, so this is exact, and the expansion no longer multiplies the
input volume. The same function serves sliding and tumbling windows and
works on streaming input (the pane step is a plain grouped aggregate).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.functions import expressions as X
from orderflow.operators import state as ST

KEY = ["bu", "product_family", "horizon"]


def backlog_records(changelog: DataFrame, as_of: Column) -> DataFrame:
    """PRJ-7: enriched order state -> backlog input record.

    Event time is the state's ``updated_at`` (Q4); a state that never saw a
    header event has none, and takes ``as_of`` instead of the wall clock (Q17).
    """
    demand = F.col("total_demand") if "total_demand" in changelog.columns else F.lit(0)
    return changelog.select(
        F.col("order_id"),
        F.col("business_unit").alias("bu"),
        F.col("product_family"),
        X.classify_horizon(F.col("expected_ship_date"), as_of).alias("horizon"),
        F.col("order_status").alias("status"),
        X.money(F.col("total_value")).alias("total_value"),
        F.col("priority_tier").alias("priority"),
        ST.atp_by_status(F.col("order_status"), demand).alias("atp_feasible"),
        F.coalesce(F.col("updated_at"), as_of).alias("ts"),
    )


def _interval_us(spec: str) -> int:
    n, unit = spec.split()
    mult = {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600,
            "hours": 3600, "day": 86400, "days": 86400}[unit]
    return int(n) * mult * 1_000_000


def _measures(df: DataFrame) -> list[Column]:
    unfulfilled = F.col("status").isin(*S.UNFULFILLED_STATUSES)
    zero = F.lit(0).cast(S.MONEY)
    return [
        F.sum(F.when(unfulfilled, F.col("total_value")).otherwise(zero)).alias("demand"),
        F.sum(F.when(F.col("atp_feasible"), F.col("total_value")).otherwise(zero))
        .alias("supply"),
        F.count_if(unfulfilled).alias("cnt"),
        F.sum(F.when(unfulfilled, F.col("priority")).otherwise(0)).cast("bigint")
        .alias("prio"),
    ]


def _finish(df: DataFrame) -> list[Column]:
    cnt = F.col("cnt")
    return [
        X.money_out(F.col("demand")).alias("unfulfilled_demand"),
        X.money_out(F.col("supply")).alias("available_supply"),
        X.money_out(F.col("demand") - F.col("supply")).alias("demand_gap"),
        cnt.cast("bigint").alias("order_count"),
        F.when(cnt > 0, X.ratio(F.col("prio") / cnt)).otherwise(F.lit(0.0))
        .alias("avg_priority"),
    ]


def backlog_windows(records: DataFrame, size: str, slide: str | None = None,
                    window_type: str | None = None) -> DataFrame:
    """AGG-1 over event-time windows (sliding when ``slide < size``).

    Windows are ``[start, start + size)`` with starts on multiples of
    ``slide`` since the epoch; a window exists when any record falls in it.
    """
    slide = slide or size
    size_us, slide_us = _interval_us(size), _interval_us(slide)
    pane_us = math.gcd(size_us, slide_us)
    wtype = window_type or ("tumbling" if size_us == slide_us else "sliding") + f"_{size}"
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    panes = (records
             .withColumn("pane", us - F.pmod(us, F.lit(pane_us)))
             .groupBy(*KEY, "pane").agg(*_measures(records)))
    # window starts k*slide with pane - size < k*slide <= pane
    k_hi = F.floor(F.col("pane") / F.lit(slide_us))
    k_lo = F.floor((F.col("pane") - F.lit(size_us)) / F.lit(slide_us)) + 1
    win = (panes
           .withColumn("k", F.explode(F.sequence(k_lo, k_hi)))
           .withColumn("window_start_us", F.col("k") * F.lit(slide_us))
           .groupBy(*KEY, "window_start_us")
           .agg(F.sum("demand").alias("demand"), F.sum("supply").alias("supply"),
                F.sum("cnt").alias("cnt"), F.sum("prio").alias("prio")))
    return win.select(
        *KEY, F.lit(wtype).alias("window_type"),
        X.to_ntz(F.timestamp_micros(F.col("window_start_us"))).alias("window_start"),
        X.to_ntz(F.timestamp_micros(F.col("window_start_us") + F.lit(size_us)))
        .alias("window_end"),
        *_finish(win))


def backlog_depth_cube(state: DataFrame, as_of: Column) -> DataFrame:
    """AGG-16: backlog depth over the *current* state of each order (distinct
    orders, no double counting), for every subset of (bu, family, horizon).
    ``cube`` runs as one Expand + one hash aggregate."""
    rec = state.select(
        F.col("business_unit").alias("bu"), "product_family",
        X.classify_horizon(F.col("expected_ship_date"), as_of).alias("horizon"),
        F.col("order_status").alias("status"), "total_value",
        F.col("priority_tier").alias("priority"),
        ST.atp_by_status(F.col("order_status"),
                         F.col("total_demand") if "total_demand" in state.columns
                         else F.lit(0)).alias("atp_feasible"))
    g = rec.cube(*KEY).agg(*_measures(rec), F.grouping_id().alias("grouping_id"))
    return g.select(
        *[F.coalesce(F.col(k), F.lit("ALL")).alias(k) for k in KEY],
        F.col("grouping_id").cast("int").alias("grouping_id"), *_finish(g))


def backlog_summary(metrics: DataFrame, business_unit: str | None = None,
                    horizon: str | None = None, window_type: str | None = None,
                    top_n: int = S.SUMMARY_FAMILY_SIZE, latest_only: bool = False) -> DataFrame:
    """AGG-2 + AGG-3 in one pass: ``rollup(product_family)`` gives the family
    rows and the grand total; families ranked by record count, top ``top_n``.

    As coded, every stored window of every type is summed (Q7); pass
    ``window_type`` and/or ``latest_only`` to restrict it.
    """
    m = metrics
    if business_unit:
        m = m.where(F.col("bu") == business_unit)
    if horizon:
        m = m.where(F.col("horizon") == horizon)
    if window_type:
        m = m.where(F.col("window_type") == window_type)
    if latest_only:   # only the newest window of each key and window type
        newest = F.max("window_start").over(Window.partitionBy(*KEY, "window_type"))
        m = m.withColumn("_newest", newest).where(F.col("window_start") == F.col("_newest"))
    g = m.rollup("product_family").agg(
        F.sum(F.col("unfulfilled_demand").cast(S.MONEY)).alias("demand"),
        F.sum(F.col("available_supply").cast(S.MONEY)).alias("supply"),
        F.sum(F.col("demand_gap").cast(S.MONEY)).alias("gap"),
        F.sum("order_count").alias("orders"),
        F.count(F.lit(1)).alias("doc_count"),
        F.grouping("product_family").alias("is_total"))
    rank = F.row_number().over(
        Window.partitionBy("is_total").orderBy(F.desc("doc_count"), F.asc("product_family")))
    g = g.withColumn("rank", rank).where((F.col("is_total") == 1) | (F.col("rank") <= top_n))
    gap = F.coalesce(F.col("gap"), F.lit(0).cast(S.MONEY))
    return g.select(
        F.lit(business_unit or "ALL").alias("business_unit"),
        F.when(F.col("is_total") == 1, F.lit("ALL")).otherwise(F.col("product_family"))
        .alias("product_family"),
        X.money_out(F.coalesce(F.col("demand"), F.lit(0).cast(S.MONEY))).alias("demand"),
        X.money_out(F.coalesce(F.col("supply"), F.lit(0).cast(S.MONEY))).alias("supply"),
        X.money_out(F.coalesce(F.col("gap"), F.lit(0).cast(S.MONEY))).alias("gap"),
        F.coalesce(F.col("orders"), F.lit(0)).cast("bigint").alias("order_count"),
        F.when(gap > 0, "At Risk").otherwise("Covered").alias("status_label"))


def backlog_detail(metrics: DataFrame, business_unit: str, product_family: str,
                   horizon: str = "D30", window_type: str = "sliding_1h",
                   limit: int = S.BACKLOG_SERIES_LIMIT) -> DataFrame:
    """LIM-3: newest ``limit`` windows of one key and window type."""
    return (metrics.where((F.col("bu") == business_unit) &
                          (F.col("product_family") == product_family) &
                          (F.col("horizon") == horizon) &
                          (F.col("window_type") == window_type))
            .orderBy(F.desc("window_start")).limit(limit))


def backlog_trend_delta(metrics: DataFrame) -> DataFrame:
    """WIN-5: per key and window type, the change in demand/supply/gap from
    the previous window in the series."""
    w = Window.partitionBy(*KEY, "window_type").orderBy("window_start")
    out = metrics
    for c in ("unfulfilled_demand", "available_supply", "demand_gap"):
        prev = F.lag(F.col(c).cast(S.MONEY)).over(w)
        out = out.withColumn(f"{c}_delta",
                             X.money_out(F.col(c).cast(S.MONEY) - prev))
    return out.withColumn("prev_window_start", F.lag("window_start").over(w))


def backlog_reconciliation(left: DataFrame, right: DataFrame) -> DataFrame:
    """JN-8: full outer join of two metric sets on the metric key; relative
    differences per measure (0 when both agree, 1 when a side is missing)."""
    key = [*KEY, "window_type", "window_start"]
    meas = ["unfulfilled_demand", "available_supply", "demand_gap", "order_count"]
    l = left.select(*key, *[F.col(m).alias(f"l_{m}") for m in meas])
    r = right.select(*key, *[F.col(m).alias(f"r_{m}") for m in meas])
    j = l.join(r, key, "full_outer")
    cols = [*key]
    for m in meas:
        a, b = F.col(f"l_{m}").cast("double"), F.col(f"r_{m}").cast("double")
        diff = F.when(a.isNull() | b.isNull(), F.lit(1.0)) \
            .when(a == b, F.lit(0.0)) \
            .otherwise(F.abs(a - b) / F.greatest(F.abs(a), F.abs(b)))
        cols.append(X.ratio(diff).alias(f"{m}_rel_diff"))
    return j.select(*cols)


def backlog_windows_direct(records: DataFrame, size: str, slide: str | None = None,
                           window_type: str | None = None) -> DataFrame:
    """Reference formulation: every record expanded to all its windows by
    ``F.window`` and aggregated once (no panes). Used to reconcile the pane
    plan (JN-8); it multiplies the input by ``size / slide`` before the
    shuffle, which is why ``backlog_windows`` is the production path."""
    slide = slide or size
    wtype = window_type or f"window_{size}"
    w = F.window(F.col("ts"), size, slide)
    g = records.groupBy(*KEY, w.alias("w")).agg(*_measures(records))
    return g.select(*KEY, F.lit(wtype).alias("window_type"),
                    X.to_ntz(F.col("w.start")).alias("window_start"),
                    X.to_ntz(F.col("w.end")).alias("window_end"), *_finish(g))


def horizon_mix(records: DataFrame) -> DataFrame:
    """PRJ-8 + FLT-6: records per horizon bucket and status class."""
    cls = (F.when(F.col("status").isin(*S.UNFULFILLED_STATUSES), "unfulfilled")
           .when(F.col("status").isin(*S.SHIPPED_STATUSES), "fulfilled")
           .when(F.col("status") == "CANCELLED", "cancelled").otherwise("other"))
    return (records.groupBy("horizon", cls.alias("status_class"))
            .agg(F.count(F.lit(1)).alias("n_records"),
                 X.money_out(F.sum("total_value")).alias("total_value"),
                 F.count_if(F.col("atp_feasible")).alias("n_atp")))


def backlog_documents(metrics: DataFrame) -> DataFrame:
    """PRJ-13 + SNK-7: metric rows as search documents with the composite id
    ``bu|family|horizon|window_type|window_start``."""
    ws = F.date_format(F.col("window_start").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssxxx")
    return metrics.select(
        F.concat_ws("|", "bu", "product_family", "horizon", "window_type", ws).alias("doc_id"),
        F.col("bu").alias("business_unit"), "product_family",
        F.col("horizon").alias("horizon_bucket"), "window_type", ws.alias("window_start"),
        "unfulfilled_demand", "available_supply", "demand_gap", "order_count", "avg_priority")
