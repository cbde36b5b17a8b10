"""Named queries: each takes ``(spark, sf_dir)`` and returns a DataFrame.

These compose the operators over the adapters of FIXTURES.md. They are the
``queries()`` registry of ``__spark_entry__`` and the bench workload.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.functions import expressions as X
from orderflow.functions.quantiles import exact_quantiles
from orderflow.operators import backlog as BL
from orderflow.operators import cdc as CDC
from orderflow.operators import fulfillment as FUL
from orderflow.operators import governance as GOV
from orderflow.operators import history as H
from orderflow.operators import inventory as INV
from orderflow.operators import merge as MRG
from orderflow.operators import orders as ORD
from orderflow.operators import search as SR
from orderflow.operators import state as ST
from orderflow.session import SMALL_SPLIT, scratch_path, small_splits, written
from orderflow.sources import adapters as A
from orderflow.sources.tables import read_serving_table
from orderflow.streaming import jobs as JOBS
from orderflow.streaming import lifecycle as LC
from orderflow.streaming import metrics as MET
from orderflow.streaming import sinks as SK
from orderflow.streaming import windows as WIN
from orderflow.streaming.sources import parquet_stream, text_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    """Register a query. Every query is defined in UTC (event times are
    timestamp_ntz; window alignment and ISO offsets assume a UTC session), so
    the wrapper pins the session time zone before the plan is analysed."""
    def deco(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


# ---------------------------------------------------------------------------
# backlog windows
# ---------------------------------------------------------------------------

def _event_records(spark, sf_dir) -> DataFrame:
    cl = ST.order_changelog(A.change_stream(spark, sf_dir))
    return BL.backlog_records(cl, A.as_of_col(A.EVENTS_AS_OF))


@register("backlog_sliding_1h")
def backlog_sliding_1h(spark, sf_dir):
    return BL.backlog_windows(_event_records(spark, sf_dir), "1 hour", "5 minutes",
                              "sliding_1h")


@register("backlog_sliding_24h")
def backlog_sliding_24h(spark, sf_dir):
    return BL.backlog_windows(_event_records(spark, sf_dir), "24 hours", "1 hour",
                              "sliding_24h")


@register("backlog_tumbling_daily")
def backlog_tumbling_daily(spark, sf_dir):
    return BL.backlog_windows(_event_records(spark, sf_dir), "24 hours", None,
                              "tumbling_daily")


@register("backlog_tumbling_hourly")
def backlog_tumbling_hourly(spark, sf_dir):
    return BL.backlog_windows(_event_records(spark, sf_dir), "1 hour", None,
                              "tumbling_hourly")


# ---------------------------------------------------------------------------
# CDC parsing, union, dedup, snapshot
# ---------------------------------------------------------------------------


def _parsed_view(valid: DataFrame) -> DataFrame:
    img = F.coalesce(F.col("after"), F.col("before"))
    return valid.select("lsn", "order_id", "source_table", "op", "ts",
                        img["order_status"].alias("order_status"),
                        img["business_unit"].alias("business_unit"),
                        img["total_value"].alias("total_value"),
                        F.size(img).alias("image_keys"))


@register("cdc_parse_envelope")
def cdc_parse_envelope(spark, sf_dir):
    return _parsed_view(CDC.valid(CDC.parse_envelope(A.raw_envelope_lines(spark, sf_dir))))


@register("cdc_parse_unwrapped")
def cdc_parse_unwrapped(spark, sf_dir):
    return _parsed_view(CDC.valid(CDC.parse_unwrapped(A.raw_unwrapped_lines(spark, sf_dir))))


@register("cdc_row_image")
def cdc_row_image(spark, sf_dir):
    ch = ST.row_image(A.change_stream(spark, sf_dir))
    return ch.select("lsn", "op",
                     F.when(F.col("op") == "d", "before").otherwise("after").alias("image_side"),
                     F.col("row")["order_id"].alias("order_id"),
                     F.size("row").alias("image_keys"))


@register("cdc_dlq_split")
def cdc_dlq_split(spark, sf_dir):
    dlq = CDC.dead_letters(CDC.parse_envelope(A.raw_envelope_lines(spark, sf_dir)),
                           "cdc.public.orders")
    return dlq.groupBy("source_topic", "reason").agg(F.count(F.lit(1)).alias("n_rejects"))


@register("cdc_union_dedup")
def cdc_union_dedup(spark, sf_dir):
    ch = CDC.dedup_lsn(A.duplicated_change_stream(spark, sf_dir))
    return ch.select("order_id", "source_table", "op", "ts", "lsn")


def star_change_stream(spark, sf_dir) -> DataFrame:
    """Adapter A as CDC: the orders table as a snapshot (op 'r') followed by
    every lineitem row as a line upsert ('c' first sight of a line id, else 'u')."""
    o = A.read_table(spark, sf_dir, "orders")
    snap = CDC.snapshot_as_changes(
        o, "orders", F.col("o_orderkey").cast("string"), F.col("o_orderdate"),
        ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    le = A.star_line_events(spark, sf_dir)
    first = F.row_number().over(Window.partitionBy("line_id").orderBy("seq")) == 1
    lines = le.select(
        "order_id", F.lit("order_line_items").alias("source_table"),
        F.when(first, "c").otherwise("u").alias("op"),
        F.col("l_shipdate").alias("ts"), F.lit(None).cast("bigint").alias("lsn"),
        F.lit(None).cast("map<string,string>").alias("before"),
        F.create_map(F.lit("line_id"), F.col("line_id"), F.lit("sku"), F.col("sku"),
                     F.lit("product_family"), F.col("product_family"),
                     F.lit("quantity"), F.col("quantity").cast("string")).alias("after"))
    return CDC.union_changes(snap, lines)


@register("snapshot_plus_changes")
def snapshot_plus_changes(spark, sf_dir):
    ch = ST.row_image(star_change_stream(spark, sf_dir))
    return ch.groupBy("source_table", "op").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_distinct("order_id").alias("n_orders"),
        F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        F.sum(F.size("row")).alias("image_values"))


# ---------------------------------------------------------------------------
# order-state fold
# ---------------------------------------------------------------------------

def _clean_changes(spark, sf_dir) -> DataFrame:
    return CDC.dedup_lsn(A.change_stream(spark, sf_dir))


def _state_view(st: DataFrame) -> DataFrame:
    return st.select(
        "order_id", "customer_id", "customer_name", "channel", "business_unit", "currency",
        "order_status", "priority_tier", X.money_out(F.col("total_value")).alias("total_value"),
        "expected_ship_date", "product_family", "created_at", "updated_at", "event_count",
        ST.atp_by_status(F.col("order_status"), F.lit(0)).alias("atp_feasible"))


@register("order_state_fold")
def order_state_fold(spark, sf_dir):
    return _state_view(ST.fold_orders(_clean_changes(spark, sf_dir)))


STATE_AS_OF = "2024-01-15 12:00:00"


@register("order_state_as_of")
def order_state_as_of(spark, sf_dir):
    as_of = F.lit(STATE_AS_OF).cast("timestamp_ntz")
    return _state_view(ST.fold_orders(_clean_changes(spark, sf_dir), as_of=as_of))


@register("order_state_changelog")
def order_state_changelog(spark, sf_dir):
    cl = ST.order_changelog(_clean_changes(spark, sf_dir))
    return cl.select("order_id", "lsn", "op", "business_unit", "product_family",
                     "order_status", "priority_tier",
                     X.money_out(F.col("total_value")).alias("total_value"),
                     "expected_ship_date", "created_at", "updated_at")


# ---------------------------------------------------------------------------
# star-schema order state, lines, totals
# ---------------------------------------------------------------------------


@register("order_line_items_flat")
def order_line_items_flat(spark, sf_dir):
    lines = A.star_lines(spark, sf_dir)
    hdr = A.star_orders(spark, sf_dir).select("o_orderkey", "business_unit", "order_status")
    j = lines.join(hdr, lines.l_orderkey == hdr.o_orderkey, "left")
    return j.select("line_id", "order_id", "business_unit", "order_status", "sku",
                    "product_family", "description", "quantity", "unit_price",
                    F.lit(S.DEFAULT_LINE_STATUS).alias("line_status"))


@register("order_total_check")
def order_total_check(spark, sf_dir):
    st = ORD.star_order_state(spark, sf_dir)
    diff = F.col("total_value") - F.col("lines_value")
    return st.select("order_id", X.money_out(F.col("total_value")).alias("header_total"),
                     X.money_out(F.col("lines_value")).alias("lines_total"),
                     X.money_out(diff).alias("difference"),
                     F.col("total_demand").cast("double").alias("total_demand"),
                     "line_count", (diff == 0).alias("consistent"))


# ---------------------------------------------------------------------------
# status history / timeline / transitions (adapter B)
# ---------------------------------------------------------------------------

def _history(spark, sf_dir):
    return H.status_history(_clean_changes(spark, sf_dir))


@register("status_history")
def status_history(spark, sf_dir):
    return _history(spark, sf_dir).drop("lsn")


@register("status_timeline")
def status_timeline(spark, sf_dir):
    return H.status_timeline(_history(spark, sf_dir))


@register("illegal_transitions")
def illegal_transitions(spark, sf_dir):
    return H.illegal_transitions(spark, _history(spark, sf_dir))


# ---------------------------------------------------------------------------
# inventory, supply, as-of, ATP
# ---------------------------------------------------------------------------

def _qty_out(df, cols):
    return [F.col(c).cast("double").alias(c) for c in cols]


QTY_COLS = ["available_qty", "allocated_qty", "on_order_qty"]


@register("inventory_position")
def inventory_position(spark, sf_dir):
    p = INV.inventory_position(INV.inventory_events(spark, sf_dir))
    return p.select("sku", "warehouse_id", *_qty_out(p, QTY_COLS), "updated_at")


@register("inventory_deltas")
def inventory_deltas(spark, sf_dir):
    d = INV.inventory_deltas(INV.inventory_events(spark, sf_dir))
    return d.select("sku", "warehouse_id", *_qty_out(d, QTY_COLS), "n_events")


@register("supply_by_sku")
def supply_by_sku(spark, sf_dir):
    s = INV.supply_by_sku(INV.inventory_position(INV.inventory_events(spark, sf_dir)))
    return s.select("sku", "warehouse_count", *_qty_out(s, QTY_COLS), "updated_at")


@register("supply_heatmap")
def supply_heatmap(spark, sf_dir):
    """AGG-15: family x warehouse available quantity (pivot on the fixed
    warehouse list) plus the empirical 5-95 % ship-lead interval per family."""
    ev = INV.inventory_events(spark, sf_dir)
    part = A.read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("sku"), F.col("p_type").alias("product_family"))
    pos = INV.inventory_position(ev).join(part, "sku")
    whs = [f"WH-{i}" for i in range(4)]
    pv = (pos.groupBy("product_family").pivot("warehouse_id", whs)
          .agg(F.sum("available_qty")))
    pv = pv.select("product_family", *[F.coalesce(F.col(w), F.lit(0)).cast("double")
                                       .alias(w.replace("-", "_").lower()) for w in whs])
    li = A.read_table(spark, sf_dir, "lineitem")
    o = A.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    lead = (F.unix_micros(F.col("l_shipdate").cast("timestamp")) -
            F.unix_micros(F.col("o_orderdate").cast("timestamp"))) / F.lit(86400.0 * 1e6)
    lt = (li.join(o, li.l_orderkey == o.o_orderkey)
          .join(part, F.col("l_partkey").cast("string") == part.sku)
          .select("product_family", lead.alias("lead")))
    lt = exact_quantiles(lt, ["product_family"], F.col("lead"), {"p05": 0.05, "p95": 0.95})
    return pv.join(lt, "product_family", "left").select(
        *pv.columns, X.ratio(F.col("p05")).alias("lead_days_p05"),
        X.ratio(F.col("p95")).alias("lead_days_p95"))


@register("inventory_asof_orders")
def inventory_asof_orders(spark, sf_dir):
    lines = A.star_line_versions(spark, sf_dir)
    hdr = A.star_orders(spark, sf_dir).select("o_orderkey", "created_at")
    ln = lines.join(hdr, lines.l_orderkey == hdr.o_orderkey)
    r = INV.asof_inventory(ln, INV.inventory_events(spark, sf_dir), F.col("created_at"))
    return r.select("line_id", "sku", "line_ts", "inv_ts", "warehouse_count",
                    F.col("available_qty").cast("double").alias("available_qty"))


@register("enrich_broadcast")
def enrich_broadcast(spark, sf_dir):
    lines = A.star_line_versions(spark, sf_dir)
    sup = INV.supply_by_sku(INV.inventory_position(INV.inventory_events(spark, sf_dir)))
    e = INV.enrich_with_state(lines.select("line_id", "sku", "quantity"),
                              sup.select("sku", "warehouse_count", "available_qty"), "sku")
    return e.select("line_id", "sku", "quantity",
                    F.coalesce(F.col("warehouse_count"), F.lit(0)).alias("warehouse_count"),
                    F.coalesce(F.col("available_qty").cast("double"), F.lit(0.0))
                    .alias("available_qty"),
                    (F.col("quantity") <= F.coalesce(F.col("available_qty").cast("double"),
                                                     F.lit(0.0))).alias("covered"))


@register("atp_by_status")
def atp_by_status(spark, sf_dir):
    st = ORD.star_order_state(spark, sf_dir)
    return st.select("order_id", "order_status",
                     F.col("total_demand").cast("double").alias("total_demand"), "atp_feasible")


@register("atp_by_inventory")
def atp_by_inventory(spark, sf_dir):
    pos = INV.inventory_position(INV.inventory_events(spark, sf_dir))
    r = INV.atp_by_inventory(A.star_line_versions(spark, sf_dir), pos)
    return r.select("order_id", "sku_count",
                    F.col("total_demand").cast("double").alias("total_demand"),
                    F.col("total_available").cast("double").alias("total_available"),
                    "atp_pooled", "atp_per_sku")


@register("supply_demand_gap")
def supply_demand_gap(spark, sf_dir):
    """JN-4: open demand per family vs inventory position per family
    (both sides aggregated first, then a full outer join on family)."""
    st = ORD.star_order_state(spark, sf_dir).select("o_orderkey", "order_status")
    lines = A.star_lines(spark, sf_dir)
    open_lines = lines.join(st, lines.l_orderkey == st.o_orderkey).where(
        F.col("order_status").isin(*S.UNFULFILLED_STATUSES))
    demand = open_lines.groupBy("product_family").agg(
        F.sum(F.col("quantity").cast(S.QTY)).alias("demand_qty"))
    part = A.read_table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("sku"), F.col("p_type").alias("product_family"))
    pos = INV.inventory_position(INV.inventory_events(spark, sf_dir)).join(part, "sku")
    supply = pos.groupBy("product_family").agg(F.sum("available_qty").alias("available_qty"),
                                               F.sum("on_order_qty").alias("on_order_qty"))
    j = demand.join(supply, "product_family", "full_outer")
    z = F.lit(0).cast(S.QTY)
    d, a = F.coalesce(F.col("demand_qty"), z), F.coalesce(F.col("available_qty"), z)
    return j.select("product_family", d.cast("double").alias("demand_qty"),
                    a.cast("double").alias("available_qty"),
                    F.coalesce(F.col("on_order_qty"), z).cast("double").alias("on_order_qty"),
                    (d - a).cast("double").alias("gap_qty"))


# ---------------------------------------------------------------------------
# search, facets, lookups, listings, calendar trends
# ---------------------------------------------------------------------------

SEARCH = dict(q="widget", status="CREATED", date_from="1996-01-01", date_to="1998-12-31")


def _search_hits(spark, sf_dir):
    st = ORD.star_order_state(spark, sf_dir)
    return SR.filter_orders(st, A.star_lines(spark, sf_dir), **SEARCH)


@register("order_search_page")
def order_search_page(spark, sf_dir):
    p = SR.search_page(_search_hits(spark, sf_dir), page=2, size=20)
    return p.select("position", "order_id", "customer_name", "business_unit", "product_family",
                    "order_status", "priority_tier",
                    X.money_out(F.col("total_value")).alias("total_value"), "updated_at")


@register("order_search_facets")
def order_search_facets(spark, sf_dir):
    return SR.search_facets(_search_hits(spark, sf_dir))


@register("order_lookup")
def order_lookup(spark, sf_dir):
    st = ORD.star_order_state(spark, sf_dir)
    return SR.lookup(st, "7").select(
        "order_id", "customer_id", "customer_name", "channel", "business_unit",
        "product_family", "order_status", "priority_tier",
        X.money_out(F.col("total_value")).alias("total_value"), "created_at",
        "expected_ship_date", "line_count", "ship_date", "atp_feasible")


@register("orders_by_status")
def orders_by_status(spark, sf_dir):
    return SR.orders_by_status(ORD.star_order_state(spark, sf_dir), "AMERICA", "CREATED", 100)


def _trend(spark, sf_dir, unit):
    st = A.star_orders(spark, sf_dir)           # header columns only: no line is read
    return SR.calendar_histogram(st, "created_at", unit, {
        "order_count": F.count(F.lit(1)),
        "total_value": X.money_out(F.sum("total_value"))})


@register("order_trends_hour")
def order_trends_hour(spark, sf_dir):
    return _trend(spark, sf_dir, "hour")


@register("order_trends_day")
def order_trends_day(spark, sf_dir):
    return _trend(spark, sf_dir, "day")


@register("order_trends_week")
def order_trends_week(spark, sf_dir):
    return _trend(spark, sf_dir, "week")


@register("status_trends_day")
def status_trends_day(spark, sf_dir):
    h = _history(spark, sf_dir)
    return SR.calendar_histogram(h, "timestamp", "day", {
        "status_changes": F.count(F.lit(1)),
        "fulfilled": F.count_if(F.col("status").isin(*S.SHIPPED_STATUSES)),
        "cancelled": F.count_if(F.col("status") == "CANCELLED")})


@register("order_intake_rate")
def order_intake_rate(spark, sf_dir):
    st = A.star_orders(spark, sf_dir)
    daily = SR.calendar_histogram(st, "created_at", "day", {"orders": F.count(F.lit(1))})
    return SR.trailing_rate(daily, "orders", 7)


# ---------------------------------------------------------------------------
# backlog summary, detail, trend, depth, horizons, documents, reconciliation
# ---------------------------------------------------------------------------

def _metrics(spark, sf_dir):
    # both window types read the records, which a fold over all events has made, from one table
    rec = written(_event_records(spark, sf_dir).drop("order_id"), "records")
    return BL.backlog_windows(rec, "1 hour", "5 minutes", "sliding_1h").unionByName(
        BL.backlog_windows(rec, "24 hours", None, "tumbling_daily"))


@register("backlog_summary")
def backlog_summary(spark, sf_dir):
    return BL.backlog_summary(_metrics(spark, sf_dir))


@register("backlog_detail")
def backlog_detail(spark, sf_dir):
    return BL.backlog_detail(_metrics(spark, sf_dir), "North America", "Networking",
                             "D30", "sliding_1h")


@register("backlog_trend_delta")
def backlog_trend_delta(spark, sf_dir):
    daily = BL.backlog_windows(_event_records(spark, sf_dir), "24 hours", None, "tumbling_daily")
    return BL.backlog_trend_delta(daily).select(
        *BL.KEY, "window_type", "window_start", "prev_window_start",
        "unfulfilled_demand_delta", "available_supply_delta", "demand_gap_delta")


@register("backlog_depth_cube")
def backlog_depth_cube(spark, sf_dir):
    as_of = A.as_of_col(A.EVENTS_AS_OF)
    st = ST.fold_orders(_clean_changes(spark, sf_dir), as_of=as_of)
    return BL.backlog_depth_cube(st, as_of)


@register("horizon_buckets")
def horizon_buckets(spark, sf_dir):
    return BL.horizon_mix(_event_records(spark, sf_dir))


@register("backlog_documents")
def backlog_documents(spark, sf_dir):
    return BL.backlog_documents(_metrics(spark, sf_dir))


@register("backlog_reconciliation")
def backlog_reconciliation(spark, sf_dir):
    rec = _event_records(spark, sf_dir)
    panes = BL.backlog_windows(rec, "1 hour", "5 minutes", "sliding_1h")
    direct = BL.backlog_windows_direct(rec, "1 hour", "5 minutes", "sliding_1h")
    return BL.backlog_reconciliation(panes, direct)


# ---------------------------------------------------------------------------
# fulfilment, exceptions, alerts, governance, skew, upsert, late data
# ---------------------------------------------------------------------------


def _star_as_of():
    return A.as_of_col(A.STAR_AS_OF)


@register("fulfillment_daily")
def fulfillment_daily(spark, sf_dir):
    return FUL.fulfillment_daily(ORD.star_order_state(spark, sf_dir), _star_as_of())


@register("cycle_time_histogram")
def cycle_time_histogram(spark, sf_dir):
    return FUL.cycle_time_histogram(ORD.star_order_state(spark, sf_dir))


@register("exception_queue")
def exception_queue(spark, sf_dir):
    return FUL.exception_queue(ORD.star_order_state(spark, sf_dir), _star_as_of())


@register("threshold_alerts")
def threshold_alerts(spark, sf_dir):
    m = FUL.unit_metrics(ORD.star_order_state(spark, sf_dir), _star_as_of())
    return FUL.threshold_alerts(spark, m)


@register("bu_scoped_orders")
def bu_scoped_orders(spark, sf_dir):
    st = ORD.star_order_state(spark, sf_dir)
    s = GOV.scope_to_user(st, GOV.entitlements(spark), "ops_emea")
    return s.select("order_id", "business_unit", "order_status",
                    X.money_out(F.col("total_value")).alias("total_value"))


@register("retention_active_orders")
def retention_active_orders(spark, sf_dir):
    st = ORD.star_order_state(spark, sf_dir)
    r = GOV.retention(st, "updated_at", _star_as_of(), S.RETENTION_DAYS["order_state"])
    return r.select("order_id", "updated_at", "order_status",
                    X.ratio(FUL._days_between(_star_as_of(), F.col("updated_at")))
                    .alias("age_days"))


@register("dashboard_labels")
def dashboard_labels(spark, sf_dir):
    return GOV.dashboard_labels(ORD.star_order_state(spark, sf_dir))


@register("hot_keys_salted_totals")
def hot_keys_salted_totals(spark, sf_dir):
    ev = A.read_table(spark, sf_dir, "events")
    return GOV.salted_totals(ev, "event_type", X.money(F.col("value")), "user_id")


UPSERT_SPLIT = "2024-01-30 00:00:00"


@register("upsert_latest_orders")
def upsert_latest_orders(spark, sf_dir):
    """Stored snapshot (events before the split) upserted with the state of
    the orders touched after it, which keeps what their earlier events set;
    listing eligibility as in the bu/status table."""
    ch = _clean_changes(spark, sf_dir)
    split = F.lit(UPSERT_SPLIT).cast("timestamp_ntz")
    base = ST.fold_orders(ch.where(F.col("ts") < split)).withColumn("source", F.lit("base"))
    touched = ch.where(F.col("ts") >= split).select("order_id").distinct()
    delta = (ST.fold_orders(ch.join(touched, "order_id", "left_semi"))
             .withColumn("source", F.lit("delta")))
    m = MRG.upsert_merge(base, delta, ["order_id"])
    return m.select("order_id", "source", "business_unit", "product_family", "order_status",
                    X.money_out(F.col("total_value")).alias("total_value"), "created_at",
                    "updated_at", ((F.col("business_unit") != "") & (F.col("order_status") != ""))
                    .alias("listed"))


def _arrivals(spark, sf_dir):
    r = A.event_rows(spark, sf_dir)
    return r.select("lsn", "order_id", "ts", "business_unit",
                    (F.col("ts") + F.make_dt_interval(secs=(F.col("k") % 7) * 10))
                    .alias("arrival_ts"))


@register("late_events")
def late_events(spark, sf_dir):
    late = GOV.late_rows(_arrivals(spark, sf_dir), "ts", "arrival_ts", "lsn", 30)
    return late.select("lsn", "order_id", "ts", "arrival_ts", "watermark", "lateness_seconds")


@register("pipeline_latency")
def pipeline_latency(spark, sf_dir):
    a = _arrivals(spark, sf_dir)
    lat = (F.unix_micros(F.col("arrival_ts").cast("timestamp")) -
           F.unix_micros(F.col("ts").cast("timestamp"))) / F.lit(1e6)
    return GOV.latency_percentiles(a, "business_unit", lat)


@register("order_documents")
def order_documents(spark, sf_dir):
    """PRJ-12: search documents (ISO timestamps, shipment object flattened)."""
    st = ORD.star_order_state(spark, sf_dir)
    carrier = X.pick(S.CARRIERS, F.col("o_orderkey") % 4)
    return st.select(
        "order_id", "customer_id", "customer_name", "channel", "business_unit",
        "product_family", "order_status", "priority_tier",
        X.money_out(F.col("total_value")).alias("total_value"), "currency", "atp_feasible",
        SR.iso("created_at").alias("created_at"), SR.iso("updated_at").alias("updated_at"),
        SR.iso("expected_ship_date").alias("expected_ship_date"), "line_count",
        F.when(F.col("ship_date").isNotNull(), carrier).alias("shipment_carrier"),
        F.when(F.col("ship_date").isNotNull(), F.lit("SHIPPED")).alias("shipment_status"),
        SR.iso("ship_date").alias("shipment_ship_date"))


@register("order_storage_rows")
def order_storage_rows(spark, sf_dir):
    """PRJ-10/11: storage rows with a nested child as JSON text, and the round
    trip back to its fields. Children are stored at line grain, one row a
    line (an order without lines has one row without), so no order's lines
    are ever gathered into one value, whatever their number."""
    items = A.star_lines(spark, sf_dir).select("order_id", "line_id", F.to_json(F.struct(
        "line_id", "sku", "product_family", "description", "quantity", "unit_price",
        F.lit(S.DEFAULT_LINE_STATUS).alias("line_status"))).alias("line_item"))
    st = ORD.star_order_state(spark, sf_dir).join(items, "order_id", "left")
    back = F.from_json("line_item", "line_id string, quantity double")
    return st.select("order_id", "line_id", "business_unit", "order_status",
                     X.money_out(F.col("total_value")).alias("total_value"), "line_item",
                     back["line_id"].alias("parsed_line_id"),
                     back["quantity"].alias("parsed_quantity"))


# ---------------------------------------------------------------------------
# streaming runs (file streams driven to completion with availableNow)
# ---------------------------------------------------------------------------


def _run_dir(spark, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:10]}")


def _write_raw(spark, sf_dir, root) -> str:
    path = os.path.join(root, "raw")
    A.raw_envelope_lines(spark, sf_dir, duplicates=True).select("value").write.text(path)
    return path


def _run_fold(spark, sf_dir, root) -> str:
    raw = _write_raw(spark, sf_dir, root)
    out = os.path.join(root, "enriched")
    q, q_dlq = JOBS.start_order_state_job(spark, raw, out, os.path.join(root, "dlq"),
                                          os.path.join(root, "ckpt"))
    q.awaitTermination()
    q_dlq.awaitTermination()
    return out


@register("stream_dedup")
def stream_dedup(spark, sf_dir):
    root = _run_dir(spark, "stream-dedup")
    raw = _write_raw(spark, sf_dir, root)
    out = os.path.join(root, "out")
    d = JOBS.dedup_stream(CDC.valid(CDC.parse_envelope(text_stream(spark, raw))))
    q = (d.writeStream.format("parquet").option("checkpointLocation",
                                                os.path.join(root, "ckpt"))
         .trigger(availableNow=True).start(out))
    q.awaitTermination()
    return _parsed_view(spark.read.parquet(out))


@register("stream_order_state")
def stream_order_state(spark, sf_dir):
    out = _run_fold(spark, sf_dir, _run_dir(spark, "stream-fold"))
    cl = spark.read.schema(JOBS.enriched_schema()).parquet(out)
    return cl.select("order_id", "lsn", "op", "business_unit", "product_family",
                     "order_status", "priority_tier", "total_value",
                     "expected_ship_date", "created_at", "updated_at")


#: micro-batches of the out-of-order runs, and files in each
STREAM_PARTS, STREAM_FILES = 4, 2


@register("stream_order_state_out_of_order")
def stream_order_state_out_of_order(spark, sf_dir):
    """STR-4/STR-5 over four micro-batches in no order of time, a tenth of the
    rows delivered again in a later one; each order's last version is the
    state that the batch fold finds."""
    root = _run_dir(spark, "stream-shuffled")
    raw = os.path.join(root, "raw")
    lines = A.raw_envelope_lines(spark, sf_dir, duplicates=True).select("value")
    n = STREAM_PARTS * STREAM_FILES
    mix = F.xxhash64("value")
    file = F.pmod(mix, F.lit(n))
    again = (F.pmod(mix, F.lit(10)) == 0) & (file + STREAM_FILES < n)
    lines = lines.withColumn("file", F.explode(F.when(again, F.array(file, file + STREAM_FILES)).otherwise(F.array(file))))
    lines.repartitionByRange(n, "file").select("value").write.text(raw)
    out = os.path.join(root, "enriched")
    runs = JOBS.start_order_state_job(spark, raw, out, os.path.join(root, "dlq"),
                                      os.path.join(root, "ckpt"), max_files=STREAM_FILES)
    for q in runs:
        q.awaitTermination()
    cl = spark.read.schema(JOBS.enriched_schema()).parquet(out)
    newest = Window.partitionBy("order_id").orderBy(F.desc("version"))
    cl = cl.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    return cl.select("order_id", "business_unit", "product_family", "order_status",
                     "priority_tier", "total_value", "expected_ship_date", "created_at",
                     "updated_at")


def _run_backlog(spark, sf_dir, root) -> str:
    enriched = _run_fold(spark, sf_dir, root)
    metrics = os.path.join(root, "metrics")
    q = JOBS.start_backlog_job(spark, enriched, metrics, os.path.join(root, "ckpt-backlog"),
                               A.as_of_col(A.EVENTS_AS_OF))
    q.awaitTermination()
    return metrics


@register("stream_backlog_windows")
def stream_backlog_windows(spark, sf_dir):
    metrics = _run_backlog(spark, sf_dir, _run_dir(spark, "stream-backlog"))
    return SK.read_latest(spark, metrics, JOBS.WINDOW_KEY)


@register("stream_dashboard_push")
def stream_dashboard_push(spark, sf_dir):
    root = _run_dir(spark, "stream-dashboard")
    metrics = _run_backlog(spark, sf_dir, root)
    schema = spark.read.parquet(metrics).schema
    summary = os.path.join(root, "summary")
    q = JOBS.start_dashboard_job(spark, metrics, summary, os.path.join(root, "ckpt-dash"),
                                 schema)
    q.awaitTermination()
    s = spark.read.parquet(summary)
    last = s.agg(F.max("batch_id").alias("batch_id"))
    return s.join(last, "batch_id").drop("batch_id", "_batch")


# ---------------------------------------------------------------------------
# full fold (header + children) over the star schema as a change stream
# ---------------------------------------------------------------------------

def _kv(**cols):
    out = []
    for k, c in cols.items():
        out += [F.lit(k), c.cast("string")]
    return F.create_map(*out)


def _seq(ts, *tie):
    names = ["partkey", "suppkey", "quantity", "extendedprice", "discount", "tax",
             "returnflag", "linestatus", "linenumber"]
    types = ["bigint", "bigint", "double", "double", "double", "double", "string", "string",
             "int"]
    vals = list(tie) + [None] * (len(names) - len(tie))
    return F.struct(ts.cast("timestamp_ntz").alias("ts"),
                    *[(F.lit(None) if v is None else v).cast(t).alias(n)
                      for v, n, t in zip(vals, names, types)])


HEADER_FIELDS = ["customer_id", "customer_name", "channel", "business_unit", "order_status",
                 "priority_tier", "total_value", "currency", "expected_ship_date"]


def _star_headers(spark, sf_dir) -> DataFrame:
    """Header snapshot rows: key, position and fields."""
    hdr = A.star_orders(spark, sf_dir)
    return hdr.select("order_id", _seq(F.col("created_at")).alias("seq"), F.struct(*HEADER_FIELDS).alias("head"))


def _header_image(head: Column) -> Column:
    """The row image of a header, behind any exchange: its names and texts are not sent along."""
    return _kv(order_id=F.col("order_id"), **{f: head[f] for f in HEADER_FIELDS})


def _star_line_rows(spark, sf_dir) -> DataFrame:
    """Each lineitem row of an order once, with its part and its position in the
    total order, which holds the row's own columns; partitioned by order id."""
    li = A.read_table(spark, sf_dir, "lineitem")
    p = A.read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    o = A.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("order_id"), "o_orderstatus")
    seq = _seq(F.col("l_shipdate"), F.col("l_partkey"), F.col("l_suppkey"),
               F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount"),
               F.col("l_tax"), F.col("l_returnflag"), F.col("l_linestatus"),
               F.col("l_linenumber"))
    lx = li.join(p, li.l_partkey == p.p_partkey, "left").select(
        F.col("l_orderkey").cast("string").alias("order_id"), seq.alias("seq"), "p_name", "p_type")
    return lx.join(o, "order_id")


def _star_children() -> Column:
    """The changes of one row of ``_star_line_rows``, by table name: always a
    line, an allocation and a shipment by status."""
    at = F.col("seq")
    line_id = F.concat_ws("-", "order_id", at["linenumber"].cast("string"))

    def child(table, image):
        return F.struct(F.lit(table).alias("source_table"), image.alias("after"))

    lines = child("order_line_items", _kv(
        line_id=line_id, sku=at["partkey"], product_family=F.col("p_type"),
        description=F.col("p_name"), quantity=at["quantity"],
        unit_price=at["extendedprice"] / at["quantity"]))
    allocs = child("allocation_records", _kv(
        allocation_id=line_id, sku=at["partkey"],
        warehouse_id=A.warehouse_of(at["suppkey"]), allocated_qty=at["quantity"]))
    ships = child("shipments", _kv(
        shipment_id=F.concat(F.lit("SHP-"), F.col("order_id")),
        carrier=X.pick(S.CARRIERS, F.col("order_id").cast("bigint") % 4), status=F.lit("SHIPPED"),
        ship_date=at["ts"]))
    return F.array_compact(F.array(
        F.when(at["linestatus"] == "F", allocs), lines, F.when(F.col("o_orderstatus") == "F", ships)))


def _star_parts(spark, sf_dir) -> list[DataFrame]:
    """Header changes and child changes of ``star_domain_changes``."""
    h = _star_headers(spark, sf_dir).select(
        "order_id", F.lit("orders").alias("source_table"), F.lit("r").alias("op"),
        _header_image(F.col("head")).alias("after"), "seq")
    kids = (_star_line_rows(spark, sf_dir).withColumn("kid", F.explode(_star_children()))
            .select("order_id", "kid.source_table", F.lit("u").alias("op"), "kid.after", "seq"))
    none = F.lit(None)
    return [d.select(
        "order_id", "source_table", "op", F.col("seq.ts").alias("ts"), none.cast("bigint").alias("lsn"),
        none.cast("map<string,string>").alias("before"), "after", "seq") for d in (h, kids)]


def star_domain_changes(spark, sf_dir) -> DataFrame:
    """Adapter A as a multi-table CDC stream in the order domain: header
    snapshot rows, then line, allocation and shipment upserts taken from
    lineitem, each with its position in the total order (``seq``). Lineitem
    is read and joined once for its three tables."""
    return CDC.union_changes(*_star_parts(spark, sf_dir))


@register("star_cdc_fold")
def star_cdc_fold(spark, sf_dir):
    st = ST.state_of(*_star_parts(spark, sf_dir))
    return st.select(
        "order_id", "business_unit", "order_status", "priority_tier",
        X.money_out(F.col("total_value")).alias("total_value"), "product_family",
        "line_count", F.col("total_demand").cast("double").alias("total_demand"),
        "allocation_count", F.col("shipment.ship_date").alias("ship_date"),
        F.col("shipment.status").alias("shipment_status"), "atp_feasible",
        "created_at", "updated_at")


@register("star_cdc_lines")
def star_cdc_lines(spark, sf_dir):
    """ST-2: folded line rows of the change stream, defaults applied."""
    r = ST.child_rows(star_domain_changes(spark, sf_dir), "order_line_items")
    return r.select("order_id", "line_id", "sku", "product_family", "description",
                    F.col("quantity").cast("double").alias("quantity"),
                    "unit_price", "line_status")


@register("star_cdc_allocations")
def star_cdc_allocations(spark, sf_dir):
    """ST-3: folded allocation rows of the change stream, defaults applied."""
    r = ST.child_rows(star_domain_changes(spark, sf_dir), "allocation_records")
    return r.select("order_id", "allocation_id", "sku", "warehouse_id",
                    F.col("allocated_qty").cast("double").alias("allocated_qty"), "status")


# ---------------------------------------------------------------------------
# audit log, serving tables with partition pruning, point-in-time export
# ---------------------------------------------------------------------------

@register("pipeline_event_log")
def pipeline_event_log(spark, sf_dir):
    """SNK-8: normalised CDC rows as audit records (payload = row image JSON),
    restricted to the 7-day retention window before ``as_of`` (FLT-9)."""
    ch = ST.row_image(A.change_stream(spark, sf_dir))
    log = ch.select("order_id", F.col("ts").alias("event_ts"),
                    F.concat_ws(".", "source_table", "op").alias("event_type"),
                    F.col("lsn").alias("source_lsn"), F.to_json("row").alias("payload"))
    return GOV.retention(log, "event_ts", A.as_of_col(A.EVENTS_AS_OF),
                         S.RETENTION_DAYS["pipeline_event_log"])


@register("serving_orders_by_status")
def serving_orders_by_status(spark, sf_dir):
    """SNK-11 + SNK-3 + SRC-5: export the point-in-time order state as a
    serving table partitioned like its key ((bu, status) directories), then
    answer the listing query from it — the equality filters prune
    directories before any file is opened."""
    root = _run_dir(spark, "serving")
    st = ST.fold_orders(_clean_changes(spark, sf_dir), as_of=A.as_of_col(A.EVENTS_AS_OF))
    listing = st.where((F.col("business_unit") != "") & (F.col("order_status") != ""))
    path = os.path.join(root, "orders_by_bu_status")
    (listing.select("business_unit", "order_status", "updated_at", "order_id",
                    "customer_name", "product_family", "priority_tier",
                    X.money_out(F.col("total_value")).alias("total_value"))
     # few files a directory, but a large directory is split by size over tasks
     .hint("rebalance", F.col("business_unit"), F.col("order_status"))
     .write.partitionBy("business_unit", "order_status").parquet(path))
    df = read_serving_table(spark, path, business_unit="EMEA", order_status="SHIPPED")
    return (df.select("order_id", "order_status", "updated_at", "customer_name",
                      "product_family", "priority_tier", "total_value")
            .orderBy(F.desc("updated_at"), F.asc("order_id")).limit(100))


@register("stream_inventory_position")
def stream_inventory_position(spark, sf_dir):
    """Inventory change events streamed in four micro-batches in no order of
    time, folded into the position table; equals the batch position."""
    root = _run_dir(spark, "stream-inventory")
    ev = INV.inventory_events(spark, sf_dir)
    src = os.path.join(root, "events")
    # files dealt by a hash, without regard to time
    (ev.repartition(STREAM_PARTS * STREAM_FILES, F.xxhash64("sku", "warehouse_id", "ts"))
     .write.option("parquet.block.size", str(SMALL_SPLIT)).parquet(src))
    state = os.path.join(root, "state")
    with small_splits(spark):
        q = JOBS.start_inventory_state_job(spark, src, state, os.path.join(root, "ckpt"),
                                           ev.schema, max_files=STREAM_FILES)
        q.awaitTermination()
    p = JOBS.inventory_at(spark, state)
    return p.select("sku", "warehouse_id", *_qty_out(p, QTY_COLS), F.col("ts").alias("updated_at"))


@register("stream_order_documents")
def stream_order_documents(spark, sf_dir):
    """Enriched stream -> search documents upserted by order id (SNK-6);
    the final index holds each order's latest state."""
    root = _run_dir(spark, "stream-docs")
    enriched = _run_fold(spark, sf_dir, root)
    docs = os.path.join(root, "docs")
    q = JOBS.start_index_sync_job(spark, enriched, docs, os.path.join(root, "ckpt-docs"))
    q.awaitTermination()
    return SK.read_latest(spark, docs, ["order_id"], F.col("_seq")).drop("_seq")


@register("orders_by_status_as_coded")
def orders_by_status_as_coded(spark, sf_dir):
    """LIM-2 over the insert-only listing (Q10, ``current=False``)."""
    listing = SR.status_listing_as_coded(ST.order_changelog(_clean_changes(spark, sf_dir)))
    return SR.orders_by_status(listing, "EMEA", "SHIPPED", 100)


@register("backlog_summary_filtered")
def backlog_summary_filtered(spark, sf_dir):
    """FLT-5 + Q7 parameters: one business unit, one horizon, one window type."""
    return BL.backlog_summary(_metrics(spark, sf_dir), business_unit="North America",
                              horizon="D7", window_type="sliding_1h")


@register("order_search_terms_page")
def order_search_terms_page(spark, sf_dir):
    """FLT-1/FLT-4: term filters on unit and family, no text query
    (match-all), first page of 50 by recency."""
    st = ORD.star_order_state(spark, sf_dir)
    hits = SR.filter_orders(st, business_unit="ASIA", product_family="PROMO")
    p = SR.search_page(hits, page=1, size=50)
    return p.select("position", "order_id", "customer_name", "business_unit", "product_family",
                    "order_status", "priority_tier",
                    X.money_out(F.col("total_value")).alias("total_value"), "updated_at")


@register("order_trends_day_unit")
def order_trends_day_unit(spark, sf_dir):
    """AGG-6 restricted to one business unit (the trends endpoint's filter)."""
    st = SR.filter_orders(A.star_orders(spark, sf_dir), business_unit="EUROPE")
    return SR.calendar_histogram(st, "created_at", "day", {
        "order_count": F.count(F.lit(1)),
        "total_value": X.money_out(F.sum("total_value"))})


@register("supply_for_sku")
def supply_for_sku(spark, sf_dir):
    """LIM-7 as the endpoint asks it: every warehouse row of one SKU."""
    p = INV.inventory_position(INV.inventory_events(spark, sf_dir, sku="42"))
    return p.select("sku", "warehouse_id", *_qty_out(p, QTY_COLS), "updated_at")


# ---------------------------------------------------------------------------
# the whole order state on a stream: four topics, out of order, redelivered
# ---------------------------------------------------------------------------

TOPIC_PARTS = 3


def _star_events(spark, sf_dir) -> DataFrame:
    """The four tables' changes as they come from their topics: each row image
    with its order id, and a log position, the rank in the order's total order.
    Ranks are sums over an order's lineitem rows, which become their changes
    and images only behind that sum."""
    none = F.lit(None)
    h = _star_headers(spark, sf_dir).withColumn("n", F.lit(1))
    rows = _star_line_rows(spark, sf_dir)
    n = 1 + F.when(F.col("seq.linestatus") == "F", 1).otherwise(0) + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    u = h.unionByName(rows.withColumn("n", n), allowMissingColumns=True)
    # an order's header is alone with its position: it has no line number
    before = Window.partitionBy("order_id").orderBy("seq", F.col("head").isNotNull().asc()).rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("at", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint"))
    head = F.array(F.struct(F.lit("orders").alias("source_table"), _header_image(F.col("head")).alias("after")))
    u = u.select("order_id", "seq", "at", F.posexplode(F.when(F.col("head").isNotNull(), head).otherwise(_star_children())))
    image = F.when(F.col("col.source_table") == "orders", F.col("col.after")).otherwise(
        F.map_concat(F.create_map(F.lit("order_id"), F.col("order_id")), "col.after"))
    return u.select(
        "order_id", F.col("col.source_table").alias("source_table"),
        F.when(F.col("col.source_table") == "orders", "r").otherwise("u").alias("op"), F.col("seq.ts").alias("ts"),
        none.cast("map<string,string>").alias("before"), image.alias("after"), (F.col("at") + F.col("pos") + 1).alias("lsn"))


def _topics(root: str, names=S.TOPICS) -> dict[str, str]:
    return {t: os.path.join(root, f"topic={t}") for t in names}


def _pages(spark, sf_dir) -> int:
    """Pages of state for the orders of the star schema."""
    return max(1, A.read_table(spark, sf_dir, "orders").count() // LC.PAGE_ORDERS)


def _lifecycle(spark, sf_dir, name: str, changes: DataFrame, names=S.TOPICS, **options) -> str:
    root = _run_dir(spark, name)
    A.write_topics(changes, os.path.join(root, "raw"), TOPIC_PARTS, STREAM_FILES)
    q = JOBS.start_lifecycle_job(
        spark, _topics(os.path.join(root, "raw"), names), os.path.join(root, "state"),
        os.path.join(root, "ckpt"), os.path.join(root, "listing"), max_files=STREAM_FILES, **options)
    q.awaitTermination()
    return root


#: (application, data folder) -> tables of a finished lifecycle run; the queries below read them
_RUNS: dict[tuple[str, str], str] = {}


def _star_run(spark, sf_dir) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS[key] = _lifecycle(spark, sf_dir, "stream-lifecycle", _star_events(spark, sf_dir), pages=_pages(spark, sf_dir))
    return _RUNS[key]


def _star_state(st: DataFrame) -> DataFrame:
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return st.select(
        "order_id", "business_unit", "order_status", "priority_tier",
        F.round("total_value", 2).alias("total_value"), "product_family", "line_count",
        "total_demand", "allocation_count", ntz("shipment.ship_date").alias("ship_date"),
        F.col("shipment.status").alias("shipment_status"), "atp_feasible",
        ntz("created_at").alias("created_at"), ntz("updated_at").alias("updated_at"))


@register("stream_order_state_full")
def stream_order_state_full(spark, sf_dir):
    """ST-1..ST-9 on a stream: each order's newest state row."""
    return _star_state(LC.order_table(spark, os.path.join(_star_run(spark, sf_dir), "state")))


@register("stream_lines")
def stream_lines(spark, sf_dir):
    """ST-2 on a stream: each line's newest row."""
    return LC.child_table(spark, os.path.join(_star_run(spark, sf_dir), "state"), "line")


@register("stream_allocations")
def stream_allocations(spark, sf_dir):
    """ST-3 on a stream: each allocation's newest row."""
    return LC.child_table(spark, os.path.join(_star_run(spark, sf_dir), "state"), "allocation")


@register("stream_order_listing")
def stream_order_listing(spark, sf_dir):
    """SNK-3 by the stream: the (bu, status) directories it wrote, with the
    rows that are still an order's newest."""
    root = _star_run(spark, sf_dir)
    listing = SK.read_batches(spark, os.path.join(root, "listing"))
    newest = LC.order_table(spark, os.path.join(root, "state")).select("order_id", "version")
    return listing.join(newest, ["order_id", "version"], "left_semi").select(
        "business_unit", "order_status", "order_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        "customer_name", "product_family", "priority_tier", F.round("total_value", 2).alias("total_value"))


@register("stream_order_documents_full")
def stream_order_documents_full(spark, sf_dir):
    """PRJ-12 on the stream: search documents with line totals and shipment."""
    st = LC.order_table(spark, os.path.join(_star_run(spark, sf_dir), "state"))
    iso = lambda c: X.ts_to_iso(F.col(c))
    return st.where(F.coalesce("order_id", F.lit("")) != "").select(
        "order_id", "customer_id", "customer_name", "channel", "business_unit", "product_family",
        "order_status", "priority_tier", F.round("total_value", 2).alias("total_value"), "currency",
        "atp_feasible", iso("created_at").alias("created_at"), iso("updated_at").alias("updated_at"),
        iso("expected_ship_date").alias("expected_ship_date"), "line_count",
        F.col("shipment.carrier").alias("shipment_carrier"), F.col("shipment.status").alias("shipment_status"),
        iso("shipment.ship_date").alias("shipment_ship_date"))


@register("stream_status_history")
def stream_status_history(spark, sf_dir):
    """ST-5 on a stream: header events of adapter B out of order and
    redelivered; entries that a late event took back are gone."""
    root = _lifecycle(spark, sf_dir, "stream-history", A.change_stream(spark, sf_dir), ["orders"])
    return LC.history_table(spark, os.path.join(root, "state")).drop("lsn")


class StoppedBetweenCommits(RuntimeError):
    """Raised by ``stream_order_state_recovered`` in place of a lost driver."""


@register("stream_order_state_recovered")
def stream_order_state_recovered(spark, sf_dir):
    """STR-8: the run ends after a batch's state and rows are written and
    before Spark commits the batch, then starts again on its checkpoint."""
    root = _run_dir(spark, "stream-recovery")
    A.write_topics(_star_events(spark, sf_dir), os.path.join(root, "raw"), TOPIC_PARTS, STREAM_FILES)

    def stop(batch_id: int) -> None:
        if batch_id == 1:
            raise StoppedBetweenCommits

    for after_write in (stop, None):
        q = JOBS.start_lifecycle_job(
            spark, _topics(os.path.join(root, "raw")), os.path.join(root, "state"),
            os.path.join(root, "ckpt"), max_files=STREAM_FILES, after_write=after_write, pages=_pages(spark, sf_dir))
        try:
            q.awaitTermination()
        except StreamingQueryException as e:
            if "StoppedBetweenCommits" not in str(e):
                raise
    return _star_state(LC.order_table(spark, os.path.join(root, "state")))


@register("stream_handover_state")
def stream_handover_state(spark, sf_dir):
    """SRC-4 + ST-11: state seeded from the batch fold of a snapshot, the
    stream from an earlier position on (the overlap counts once), and the
    state then read from the checkpoint."""
    ch = written(_star_events(spark, sf_dir), "star-events")
    snapshot, tail = ch.where(F.col("lsn") <= 4), ch.where(F.col("lsn") >= 3)
    root = _lifecycle(spark, sf_dir, "stream-handover", tail, initial_state=LC.seed_rows(snapshot),
                      pages=_pages(spark, sf_dir))
    return _star_state(LC.state_orders(spark, os.path.join(root, "ckpt")))


@register("stream_table_windows")
def stream_table_windows(spark, sf_dir):
    """SET-1/STR-1: events per table and 30 days over four united topics with
    their own watermarks; windows close by the slowest topic."""
    root = _run_dir(spark, "stream-topics")
    A.write_topics(_star_events(spark, sf_dir), os.path.join(root, "raw"), 1, STREAM_FILES, again=1 << 20)
    out = os.path.join(root, "out")
    JOBS.start_table_windows_job(spark, _topics(os.path.join(root, "raw")), out,
                                 os.path.join(root, "ckpt")).awaitTermination()
    return SK.read_batches(spark, out).drop("_batch", SK.BATCH)


@register("stream_topic_routing")
def stream_topic_routing(spark, sf_dir):
    """SRC-3: all topics through one subscription, routed by topic."""
    root = _run_dir(spark, "stream-routing")
    A.write_topics(_star_events(spark, sf_dir), os.path.join(root, "raw"), 1, STREAM_FILES, again=1 << 20)
    out = os.path.join(root, "out")
    JOBS.start_topic_router_job(spark, os.path.join(root, "raw"), out, os.path.join(root, "ckpt")).awaitTermination()
    return (SK.read_batches(spark, out).where("reject_reason is null").groupBy("topic")
            .agg(F.count(F.lit(1)).alias("events"), F.countDistinct("order_id").alias("orders")))


@register("stream_order_supply")
def stream_order_supply(spark, sf_dir):
    """JN-1/STR-6: three rounds of inventory changes and order lines; each line
    row carries the version of the position table it saw."""
    root = _run_dir(spark, "stream-supply")
    at = lambda *p: os.path.join(root, *p)
    ev = INV.inventory_events(spark, sf_dir)
    lines = A.read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_orderkey").cast("string").alias("order_id"),
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("line_id"),
        F.col("l_partkey").cast("string").alias("sku"), F.col("l_quantity").cast(S.QTY).alias("quantity"))
    for k in range(TOPIC_PARTS):
        (ev.where(F.col("seq.l_orderkey") % TOPIC_PARTS == k).write.mode("append")
         .option("parquet.block.size", str(SMALL_SPLIT)).parquet(at("events")))
        with small_splits(spark):
            JOBS.start_inventory_state_job(spark, at("events"), at("position"), at("ckpt-position"), ev.schema,
                                           max_files=None).awaitTermination()
        lines.where(F.col("l_orderkey") % TOPIC_PARTS == k).drop("l_orderkey").write.mode("append").parquet(at("lines"))
        JOBS.start_order_supply_job(spark, at("lines"), lines.drop("l_orderkey").schema, at("position"), at("ckpt-position"),
                                    at("out"), at("ckpt-lines")).awaitTermination()
    rows = SK.read_batches(spark, at("out", "rows"))
    return rows.select("order_id", "line_id", "sku", F.col("quantity").cast("double").alias("quantity"),
                       F.col("available_qty").cast("double").alias("available_qty"), "position_version", "atp_feasible")


# ---------------------------------------------------------------------------
# windows of several sizes from one pass, late rows beside them
# ---------------------------------------------------------------------------

def _window_run(spark, sf_dir, name: str, files: int) -> str:
    """Backlog records dealt over ``files`` micro-batches without regard to time."""
    root = _run_dir(spark, name)
    src = os.path.join(root, "records")
    rec = _event_records(spark, sf_dir)
    rec.repartition(files, F.xxhash64("order_id", "ts")).write.parquet(src)
    stream = parquet_stream(spark, src, rec.schema, 1 if files > 1 else None)
    q = JOBS.start_windows_job(spark, stream, os.path.join(root, "rows"), os.path.join(root, "metrics"),
                               os.path.join(root, "ckpt"))
    q.awaitTermination()
    return root


@register("stream_windows_multi")
def stream_windows_multi(spark, sf_dir):
    """STR-2/3/3b: sliding 1 h, sliding 24 h and daily windows from one query."""
    root = _window_run(spark, sf_dir, "stream-windows", 1)
    return SK.read_batches(spark, os.path.join(root, "metrics")).drop("_batch", SK.BATCH, "json")


def _stream_against_batch(spark, root: str, sf_dir: str, window_type: str, size: str, slide: str | None) -> DataFrame:
    """Full outer join of a window run with the batch windows, and the late sums."""
    key = [*BL.KEY, "window_start"]
    stream = SK.read_batches(spark, os.path.join(root, "metrics")).where(F.col("window_type") == window_type)
    late = WIN.finish(WIN.late_sums(WIN.read_late(spark, os.path.join(root, "rows")))).where(F.col("window_type") == window_type)
    meas = ["unfulfilled_demand", "available_supply", "order_count"]
    part = lambda d, p: d.select(*key, *[F.col(m).alias(f"{p}_{m}") for m in meas])
    batch = BL.backlog_windows(_event_records(spark, sf_dir), size, slide, window_type)
    # windows still open at the end of the stream have no row there yet
    j = part(batch, "b").join(part(stream, "s"), key, "full").join(part(late, "l"), key, "full")
    zero = {f"{p}_{m}": 0.0 for p in "bsl" for m in meas[:2]} | {f"{p}_{meas[2]}": 0 for p in "bsl"}
    return j.na.fill(zero)


@register("stream_late_side_output")
def stream_late_side_output(spark, sf_dir):
    """STR-7/SNK-10: four micro-batches in no order of time; window sums and
    the sums of the late rows, which together are the batch's."""
    j = _stream_against_batch(spark, _window_run(spark, sf_dir, "stream-late", STREAM_PARTS), sf_dir, "tumbling_daily", "24 hours", None)
    both = lambda m: F.round(F.col(f"s_{m}") + F.col(f"l_{m}"), 2)
    closed = j.where("s_order_count + l_order_count > 0 or s_available_supply + l_available_supply > 0")
    return closed.select(*BL.KEY, "window_start", both("unfulfilled_demand").alias("unfulfilled_demand"),
                         both("available_supply").alias("available_supply"),
                         (F.col("s_order_count") + F.col("l_order_count")).alias("order_count"))


@register("stream_batch_reconciliation")
def stream_batch_reconciliation(spark, sf_dir):
    """JN-8: the stream's hourly windows against the batch's after settling;
    a deviation is the exact sum of the late rows, so nothing is unexplained."""
    j = _stream_against_batch(spark, _window_run(spark, sf_dir, "stream-reconcile", STREAM_PARTS), sf_dir, "sliding_1h", "1 hour", "5 minutes")
    closed = j.where("s_order_count + l_order_count > 0 or s_available_supply + l_available_supply > 0")
    rest = lambda m: F.round(F.col(f"b_{m}") - F.col(f"s_{m}") - F.col(f"l_{m}"), 2)
    return closed.select(*BL.KEY, "window_start", F.round("b_available_supply", 2).alias("batch_supply"),
                         rest("unfulfilled_demand").alias("unexplained_demand"),
                         rest("available_supply").alias("unexplained_supply"),
                         (F.col("b_order_count") - F.col("s_order_count") - F.col("l_order_count")).alias("unexplained_count"))


@register("stream_fold_metrics")
def stream_fold_metrics(spark, sf_dir):
    """AGG-14 live: the metrics a listener stored, by batch, of a fold in four
    micro-batches; their rows are the rows the fold wrote."""
    root = _run_dir(spark, "stream-metrics")
    raw = os.path.join(root, "raw")
    (A.raw_envelope_lines(spark, sf_dir, duplicates=True)
     .repartition(STREAM_PARTS, F.xxhash64("value")).select("value").write.text(raw))
    heard = MET.ObservedMetrics(spark, os.path.join(root, "observed"), "fold")
    spark.streams.addListener(heard)
    try:
        q, dlq = JOBS.start_order_state_job(spark, raw, os.path.join(root, "out"), os.path.join(root, "dlq"),
                                            os.path.join(root, "ckpt"), max_files=1)
        heard.follow(q)
        q.awaitTermination()
        dlq.awaitTermination()
        heard.ended.wait(60)
    finally:
        spark.streams.removeListener(heard)
    m = MET.read_metrics(spark, os.path.join(root, "observed"), "rows bigint")
    written = spark.read.parquet(os.path.join(root, "out")).agg(F.count(F.lit(1)).alias("rows_written"))
    return m.agg(F.sum("observed.rows").alias("events"), F.count(F.lit(1)).alias("batches")).crossJoin(written)


# ---------------------------------------------------------------------------
# adapter B with line demand: ATP is false in some rows
# ---------------------------------------------------------------------------

def _demand_changes(spark, sf_dir) -> DataFrame:
    return CDC.dedup_lsn(CDC.union_changes(A.change_stream(spark, sf_dir), A.line_demand_changes(spark, sf_dir)))


@register("order_state_demand")
def order_state_demand(spark, sf_dir):
    """JN-3: folded state with the demand of the order's current lines and ATP as coded."""
    st = ST.order_state(_demand_changes(spark, sf_dir))
    return st.select("order_id", "order_status", "line_count", F.col("total_demand").cast("double").alias("total_demand"),
                     "atp_feasible", "created_at", "updated_at")


@register("backlog_supply_1h")
def backlog_supply_1h(spark, sf_dir):
    """AGG-1 over states with demand: supply counts only the orders that are feasible."""
    cl = ST.order_changelog(_demand_changes(spark, sf_dir))
    rec = BL.backlog_records(cl, A.as_of_col(A.EVENTS_AS_OF))
    return BL.backlog_windows(rec, S.SLIDING_SIZE, S.SLIDING_SLIDE, "sliding_1h")
