"""Order-state fold (ST-1..ST-12) as pure column expressions.

The input is the normalised change stream (``schemas.CHANGE_EVENT``). Events
are ordered per order by ``seq = (ts, lsn)`` — deterministic, whatever the
arrival order across tables (Q19).

Per-field rule (PRJ-6): an ``orders`` event whose row image *has* a key
overwrites the field, even with null; a missing key keeps the current value;
nothing seen means the entity default. Null ``priority_tier`` keeps the
current value (Q20); null ``total_value`` becomes 0.

* ``fold_orders``      final state per order — one hash aggregate with
  partial (map-side) aggregation, so a hot order does not pin one task.
* ``order_changelog``  state after every accepted event (what the stream
  emits) — running ``last(.. ignorenulls)`` over the per-order event order,
  as a segmented two-level scan (skew-safe).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.functions import expressions as X
from orderflow.functions.scan import segmented_scan_multi

IMAGE = "row"

# field -> (value expression over the row image, default, extra presence test)
def _field_specs():
    img = F.col(IMAGE)
    specs = {}
    for name, (_t, default) in S.HEADER_FIELDS.items():
        specs[name] = (img[name], F.lit(default), None)
    specs["order_status"] = (img["order_status"], F.lit(S.DEFAULT_STATUS), None)
    tier = img["priority_tier"].try_cast("int")
    specs["priority_tier"] = (tier, F.lit(S.DEFAULT_PRIORITY), tier.isNotNull())
    total = F.coalesce(X.try_money(img["total_value"]), F.lit(0).cast(S.MONEY))
    specs["total_value"] = (total, F.lit(0).cast(S.MONEY), None)
    esd = X.flexible_ts(img["expected_ship_date"])
    specs["expected_ship_date"] = (esd, F.lit(None).cast("timestamp_ntz"), None)
    return specs


HEADER_OUT = ["customer_id", "customer_name", "channel", "business_unit", "currency",
              "order_status", "priority_tier", "total_value", "expected_ship_date"]


def row_image(changes: DataFrame) -> DataFrame:
    """PRJ-3: ``before`` for deletes, else ``after``; empty map if absent."""
    empty = F.create_map().cast("map<string,string>")
    return changes.withColumn(
        IMAGE, F.coalesce(F.when(F.col("op") == "d", F.col("before"))
                          .otherwise(F.col("after")), empty))


def prepare(changes: DataFrame) -> DataFrame:
    """Add ``seq``, ``is_header`` and, per header field, ``has_<f>``/``v_<f>``."""
    df = row_image(changes) if IMAGE not in changes.columns else changes
    is_header = (F.col("source_table") == "orders") & (F.col("op") != "d")
    # an explicit `seq` (a struct) overrides the default (ts, lsn) event order
    if "seq" in df.columns:
        df = df.withColumnRenamed("seq", "_seq_in")
        seq = F.col("_seq_in")
    else:
        seq = F.struct(F.col("ts"), F.col("lsn"))
    cols = [seq.alias("seq"), is_header.alias("is_header")]
    for name, (value, _default, extra) in _field_specs().items():
        has = is_header & F.map_contains_key(F.col(IMAGE), name)
        if extra is not None:
            has = has & extra
        cols += [has.alias(f"has_{name}"), value.alias(f"v_{name}")]
    fam = F.col(IMAGE)["product_family"]
    cols.append((is_header & fam.isNotNull() & (fam != "")).alias("has_family"))
    cols.append(fam.alias("v_family"))
    return df.select("*", *cols)


def fold_orders(changes: DataFrame, as_of: Column | None = None,
                keep_family_seq: bool = False) -> DataFrame:
    """Final header state per order (ST-1, ST-6, ST-7, ST-11).

    ``as_of`` folds only events with ``ts <= as_of`` (point-in-time, SNK-11).
    """
    if as_of is not None:
        changes = changes.where(F.col("ts") <= as_of)
    ev = prepare(changes)
    specs = _field_specs()
    aggs = []
    for name in HEADER_OUT:
        aggs.append(F.max_by(F.struct(F.col(f"v_{name}").alias("v")),
                             F.when(F.col(f"has_{name}"), F.col("seq"))).alias(f"s_{name}"))
    aggs += [
        F.min_by(F.col("v_family"), F.when(F.col("has_family"), F.col("seq")))
        .alias("header_family"),
        F.min(F.when(F.col("has_family"), F.col("seq"))).alias("_family_seq"),
        F.min(F.when(F.col("is_header"), F.col("ts"))).alias("created_at"),
        F.max(F.when(F.col("is_header"), F.col("ts"))).alias("updated_at"),
        F.count(F.lit(1)).alias("event_count"),
    ]
    g = ev.groupBy("order_id").agg(*aggs)
    out = [F.col("order_id")]
    for name in HEADER_OUT:
        s = F.col(f"s_{name}")
        out.append(F.when(s.isNull(), specs[name][1]).otherwise(s["v"]).alias(name))
    out += [F.coalesce(F.col("header_family"), F.lit("")).alias("product_family"),
            "created_at", "updated_at", "event_count"]
    if keep_family_seq:
        out += [F.col("header_family").alias("_h_family"), "_family_seq"]
    return g.select(*out)


def order_changelog(changes: DataFrame, segment: str = "hour") -> DataFrame:
    """State after each accepted event (ST-12): one output row per input row.

    Every field is ``last(value if key present) ignoring nulls`` over the
    order's events up to and including the current one; struct-wrapping keeps
    a present null distinct from an absent key. The running values are a
    two-level segmented scan (``functions.scan``) over ``segment`` buckets of
    event time, so an order with a huge share of all events is processed by
    many tasks, never collected into one.
    """
    ev = prepare(changes)
    specs = _field_specs()
    # running line demand (for ATP): each line upsert contributes its quantity
    # minus that line's previous quantity
    img = F.col(IMAGE)
    is_line = (F.col("source_table") == "order_line_items") & (F.col("op") != "d")
    qty = F.coalesce(F.coalesce(img["quantity"], F.lit("0")).try_cast(S.QTY),
                     F.lit(0).cast(S.QTY))
    # non-line rows get a per-timestamp key so they never pile up in one group
    ev = ev.withColumn("_line", F.when(is_line, F.concat(F.lit("L"), img["line_id"]))
                       .otherwise(F.concat(F.lit("#"), F.col("ts").cast("string"))))
    prev = F.lag(qty).over(Window.partitionBy("order_id", "_line").orderBy("seq"))
    ev = ev.withColumn("_delta", F.when(is_line, qty - F.coalesce(prev, F.lit(0).cast(S.QTY)))
                       .otherwise(F.lit(0).cast(S.QTY)))
    scan = [(f"_r_{n}", F.when(F.col(f"has_{n}"), F.struct(F.col(f"v_{n}").alias("v"))),
             "last") for n in HEADER_OUT]
    scan.append(("_demand", F.col("_delta"), "sum"))
    scan += [("_fam", F.when(F.col("has_family"), F.col("v_family")), "first"),
             ("_created", F.when(F.col("is_header"), F.col("ts")), "first"),
             ("_updated", F.when(F.col("is_header"), F.col("ts")), "last")]
    seg = F.date_trunc(segment, F.col("seq").getField("ts"))
    r = segmented_scan_multi(ev, ["order_id"], seg, ["seq"], scan)
    cols = [F.col("order_id"), F.col("source_table"), F.col("op"), F.col("ts"), F.col("lsn"),
            F.col("seq")]
    for name in HEADER_OUT:
        run = F.col(f"_r_{name}")
        cols.append(F.when(run.isNull(), specs[name][1]).otherwise(run["v"]).alias(name))
    cols += [F.coalesce(F.col("_fam"), F.lit("")).alias("product_family"),
             F.col("_created").alias("created_at"), F.col("_updated").alias("updated_at"),
             F.col("_demand").cast(S.QTY).alias("total_demand")]
    return r.select(*cols)


def atp_by_status(status: Column, total_demand: Column) -> Column:
    """JN-3 as coded: zero demand is feasible, else status in the ATP set."""
    return F.when(F.coalesce(total_demand, F.lit(0)) == 0, F.lit(True)) \
        .otherwise(status.isin(*S.ATP_STATUSES))


# ---------------------------------------------------------------------------
# children: line items, allocations, shipment (ST-2, ST-3, ST-4, ST-7)
# ---------------------------------------------------------------------------

LINE_FIELDS = {"sku": "", "product_family": "", "description": None, "quantity": "0",
               "unit_price": "0", "line_status": S.DEFAULT_LINE_STATUS}
ALLOC_FIELDS = {"sku": "", "warehouse_id": "", "allocated_qty": "0",
                "status": S.DEFAULT_ALLOCATION_STATUS}
CHILD_TABLES = ["order_line_items", "allocation_records", "shipments"]


def _child_id(img: Column, table: Column) -> Column:
    return (F.when(table == "order_line_items", img["line_id"])
            .when(table == "allocation_records", img["allocation_id"])
            .otherwise(F.lit("")))


def _child_versions(ev: DataFrame) -> DataFrame:
    """The latest row image per (order, table, child id) of the child tables —
    a whole-record replace, as the source does."""
    img = F.col(IMAGE)
    table = F.col("source_table")
    kids = ev.where(table.isin(*CHILD_TABLES) & (F.col("op") != "d"))
    return kids.groupBy("order_id", "source_table", _child_id(img, table).alias("child_id")).agg(
        F.max_by(img, F.col("seq")).alias("img"))


def _children(ev: DataFrame) -> DataFrame:
    """``fold_children`` over any rows, and their number (``events``). An order
    whose rows hold no live child is kept, with nulls. The first aggregate carries
    a position once with all that is read from its row, typed, not the image."""
    img = F.col(IMAGE)
    table = F.col("source_table")
    is_line, is_alloc, is_ship = (table == "order_line_items"), \
        (table == "allocation_records"), (table == "shipments")
    zero = F.lit(0).cast(S.QTY)
    qty = F.coalesce(F.coalesce(img["quantity"], F.lit(LINE_FIELDS["quantity"])).try_cast(S.QTY), zero)
    aqty = F.coalesce(F.coalesce(img["allocated_qty"], F.lit("0")).try_cast(S.QTY), zero)
    shipment = F.struct(
        F.coalesce(img["shipment_id"], F.lit("")).alias("shipment_id"),
        img["carrier"].alias("carrier"), img["tracking_number"].alias("tracking_number"),
        F.coalesce(img["status"], F.lit(S.DEFAULT_SHIPMENT_STATUS)).alias("status"),
        X.flexible_ts(img["ship_date"]).alias("ship_date"),
        X.flexible_ts(img["delivery_date"]).alias("delivery_date"))
    live = table.isin(*CHILD_TABLES) & (F.col("op") != "d")
    fam = F.when(is_line & (img["product_family"] != ""), img["product_family"])
    rows = ev.select(
        "order_id", "source_table", "seq", live.alias("live"), F.when(live, _child_id(img, table)).alias("child_id"),
        F.when(is_line, qty).when(is_alloc, aqty).alias("qty"), F.when(is_ship, shipment).alias("shipment"), fam.alias("fam"))
    # a child's first family and first position: one minimum each, null where there is none
    v = rows.groupBy("order_id", "source_table", "live", "child_id").agg(
        F.max(F.struct("seq", "qty", "shipment")).alias("last"),
        F.min("seq").alias("first_seq"),
        F.min(F.when(F.col("fam").isNotNull(), F.struct("seq", "fam"))).alias("fam"),
        F.count(F.lit(1)).alias("events"))
    is_line, is_alloc, is_ship = [F.col("live") & c for c in (is_line, is_alloc, is_ship)]
    return v.groupBy("order_id").agg(
        F.count_if(F.col("live")).alias("kids"), F.sum("events").alias("events"),
        F.count_if(is_line).alias("line_count"),
        F.sum(F.when(is_line, F.col("last.qty"))).alias("total_demand"),
        F.min_by(F.struct(F.col("fam.fam").alias("line_family"),
                          F.col("fam.seq").alias("line_family_seq")),
                 F.when(is_line, F.col("first_seq"))).alias("first_line"),
        F.count_if(is_alloc).alias("allocation_count"),
        F.sum(F.when(is_alloc, F.col("last.qty"))).alias("allocated_qty"),
        F.max_by(F.col("last.shipment"), F.when(is_ship, F.col("last.seq"))).alias("shipment")) \
        .select("order_id", "kids", "events", "line_count", "total_demand", "first_line.line_family",
                "first_line.line_family_seq", "allocation_count", "allocated_qty", "shipment")


def fold_children(changes: DataFrame) -> DataFrame:
    """Per-order child rollups (ST-2/3/4): line count and demand, allocation
    count and quantity, the latest shipment, and the product-family candidate
    of the first-seen line (its first version with a non-empty family).
    Two aggregations over one scan; no per-order arrays are collected."""
    ev = prepare(changes) if "seq" not in changes.columns or IMAGE not in changes.columns \
        else changes
    ev = ev.where(F.col("source_table").isin(*CHILD_TABLES) & (F.col("op") != "d"))
    return _children(ev).drop("kids", "events")


def child_rows(changes: DataFrame, table: str) -> DataFrame:
    """ST-2/ST-3: the folded rows of one child table, keyed (order_id, child
    id): the last write of each child as a whole, absent fields at their
    defaults, unreadable numbers 0. Children stay rows, never a per-order array."""
    ev = prepare(changes) if IMAGE not in changes.columns else changes
    v = _child_versions(ev.where(F.col("source_table") == table))
    if table == "order_line_items":
        name, fields, numbers = "line_id", LINE_FIELDS, {"quantity": S.QTY, "unit_price": "double"}
    elif table == "allocation_records":
        name, fields, numbers = "allocation_id", ALLOC_FIELDS, {"allocated_qty": S.QTY}
    else:
        raise ValueError(f"no child table: {table}")
    cols = [F.col("order_id"), F.coalesce("child_id", F.lit("")).alias(name)]
    for f, default in fields.items():
        c = F.coalesce(F.col("img")[f], F.lit(default))
        if f in numbers:
            c = F.coalesce(c.try_cast(numbers[f]), F.lit(0).cast(numbers[f]))
        cols.append(c.alias(f))
    return v.select(*cols)


def order_state(changes: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Full fold: header (``fold_orders``) + children (``fold_children``),
    joined on the order key; family = header candidate or first-line
    candidate, whichever came first (ST-7); ATP as coded (JN-3) on the
    folded demand."""
    if as_of is not None:
        changes = changes.where(F.col("ts") <= as_of)
    # a null order id joins nothing; its rows are all in the first part
    header = F.col("source_table").eqNullSafe(F.lit("orders")) | F.col("order_id").isNull()
    return state_of(changes.where(header), changes.where(~header))


def state_of(headers: DataFrame, others: DataFrame) -> DataFrame:
    """``order_state`` of changes that come in two parts, the header rows and
    the rows of other tables (with an order id): the many child rows carry no
    header fields. An order known only by other rows has the defaults."""
    h = fold_orders(headers, keep_family_seq=True).drop("product_family")
    c = _children(prepare(others))
    j = h.join(c, "order_id", "full")
    defaults = {name: spec[1] for name, spec in _field_specs().items()}
    missing = F.col("event_count").isNull()
    j = j.withColumns({
        "event_count": F.coalesce("event_count", F.lit(0)) + F.coalesce("events", F.lit(0)),
        **{n: F.when(missing, d).otherwise(F.col(n)) for n, d in defaults.items()}})
    use_line = F.col("line_family").isNotNull() & (
        F.col("_h_family").isNull() | (F.col("line_family_seq") < F.col("_family_seq")))
    fam = F.when(use_line, F.col("line_family")).otherwise(F.coalesce("_h_family", F.lit("")))
    demand = F.coalesce(F.col("total_demand"), F.lit(0).cast(S.QTY))
    return j.select(
        *[c for c in h.columns if not c.startswith("_")], fam.alias("product_family"),
        F.coalesce(F.col("line_count"), F.lit(0)).cast("bigint").alias("line_count"),
        demand.alias("total_demand"),
        F.coalesce(F.col("allocation_count"), F.lit(0)).cast("bigint").alias("allocation_count"),
        F.col("shipment"),
        atp_by_status(F.col("order_status"), demand).alias("atp_feasible"))
