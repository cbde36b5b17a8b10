"""Stand-in inputs built from the driver's tables (see FIXTURES.md §2).

Adapter A maps the star schema onto the order domain (orders, line items,
allocations, shipments, inventory). Adapter B maps ``events`` onto a CDC
change stream of ``orders`` header events. Both are lazy DataFrames whose
work grows with the input tables.

Fixed-size lookups (region 5 rows, nation 25 rows) are broadcast; tables that
grow with the data (customer, part, lineitem) are joined without hints so the
planner and AQE decide from measured sizes.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.functions import expressions as X
from orderflow.session import unsorted_writes
from orderflow.sources.tables import read_table

# FIXED VALUES: the clocks at which each adapter is evaluated.
STAR_AS_OF = dt.datetime(2001, 8, 1)
EVENTS_AS_OF = dt.datetime(2024, 1, 31)
#: where the line events' log positions begin
LINE_LSN = 1_000_000_000_000


def as_of_col(value: dt.datetime) -> Column:
    return F.lit(value).cast("timestamp_ntz")


# ---------------------------------------------------------------------------
# Adapter B: events -> change stream
# ---------------------------------------------------------------------------

def _event_k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed event columns of adapter B, one row per event (no map yet)."""
    ev = read_table(spark, sf_dir, "events")
    # First event per user -> op 'c'. Partial aggregation keeps the min-per-user
    # table at one row per user; AQE broadcasts it only if it measures small.
    first = ev.groupBy("user_id").agg(F.min("event_id").alias("_first_id"))
    k = _event_k(F.col("props"))
    out = (ev.join(first, "user_id")
           .select(
               F.col("user_id").cast("string").alias("order_id"),
               F.lit("orders").alias("source_table"),
               F.when(F.col("event_id") % 97 == 0, "d")
                .when(F.col("event_id") == F.col("_first_id"), "c")
                .otherwise("u").alias("op"),
               F.col("ts"),
               F.col("event_id").alias("lsn"),
               F.col("event_id"),
               k.alias("k"),
               X.event_status(F.col("event_type")).alias("order_status"),
               X.pick(S.BUSINESS_UNITS, F.col("user_id") % 4).alias("business_unit"),
               X.pick(S.PRODUCT_FAMILIES, F.col("event_id") % 6).alias("product_family"),
               (k % 5 + 1).alias("priority_tier"),
               X.money(F.col("value")).alias("total_value"),
               (F.col("ts") + F.make_dt_interval(days=k)).alias("expected_ship_date"),
           ))
    return out


def change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter B in the normalised CHANGE_EVENT shape (row image as a map).

    ``after`` omits ``business_unit`` when ``k % 10 = 0`` (missing-key rule);
    deletes carry their image in ``before``.
    """
    r = event_rows(spark, sf_dir)
    image = F.create_map(
        F.lit("order_id"), F.col("order_id"),
        F.lit("order_status"), F.col("order_status"),
        F.lit("business_unit"), F.col("business_unit"),
        F.lit("product_family"), F.col("product_family"),
        F.lit("priority_tier"), F.col("priority_tier").cast("string"),
        F.lit("total_value"), F.col("total_value").cast("string"),
        F.lit("expected_ship_date"), F.col("expected_ship_date").cast("string"),
    )
    image = F.when(F.col("k") % 10 == 0,
                   F.map_filter(image, lambda key, v: key != F.lit("business_unit"))
                   ).otherwise(image)
    return r.select(
        "order_id", "source_table", "op", "ts", "lsn",
        F.when(F.col("op") == "d", image).alias("before"),
        F.when(F.col("op") != "d", image).alias("after"),
    )


# ---------------------------------------------------------------------------
# Adapter A: star schema -> order domain
# ---------------------------------------------------------------------------

def star_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order headers: orders x customer x nation x region."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment",
                                                      "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    geo = F.broadcast(n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                      .select("n_nationkey", "r_name"))
    tier = F.substring("o_orderpriority", 1, 1).cast("int")
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
            .join(geo, F.col("c_nationkey") == F.col("n_nationkey"), "left")
            .select(
                F.col("o_orderkey").cast("string").alias("order_id"),
                F.col("o_orderkey"),
                F.col("o_custkey").cast("string").alias("customer_id"),
                F.col("c_name").alias("customer_name"),
                F.col("c_mktsegment").alias("channel"),
                F.col("r_name").alias("business_unit"),
                X.star_status(F.col("o_orderstatus")).alias("order_status"),
                tier.alias("priority_tier"),
                X.money(F.col("o_totalprice")).alias("total_value"),
                F.lit(S.DEFAULT_CURRENCY).alias("currency"),
                F.col("o_orderdate").alias("created_at"),
                (F.col("o_orderdate") + F.make_dt_interval(days=tier * 30))
                .alias("expected_ship_date"),
            ))


def _line_order() -> list[Column]:
    """Total order of lineitem rows within one (l_orderkey, l_linenumber)."""
    return [F.col(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity",
                               "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
                               "l_linestatus", "l_linenumber")]


def star_line_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every lineitem row as a line-item upsert, with its position in the
    total order (``seq`` struct) — repeats of a line id are later writes."""
    li = read_table(spark, sf_dir, "lineitem")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    return (li.join(p, li.l_partkey == p.p_partkey, "left")
            .select(
                F.col("l_orderkey").cast("string").alias("order_id"),
                F.col("l_orderkey"),
                F.concat_ws("-", F.col("l_orderkey").cast("string"),
                            F.col("l_linenumber").cast("string")).alias("line_id"),
                F.col("l_partkey").cast("string").alias("sku"),
                F.col("p_type").alias("product_family"),
                F.col("p_name").alias("description"),
                F.col("l_quantity").alias("quantity"),
                (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
                F.col("l_suppkey"),
                F.col("l_returnflag"), F.col("l_linestatus"), F.col("l_shipdate"),
                F.struct(*_line_order()).alias("seq"),
            ))


def star_line_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current line items without descriptive columns: last write per
    (l_orderkey, l_linenumber) by the total order (WIN-1 via ``max_by``).
    The reduction runs on the narrow, numeric-keyed lineitem columns (a
    filter on ``l_orderkey`` reaches the scan). ``first_partkey`` is the part
    of the first row in the total order (the order's family, ST-7)."""
    li = read_table(spark, sf_dir, "lineitem")
    seq = F.struct(*_line_order())
    # the position holds every column of the row, so the latest one is the row
    vals = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag",
            "l_linestatus", "l_shipdate"]
    latest = (li.groupBy("l_orderkey", "l_linenumber")
              .agg(F.max(seq).alias("v"), F.min(seq).alias("first_seq"))
              .select("l_orderkey", "l_linenumber", *[F.col(f"v.{c}").alias(c) for c in vals], "first_seq",
                      F.col("first_seq.l_partkey").alias("first_partkey")))
    return latest.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"),
                    F.col("l_linenumber").cast("string")).alias("line_id"),
        F.col("l_orderkey").cast("string").alias("order_id"),
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_partkey").cast("string").alias("sku"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate", "first_seq",
        "first_partkey")


def star_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current line items with their part's family and description, joined
    to the surviving versions only (not to every lineitem row)."""
    v = star_line_versions(spark, sf_dir)
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    j = v.join(p, v.l_partkey == p.p_partkey, "left")
    return j.select("line_id", "order_id", "l_orderkey", "l_linenumber", "sku",
                    F.col("p_type").alias("product_family"), F.col("p_name").alias("description"),
                    "quantity", "unit_price", "l_suppkey", "l_returnflag", "l_linestatus",
                    "l_shipdate", "first_seq", "first_partkey")


def warehouse_of(suppkey: Column) -> Column:
    return F.concat(F.lit("WH-"), (suppkey % 4).cast("string"))



# ---------------------------------------------------------------------------
# Adapter B on the wire: raw JSON lines (both CDC shapes), duplicates, lateness
# ---------------------------------------------------------------------------

def _envelope_json(r: DataFrame, op: Column, with_ts: bool = True) -> Column:
    fields = [op.alias("op"), F.col("source_table").alias("__table")]
    if with_ts:
        fields.append(X.ts_to_ms(F.col("ts")).alias("ts_ms"))
    fields += [F.col("lsn"), F.col("before"), F.col("after")]
    return F.to_json(F.struct(*fields))


def raw_envelope_lines(spark: SparkSession, sf_dir: str,
                       duplicates: bool = False) -> DataFrame:
    """Envelope JSON per change event; rows with ``k = 13`` are corrupted for
    the dead-letter path (truncated text, bad op, or missing ``ts_ms`` by
    ``event_id % 3``)."""
    ch = duplicated_change_stream(spark, sf_dir) if duplicates else change_stream(spark, sf_dir)
    k = event_rows(spark, sf_dir).select("lsn", "k")
    r = ch.join(k, "lsn")
    good = _envelope_json(r, F.col("op"))
    bad_op = _envelope_json(r, F.lit("x"))
    no_ts = _envelope_json(r, F.col("op"), with_ts=False)
    kind = F.col("lsn") % 3
    value = (F.when(F.col("k") != 13, good)
             .when(kind == 0, F.substring(good, 1, 25))
             .when(kind == 1, bad_op).otherwise(no_ts))
    return r.select(F.col("lsn").alias("event_id"), value.alias("value"))


def raw_unwrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unwrapped (flattened) JSON per change event: image columns plus
    ``__op, __table, __lsn, __source_ts_ms``, ``__deleted`` on deletes and a
    static ``pipeline_source``."""
    ch = change_stream(spark, sf_dir)
    image = F.coalesce(F.col("after"), F.col("before"))
    meta = F.create_map(
        F.lit("__op"), F.col("op"), F.lit("__table"), F.col("source_table"),
        F.lit("__lsn"), F.col("lsn").cast("string"),
        F.lit("__source_ts_ms"), X.ts_to_ms(F.col("ts")).cast("string"),
        F.lit("__deleted"), F.when(F.col("op") == "d", "true").otherwise("false"),
        F.lit("pipeline_source"), F.lit(S.PIPELINE_SOURCE))
    return ch.select(F.col("lsn").alias("event_id"),
                     F.to_json(F.map_concat(image, meta)).alias("value"))


def line_demand_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line upserts beside adapter B's header events: every event with ``k % 3
    = 0`` writes line ``k % 5`` of its order with quantity ``k % 4``, at the
    event's time and a log position after all header events."""
    r = event_rows(spark, sf_dir).where(F.col("k") % 3 == 0)
    image = F.create_map(
        F.lit("order_id"), F.col("order_id"),
        F.lit("line_id"), F.concat_ws("-", "order_id", (F.col("k") % 5).cast("string")),
        F.lit("quantity"), (F.col("k") % 4).cast("string"))
    return r.select(
        "order_id", F.lit("order_line_items").alias("source_table"), F.lit("u").alias("op"), "ts",
        (F.col("lsn") + LINE_LSN).alias("lsn"),
        F.lit(None).cast("map<string,string>").alias("before"), image.alias("after"))


def duplicated_change_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change stream with every ``event_id % 50 = 0`` row delivered twice."""
    ch = change_stream(spark, sf_dir)
    return ch.unionByName(ch.where(F.col("lsn") % 50 == 0))


def write_topics(changes: DataFrame, root: str, parts: int, files: int = 2, again: int = 10) -> None:
    """Changes as envelope JSON lines, one directory per table topic, dealt
    without regard to time over ``parts`` groups of ``files`` files; a row in
    ``again`` is delivered once more, in the next group. One pass over the input.
    Files are compressed. A single group is one micro-batch whatever its files,
    so its rows stay where they are."""
    rows = changes.select(F.col("source_table").alias("topic"), _envelope_json(changes, F.col("op")).alias("value"))
    mix = F.pmod(F.xxhash64("value"), F.lit(parts * again * files))
    part = F.pmod(mix, F.lit(parts))
    twice = (F.floor(mix / parts) % again == 0) & (part + 1 < parts)
    rows = rows.withColumn("part", F.explode(F.when(twice, F.array(part, part + 1)).otherwise(F.array(part))))
    if parts == 1:
        with unsorted_writes(rows.sparkSession):
            rows.write.partitionBy("topic", "part").option("compression", "gzip").text(root)
        return
    rows = rows.withColumn("file", F.pmod(F.xxhash64("value", F.lit(1)), F.lit(files)))
    (rows.repartition("topic", "part", "file").select("topic", "part", "value")
     .write.partitionBy("topic", "part").option("compression", "gzip").text(root))
