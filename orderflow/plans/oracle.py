"""Independent DuckDB SQL for every SQL-expressible registered query.

Each statement restates its adapter (FIXTURES.md §2) in SQL over the raw
tables — nothing is exported from Spark. Money is summed as decimal(15,2)
and cast to double; ratios are rounded to 6 digits.
"""

from __future__ import annotations

# FIXED VALUES repeated in SQL form (same lists as orderflow.schemas)
BU_LIST = "['North America', 'EMEA', 'APAC', 'Latin America']"
FAMILY_LIST = "['Networking', 'Security', 'Compute', 'Storage', 'Collaboration', 'Software']"
UNFULFILLED = "('CREATED', 'ALLOCATED', 'IN_PRODUCTION')"
ATP = "('ALLOCATED', 'IN_PRODUCTION', 'SHIPPED', 'DELIVERED')"
EV_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
STAR_AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"

# Adapter B: events -> typed change rows (chg)
CHG = f"""
ev AS (
  SELECT e.*, CAST(json_extract_string(e.props, '$.k') AS INTEGER) AS k,
         min(e.event_id) OVER (PARTITION BY e.user_id) AS first_id
  FROM events e),
chg AS (
  SELECT CAST(user_id AS VARCHAR) AS order_id, 'orders' AS source_table,
         CASE WHEN event_id % 97 = 0 THEN 'd' WHEN event_id = first_id THEN 'c' ELSE 'u' END AS op,
         ts, event_id AS lsn, k,
         CASE event_type WHEN 'signup' THEN 'CREATED' WHEN 'view' THEN 'ALLOCATED'
              WHEN 'click' THEN 'IN_PRODUCTION' WHEN 'purchase' THEN 'SHIPPED'
              WHEN 'error' THEN 'CANCELLED' END AS order_status,
         ({BU_LIST})[user_id % 4 + 1] AS business_unit,
         ({FAMILY_LIST})[event_id % 6 + 1] AS product_family,
         k % 5 + 1 AS priority_tier,
         CAST(value AS DECIMAL(15,2)) AS total_value,
         ts + k * INTERVAL 1 DAY AS expected_ship_date,
         (k % 10 <> 0) AS has_bu
  FROM ev)"""

# Running state after each event (changelog of the fold) over chg
CHANGELOG = CHG + """,
cl AS (
  SELECT order_id, source_table, op, ts, lsn,
    coalesce(last(CASE WHEN op <> 'd' AND has_bu THEN business_unit END IGNORE NULLS) OVER w, '') AS business_unit,
    coalesce(first(CASE WHEN op <> 'd' THEN product_family END IGNORE NULLS) OVER w, '') AS product_family,
    coalesce(last(CASE WHEN op <> 'd' THEN order_status END IGNORE NULLS) OVER w, 'CREATED') AS order_status,
    coalesce(last(CASE WHEN op <> 'd' THEN priority_tier END IGNORE NULLS) OVER w, 3) AS priority_tier,
    coalesce(last(CASE WHEN op <> 'd' THEN total_value END IGNORE NULLS) OVER w, 0) AS total_value,
    last(CASE WHEN op <> 'd' THEN expected_ship_date END IGNORE NULLS) OVER w AS expected_ship_date,
    first(CASE WHEN op <> 'd' THEN ts END IGNORE NULLS) OVER w AS created_at,
    last(CASE WHEN op <> 'd' THEN ts END IGNORE NULLS) OVER w AS updated_at
  FROM chg
  WINDOW w AS (PARTITION BY order_id ORDER BY ts, lsn
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def horizon_sql(esd: str, as_of: str) -> str:
    d = f"((epoch_us({esd}) - epoch_us({as_of})) / 86400000000.0)"
    return (f"CASE WHEN {esd} IS NULL THEN 'D90' WHEN {d} <= 1 THEN 'D1' "
            f"WHEN {d} <= 7 THEN 'D7' WHEN {d} <= 30 THEN 'D30' ELSE 'D90' END")


# Backlog input records from the changelog (no line events: demand 0 => ATP)
RECORDS = CHANGELOG + f""",
rec AS (
  SELECT order_id, business_unit AS bu, product_family,
         {horizon_sql('expected_ship_date', EV_AS_OF)} AS horizon,
         order_status AS status, total_value, priority_tier AS priority,
         TRUE AS atp_feasible, coalesce(updated_at, {EV_AS_OF}) AS ts
  FROM cl)"""

MEASURES = f"""
  CAST(sum(CASE WHEN status IN {UNFULFILLED} THEN total_value ELSE 0 END) AS DOUBLE) AS unfulfilled_demand,
  CAST(sum(CASE WHEN atp_feasible THEN total_value ELSE 0 END) AS DOUBLE) AS available_supply,
  CAST(sum(CASE WHEN status IN {UNFULFILLED} THEN total_value ELSE 0 END)
       - sum(CASE WHEN atp_feasible THEN total_value ELSE 0 END) AS DOUBLE) AS demand_gap,
  count(*) FILTER (WHERE status IN {UNFULFILLED}) AS order_count,
  CASE WHEN count(*) FILTER (WHERE status IN {UNFULFILLED}) > 0
       THEN round(sum(priority) FILTER (WHERE status IN {UNFULFILLED})
                  / count(*) FILTER (WHERE status IN {UNFULFILLED}), 6)
       ELSE 0 END AS avg_priority"""


def windows_sql(size_min: int, slide_min: int, wtype: str) -> str:
    n = size_min // slide_min
    return "WITH " + RECORDS + f""",
x AS (
  SELECT rec.*, time_bucket(INTERVAL {slide_min} MINUTE, ts) - i * INTERVAL {slide_min} MINUTE AS window_start
  FROM rec, range({n}) t(i))
SELECT bu, product_family, horizon, '{wtype}' AS window_type, window_start,
       window_start + INTERVAL {size_min} MINUTE AS window_end, {MEASURES}
FROM x GROUP BY ALL"""


ORACLE: dict[str, str] = {}

ORACLE["backlog_sliding_1h"] = windows_sql(60, 5, "sliding_1h")
ORACLE["backlog_sliding_24h"] = windows_sql(24 * 60, 60, "sliding_24h")
ORACLE["backlog_tumbling_daily"] = windows_sql(24 * 60, 24 * 60, "tumbling_daily")
ORACLE["backlog_tumbling_hourly"] = windows_sql(60, 60, "tumbling_hourly")

PARSED_COLS = """lsn, order_id, source_table, op, make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts,
  order_status, CASE WHEN has_bu THEN business_unit END AS business_unit,
  CAST(total_value AS VARCHAR) AS total_value, CASE WHEN has_bu THEN 7 ELSE 6 END AS image_keys"""

ORACLE["cdc_parse_envelope"] = f"WITH {CHG} SELECT {PARSED_COLS} FROM chg WHERE k <> 13"
ORACLE["cdc_parse_unwrapped"] = f"WITH {CHG} SELECT {PARSED_COLS} FROM chg"
ORACLE["cdc_row_image"] = f"""WITH {CHG}
SELECT lsn, op, CASE WHEN op = 'd' THEN 'before' ELSE 'after' END AS image_side, order_id,
       CASE WHEN has_bu THEN 7 ELSE 6 END AS image_keys FROM chg"""
ORACLE["cdc_dlq_split"] = f"""WITH {CHG}
SELECT 'cdc.public.orders' AS source_topic,
       CASE lsn % 3 WHEN 0 THEN 'malformed_json' WHEN 1 THEN 'invalid_op' ELSE 'missing_field' END AS reason,
       count(*) AS n_rejects
FROM chg WHERE k = 13 GROUP BY ALL"""
# LSN 0 is never deduplicated, so its repeated copy survives
ORACLE["cdc_union_dedup"] = f"""WITH {CHG}
SELECT order_id, source_table, op, ts, lsn FROM chg
UNION ALL
SELECT order_id, source_table, op, ts, lsn FROM chg WHERE lsn = 0"""
ORACLE["snapshot_plus_changes"] = """
WITH lines AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_shipdate AS ts,
         row_number() OVER (PARTITION BY l_orderkey, l_linenumber
           ORDER BY l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
                    l_tax, l_returnflag, l_linestatus) AS rn
  FROM lineitem),
ev AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 'orders' AS source_table, 'r' AS op,
         o_orderdate AS ts, 5 AS n_keys FROM orders
  UNION ALL
  SELECT order_id, 'order_line_items', CASE WHEN rn = 1 THEN 'c' ELSE 'u' END, ts, 4 FROM lines)
SELECT source_table, op, count(*) AS n_events, count(DISTINCT order_id) AS n_orders,
       min(ts) AS min_ts, max(ts) AS max_ts, CAST(sum(n_keys) AS BIGINT) AS image_values
FROM ev GROUP BY ALL"""


def fold_sql(as_of: str | None = None, where: str | None = None) -> str:
    if as_of:
        where = f"WHERE ts <= TIMESTAMP '{as_of}'"
    where = where or ""
    seq = "(ts, lsn)"
    h = "op <> 'd'"
    return f"""WITH {CHG}
SELECT order_id, '' AS customer_id, '' AS customer_name, '' AS channel,
  coalesce(arg_max(business_unit, {seq}) FILTER (WHERE {h} AND has_bu), '') AS business_unit,
  'USD' AS currency,
  coalesce(arg_max(order_status, {seq}) FILTER (WHERE {h}), 'CREATED') AS order_status,
  coalesce(arg_max(priority_tier, {seq}) FILTER (WHERE {h}), 3) AS priority_tier,
  CAST(coalesce(arg_max(total_value, {seq}) FILTER (WHERE {h}), 0) AS DOUBLE) AS total_value,
  arg_max(expected_ship_date, {seq}) FILTER (WHERE {h}) AS expected_ship_date,
  coalesce(arg_min(product_family, {seq}) FILTER (WHERE {h}), '') AS product_family,
  min(ts) FILTER (WHERE {h}) AS created_at, max(ts) FILTER (WHERE {h}) AS updated_at,
  count(*) AS event_count, TRUE AS atp_feasible
FROM chg {where} GROUP BY order_id"""


ORACLE["order_state_fold"] = fold_sql()
ORACLE["order_state_as_of"] = fold_sql("2024-01-15 12:00:00")
ORACLE["order_state_changelog"] = f"""WITH {CHANGELOG}
SELECT order_id, lsn, op, business_unit, product_family, order_status, priority_tier,
       CAST(total_value AS DOUBLE) AS total_value, expected_ship_date, created_at, updated_at
FROM cl"""

# ---------------------------------------------------------------------------
# Adapter A in SQL: current lines, first family, order state
# ---------------------------------------------------------------------------
LSEQ_COLS = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
             "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_linenumber"]
LSEQ = ", ".join(LSEQ_COLS)
LSEQ_DESC = ", ".join(f"{c} DESC" for c in LSEQ_COLS)

STAR = f"""
lraw AS (
  SELECT l.*, p.p_type, p.p_name,
         CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS line_id,
         row_number() OVER (PARTITION BY l.l_orderkey, l.l_linenumber ORDER BY {LSEQ_DESC}) AS rn_last
  FROM lineitem l LEFT JOIN part p ON l.l_partkey = p.p_partkey),
lcur AS (SELECT * FROM lraw WHERE rn_last = 1),
lfam AS (SELECT l_orderkey, arg_min(p_type, ({LSEQ})) AS first_family FROM lraw GROUP BY l_orderkey),
hdr AS (
  SELECT o.o_orderkey, CAST(o.o_orderkey AS VARCHAR) AS order_id,
         CAST(o.o_custkey AS VARCHAR) AS customer_id, c.c_name AS customer_name,
         c.c_mktsegment AS channel, r.r_name AS business_unit,
         CASE o.o_orderstatus WHEN 'O' THEN 'CREATED' WHEN 'P' THEN 'IN_PRODUCTION'
              WHEN 'F' THEN 'SHIPPED' END AS order_status,
         CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS priority_tier,
         CAST(o.o_totalprice AS DECIMAL(15,2)) AS total_value, 'USD' AS currency,
         o.o_orderdate AS created_at,
         o.o_orderdate + CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) * 30 * INTERVAL 1 DAY
           AS expected_ship_date
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
       LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
       LEFT JOIN region r ON n.n_regionkey = r.r_regionkey),
lagg AS (
  SELECT l_orderkey, count(*) AS line_count, sum(CAST(l_quantity AS DECIMAL(15,3))) AS total_demand,
         count(*) FILTER (WHERE l_linestatus = 'F') AS allocation_count,
         max(l_shipdate) AS last_ship_date,
         sum(CAST(l_quantity * (l_extendedprice / l_quantity) AS DECIMAL(15,2))) AS lines_value
  FROM lcur GROUP BY l_orderkey),
st AS (
  SELECT h.*, coalesce(f.first_family, '') AS product_family, h.created_at AS updated_at,
         coalesce(a.line_count, 0) AS line_count,
         coalesce(a.total_demand, CAST(0 AS DECIMAL(15,3))) AS total_demand,
         coalesce(a.allocation_count, 0) AS allocation_count,
         coalesce(a.lines_value, CAST(0 AS DECIMAL(15,2))) AS lines_value,
         CASE WHEN h.order_status IN ('SHIPPED', 'DELIVERED') THEN a.last_ship_date END AS ship_date,
         CASE WHEN coalesce(a.total_demand, 0) = 0 THEN TRUE ELSE h.order_status IN {ATP} END
           AS atp_feasible
  FROM hdr h LEFT JOIN lagg a ON h.o_orderkey = a.l_orderkey
       LEFT JOIN lfam f ON h.o_orderkey = f.l_orderkey)"""

ORACLE["order_line_items_flat"] = f"""WITH {STAR}
SELECT l.line_id, CAST(l.l_orderkey AS VARCHAR) AS order_id, h.business_unit, h.order_status,
       CAST(l.l_partkey AS VARCHAR) AS sku, l.p_type AS product_family, l.p_name AS description,
       l.l_quantity AS quantity, l.l_extendedprice / l.l_quantity AS unit_price,
       'OPEN' AS line_status
FROM lcur l LEFT JOIN hdr h ON l.l_orderkey = h.o_orderkey"""

ORACLE["order_total_check"] = f"""WITH {STAR}
SELECT order_id, CAST(total_value AS DOUBLE) AS header_total, CAST(lines_value AS DOUBLE) AS lines_total,
       CAST(total_value - lines_value AS DOUBLE) AS difference,
       CAST(total_demand AS DOUBLE) AS total_demand, line_count,
       (total_value - lines_value) = 0 AS consistent
FROM st"""

HIST = CHG + """,
hv AS (
  SELECT order_id, ts, lsn, order_status AS status,
         lag(order_status, 1, 'CREATED') OVER (PARTITION BY order_id ORDER BY ts, lsn) AS prev_status
  FROM chg WHERE op <> 'd'),
hist AS (
  SELECT order_id, row_number() OVER (PARTITION BY order_id ORDER BY ts, lsn) AS seq_no, status,
         ts AS timestamp, 'pipeline' AS source, prev_status
  FROM hv WHERE status IS DISTINCT FROM prev_status)"""

ORACLE["status_history"] = f"WITH {HIST} SELECT * FROM hist"
ORACLE["status_timeline"] = f"""WITH {HIST}
SELECT order_id, seq_no, status, timestamp AS entered_at,
       lead(timestamp) OVER (PARTITION BY order_id ORDER BY seq_no) AS left_at,
       (epoch_us(lead(timestamp) OVER (PARTITION BY order_id ORDER BY seq_no)) - epoch_us(timestamp))
         / 1000000.0 AS seconds_in_stage
FROM hist"""
ORACLE["illegal_transitions"] = f"""WITH {HIST}
SELECT prev_status AS from_status, status AS to_status, order_id, seq_no, timestamp
FROM hist
WHERE (prev_status, status) NOT IN (
  ('CREATED', 'ALLOCATED'), ('CREATED', 'CANCELLED'), ('ALLOCATED', 'IN_PRODUCTION'),
  ('ALLOCATED', 'CANCELLED'), ('IN_PRODUCTION', 'SHIPPED'), ('SHIPPED', 'DELIVERED'))"""

ISEQ = ("(ts, l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, "
        "l_tax, l_returnflag, l_linestatus)")
INV = f"""
inv_ev AS (
  SELECT CAST(l_partkey AS VARCHAR) AS sku, 'WH-' || CAST(l_suppkey % 4 AS VARCHAR) AS warehouse_id,
         CASE WHEN l_discount = 0.0 THEN 'd' ELSE 'u' END AS op, l_shipdate AS ts,
         CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(15,3)) ELSE 0 END AS available_qty,
         CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS DECIMAL(15,3)) ELSE 0 END AS allocated_qty,
         CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DECIMAL(15,3)) ELSE 0 END AS on_order_qty,
         l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus
  FROM lineitem),
pos0 AS (
  SELECT sku, warehouse_id, arg_max(op, {ISEQ}) AS op, arg_max(ts, {ISEQ}) AS updated_at,
         arg_max(available_qty, {ISEQ}) AS available_qty,
         arg_max(allocated_qty, {ISEQ}) AS allocated_qty,
         arg_max(on_order_qty, {ISEQ}) AS on_order_qty
  FROM inv_ev GROUP BY sku, warehouse_id),
pos AS (SELECT * FROM pos0 WHERE op <> 'd'),
sup AS (
  SELECT sku, count(*) AS warehouse_count, sum(available_qty) AS available_qty,
         sum(allocated_qty) AS allocated_qty, sum(on_order_qty) AS on_order_qty,
         max(updated_at) AS updated_at
  FROM pos GROUP BY sku)"""

QTY3 = ("CAST(available_qty AS DOUBLE) AS available_qty, CAST(allocated_qty AS DOUBLE) AS allocated_qty, "
        "CAST(on_order_qty AS DOUBLE) AS on_order_qty")

ORACLE["inventory_position"] = f"WITH {INV} SELECT sku, warehouse_id, {QTY3}, updated_at FROM pos"
ORACLE["inventory_deltas"] = f"""WITH {INV}
SELECT sku, warehouse_id, CAST(sum(available_qty) AS DOUBLE) AS available_qty,
       CAST(sum(allocated_qty) AS DOUBLE) AS allocated_qty,
       CAST(sum(on_order_qty) AS DOUBLE) AS on_order_qty, count(*) AS n_events
FROM inv_ev GROUP BY sku, warehouse_id"""
ORACLE["supply_by_sku"] = f"WITH {INV} SELECT sku, warehouse_count, {QTY3}, updated_at FROM sup"
ORACLE["supply_heatmap"] = f"""WITH {INV},
fam AS (SELECT CAST(p_partkey AS VARCHAR) AS sku, p_type AS product_family FROM part),
pv AS (
  SELECT product_family,
    CAST(coalesce(sum(available_qty) FILTER (WHERE warehouse_id = 'WH-0'), 0) AS DOUBLE) AS wh_0,
    CAST(coalesce(sum(available_qty) FILTER (WHERE warehouse_id = 'WH-1'), 0) AS DOUBLE) AS wh_1,
    CAST(coalesce(sum(available_qty) FILTER (WHERE warehouse_id = 'WH-2'), 0) AS DOUBLE) AS wh_2,
    CAST(coalesce(sum(available_qty) FILTER (WHERE warehouse_id = 'WH-3'), 0) AS DOUBLE) AS wh_3
  FROM pos JOIN fam USING (sku) GROUP BY product_family),
lt AS (
  SELECT p.p_type AS product_family,
         round(quantile_cont((epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 86400000000.0, 0.05), 6) AS lead_days_p05,
         round(quantile_cont((epoch_us(l.l_shipdate) - epoch_us(o.o_orderdate)) / 86400000000.0, 0.95), 6) AS lead_days_p95
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN part p ON l.l_partkey = p.p_partkey
  GROUP BY p.p_type)
SELECT pv.*, lt.lead_days_p05, lt.lead_days_p95 FROM pv LEFT JOIN lt USING (product_family)"""

ORACLE["inventory_asof_orders"] = f"""WITH {STAR}, {INV},
ln AS (
  SELECT l.line_id, CAST(l.l_partkey AS VARCHAR) AS sku, h.created_at AS line_ts
  FROM lcur l JOIN hdr h ON l.l_orderkey = h.o_orderkey),
m AS (
  SELECT ln.line_id, ln.sku, ln.line_ts, e.warehouse_id, max(e.ts) AS ts,
         arg_max({{'op': e.op, 'available_qty': e.available_qty}},
                 (e.ts, e.l_orderkey, e.l_linenumber, e.l_suppkey, e.l_quantity, e.l_extendedprice,
                  e.l_discount, e.l_tax, e.l_returnflag, e.l_linestatus)) AS cur
  FROM ln LEFT JOIN inv_ev e ON e.sku = ln.sku AND e.ts <= ln.line_ts
  GROUP BY ln.line_id, ln.sku, ln.line_ts, e.warehouse_id)
SELECT line_id, sku, line_ts, max(ts) AS inv_ts, count(*) FILTER (WHERE cur.op = 'u') AS warehouse_count,
       coalesce(CAST(sum(cur.available_qty) FILTER (WHERE cur.op = 'u') AS DOUBLE), 0.0) AS available_qty
FROM m GROUP BY line_id, sku, line_ts"""

ORACLE["enrich_broadcast"] = f"""WITH {STAR}, {INV}
SELECT l.line_id, CAST(l.l_partkey AS VARCHAR) AS sku, l.l_quantity AS quantity,
       coalesce(s.warehouse_count, 0) AS warehouse_count,
       coalesce(CAST(s.available_qty AS DOUBLE), 0.0) AS available_qty,
       l.l_quantity <= coalesce(CAST(s.available_qty AS DOUBLE), 0.0) AS covered
FROM lcur l LEFT JOIN sup s ON CAST(l.l_partkey AS VARCHAR) = s.sku"""

ORACLE["atp_by_status"] = f"""WITH {STAR}
SELECT order_id, order_status, CAST(total_demand AS DOUBLE) AS total_demand, atp_feasible FROM st"""

ORACLE["atp_by_inventory"] = f"""WITH {STAR}, {INV},
dem AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS order_id, CAST(l_partkey AS VARCHAR) AS sku,
         sum(CAST(l_quantity AS DECIMAL(15,3))) AS demand
  FROM lcur GROUP BY ALL),
j AS (
  SELECT d.order_id, d.demand, coalesce(s.available_qty, 0) AS available
  FROM dem d LEFT JOIN (SELECT sku, sum(available_qty) AS available_qty FROM pos GROUP BY sku) s
       USING (sku))
SELECT order_id, count(*) AS sku_count, CAST(sum(demand) AS DOUBLE) AS total_demand,
       CAST(sum(available) AS DOUBLE) AS total_available, sum(demand) <= sum(available) AS atp_pooled,
       bool_and(demand <= available) AS atp_per_sku
FROM j GROUP BY order_id"""

ORACLE["supply_demand_gap"] = f"""WITH {STAR}, {INV},
dem AS (
  SELECT l.p_type AS product_family, sum(CAST(l.l_quantity AS DECIMAL(15,3))) AS demand_qty
  FROM lcur l JOIN hdr h ON l.l_orderkey = h.o_orderkey
  WHERE h.order_status IN {UNFULFILLED} GROUP BY l.p_type),
sp AS (
  SELECT p.p_type AS product_family, sum(available_qty) AS available_qty, sum(on_order_qty) AS on_order_qty
  FROM pos JOIN part p ON pos.sku = CAST(p.p_partkey AS VARCHAR) GROUP BY p.p_type)
SELECT coalesce(d.product_family, s.product_family) AS product_family,
       CAST(coalesce(d.demand_qty, 0) AS DOUBLE) AS demand_qty,
       CAST(coalesce(s.available_qty, 0) AS DOUBLE) AS available_qty,
       CAST(coalesce(s.on_order_qty, 0) AS DOUBLE) AS on_order_qty,
       CAST(coalesce(d.demand_qty, 0) - coalesce(s.available_qty, 0) AS DOUBLE) AS gap_qty
FROM dem d FULL OUTER JOIN sp s ON d.product_family = s.product_family"""

# ---------------------------------------------------------------------------
# search, facets, listings, trends
# ---------------------------------------------------------------------------

def tokens_sql(expr: str) -> str:
    return (f"list_filter(regexp_split_to_array(lower(coalesce({expr}, '')), '[^\\p{{L}}\\p{{N}}]+'), "
            f"lambda x: x <> '')")


HITS = STAR + f""",
lhit AS (
  SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS order_id FROM lcur
  WHERE list_has_any({tokens_sql('p_name')}, ['widget']) OR CAST(l_partkey AS VARCHAR) = 'widget'),
hits AS (
  SELECT st.* FROM st
  WHERE order_status = 'CREATED'
    AND updated_at >= TIMESTAMP '1996-01-01' AND updated_at < TIMESTAMP '1999-01-01'
    AND (list_has_any({tokens_sql('customer_name')}, ['widget']) OR order_id = 'widget'
         OR order_id IN (SELECT order_id FROM lhit)))"""

ORACLE["order_search_page"] = f"""WITH {HITS}
SELECT row_number() OVER (ORDER BY updated_at DESC, order_id) AS position, order_id,
       customer_name, business_unit, product_family, order_status, priority_tier,
       CAST(total_value AS DOUBLE) AS total_value, updated_at
FROM hits ORDER BY updated_at DESC, order_id LIMIT 20 OFFSET 20"""

ORACLE["order_search_facets"] = f"""WITH {HITS},
g AS (
  SELECT CASE WHEN GROUPING(order_status) = 0 THEN 'order_status'
              WHEN GROUPING(business_unit) = 0 THEN 'business_unit'
              WHEN GROUPING(product_family) = 0 THEN 'product_family'
              WHEN GROUPING(priority_tier) = 0 THEN 'priority_tier'
              WHEN GROUPING(channel) = 0 THEN 'channel' ELSE 'total' END AS facet,
         coalesce(order_status, business_unit, product_family, CAST(priority_tier AS VARCHAR),
                  channel) AS key,
         count(*) AS doc_count
  FROM hits
  GROUP BY GROUPING SETS ((order_status), (business_unit), (product_family), (priority_tier),
                          (channel), ())),
r AS (SELECT *, row_number() OVER (PARTITION BY facet ORDER BY doc_count DESC, key) AS rank FROM g)
SELECT facet, key, doc_count, rank FROM r
WHERE rank <= CASE facet WHEN 'order_status' THEN 10 WHEN 'business_unit' THEN 20
                         WHEN 'product_family' THEN 20 WHEN 'priority_tier' THEN 10
                         WHEN 'channel' THEN 20 ELSE 1 END"""

ORACLE["order_lookup"] = f"""WITH {STAR}
SELECT order_id, customer_id, customer_name, channel, business_unit, product_family, order_status,
       priority_tier, CAST(total_value AS DOUBLE) AS total_value, created_at, expected_ship_date,
       line_count, ship_date, atp_feasible
FROM st WHERE o_orderkey = 7"""

ORACLE["orders_by_status"] = f"""WITH {STAR}
SELECT order_id, order_status, updated_at, customer_name, product_family, priority_tier,
       CAST(total_value AS DOUBLE) AS total_value
FROM st WHERE business_unit = 'AMERICA' AND order_status = 'CREATED'
ORDER BY updated_at DESC, order_id LIMIT 100"""


def trend_sql(base: str, src: str, ts: str, unit: str, measures: str, names: list[str]) -> str:
    step = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAY"}[unit]
    fill = ", ".join(f"coalesce(c.{n}, 0) AS {n}" for n in names)
    return f"""WITH {base},
c AS (SELECT CAST(date_trunc('{unit}', {ts}) AS TIMESTAMP) AS bucket, {measures} FROM {src} GROUP BY 1),
g AS (SELECT unnest(generate_series(min(bucket), max(bucket), {step})) AS bucket FROM c)
SELECT g.bucket, {fill} FROM g LEFT JOIN c USING (bucket)"""


_OT = "count(*) AS order_count, CAST(sum(total_value) AS DOUBLE) AS total_value"
for _u in ("hour", "day", "week"):
    ORACLE[f"order_trends_{_u}"] = trend_sql(STAR, "st", "created_at", _u, _OT,
                                             ["order_count", "total_value"])
ORACLE["status_trends_day"] = trend_sql(
    HIST, "hist", "timestamp", "day",
    "count(*) AS status_changes, count(*) FILTER (WHERE status IN ('SHIPPED', 'DELIVERED')) AS fulfilled, "
    "count(*) FILTER (WHERE status = 'CANCELLED') AS cancelled",
    ["status_changes", "fulfilled", "cancelled"])
ORACLE["order_intake_rate"] = f"""WITH d AS ({trend_sql(STAR, "st", "created_at", "day",
                                               "count(*) AS orders", ["orders"])})
SELECT bucket, orders,
       round(avg(orders) OVER (ORDER BY bucket ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6) AS avg_7d
FROM d"""

# ---------------------------------------------------------------------------
# backlog summary / detail / trend / depth / documents
# ---------------------------------------------------------------------------

def window_select(size_min: int, slide_min: int, wtype: str, alias: str) -> str:
    n = size_min // slide_min
    return f"""{alias}x AS (
  SELECT rec.*, time_bucket(INTERVAL {slide_min} MINUTE, ts) - i * INTERVAL {slide_min} MINUTE AS window_start
  FROM rec, range({n}) t(i)),
{alias} AS (
  SELECT bu, product_family, horizon, '{wtype}' AS window_type, window_start,
         window_start + INTERVAL {size_min} MINUTE AS window_end, {MEASURES}
  FROM {alias}x GROUP BY ALL)"""


METRICS = RECORDS + ",\n" + window_select(60, 5, "sliding_1h", "ms") + ",\n" + \
    window_select(24 * 60, 24 * 60, "tumbling_daily", "mt") + """,
m AS (SELECT * FROM ms UNION ALL SELECT * FROM mt)"""

def summary_sql(metrics_ctes: str, extra: str = "", label: str = "ALL") -> str:
    """Backlog summary over a CTE chain that defines ``m`` (metric rows)."""
    return f"""WITH {metrics_ctes},
fam AS (
  SELECT product_family, sum(CAST(unfulfilled_demand AS DECIMAL(15,2))) AS demand,
         sum(CAST(available_supply AS DECIMAL(15,2))) AS supply,
         sum(CAST(demand_gap AS DECIMAL(15,2))) AS gap, sum(order_count) AS orders,
         count(*) AS doc_count
  FROM m GROUP BY product_family),
top AS (SELECT * FROM fam QUALIFY row_number() OVER (ORDER BY doc_count DESC, product_family) <= 50),
tot AS (
  SELECT 'ALL' AS product_family, sum(CAST(unfulfilled_demand AS DECIMAL(15,2))) AS demand,
         sum(CAST(available_supply AS DECIMAL(15,2))) AS supply,
         sum(CAST(demand_gap AS DECIMAL(15,2))) AS gap, sum(order_count) AS orders
  FROM m),
u AS (SELECT product_family, demand, supply, gap, orders FROM top UNION ALL SELECT * FROM tot)
SELECT '{label}' AS business_unit, product_family, CAST(coalesce(demand, 0) AS DOUBLE) AS demand,
       CAST(coalesce(supply, 0) AS DOUBLE) AS supply, CAST(coalesce(gap, 0) AS DOUBLE) AS gap,
       CAST(coalesce(orders, 0) AS BIGINT) AS order_count,
       CASE WHEN coalesce(gap, 0) > 0 THEN 'At Risk' ELSE 'Covered' END AS status_label{extra}
FROM u"""


ORACLE["backlog_summary"] = summary_sql(METRICS)

ORACLE["backlog_detail"] = f"""WITH {METRICS}
SELECT * FROM m
WHERE bu = 'North America' AND product_family = 'Networking' AND horizon = 'D30'
  AND window_type = 'sliding_1h'
ORDER BY window_start DESC LIMIT 100"""

ORACLE["backlog_trend_delta"] = f"""WITH {RECORDS},
{window_select(24 * 60, 24 * 60, "tumbling_daily", "mt")}
SELECT bu, product_family, horizon, window_type, window_start,
  lag(window_start) OVER w AS prev_window_start,
  CAST(CAST(unfulfilled_demand AS DECIMAL(15,2)) - lag(CAST(unfulfilled_demand AS DECIMAL(15,2))) OVER w AS DOUBLE) AS unfulfilled_demand_delta,
  CAST(CAST(available_supply AS DECIMAL(15,2)) - lag(CAST(available_supply AS DECIMAL(15,2))) OVER w AS DOUBLE) AS available_supply_delta,
  CAST(CAST(demand_gap AS DECIMAL(15,2)) - lag(CAST(demand_gap AS DECIMAL(15,2))) OVER w AS DOUBLE) AS demand_gap_delta
FROM mt
WINDOW w AS (PARTITION BY bu, product_family, horizon, window_type ORDER BY window_start)"""

ORACLE["backlog_depth_cube"] = f"""WITH fo AS ({fold_sql("2024-01-31 00:00:00")}),
r AS (
  SELECT business_unit AS bu, product_family, {horizon_sql('expected_ship_date', EV_AS_OF)} AS horizon,
         order_status AS status, CAST(total_value AS DECIMAL(15,2)) AS total_value,
         priority_tier AS priority, TRUE AS atp_feasible
  FROM fo)
SELECT coalesce(bu, 'ALL') AS bu, coalesce(product_family, 'ALL') AS product_family,
       coalesce(horizon, 'ALL') AS horizon,
       CAST(GROUPING(bu, product_family, horizon) AS INTEGER) AS grouping_id, {MEASURES}
FROM r GROUP BY CUBE (bu, product_family, horizon)"""

ORACLE["horizon_buckets"] = f"""WITH {RECORDS}
SELECT horizon,
       CASE WHEN status IN {UNFULFILLED} THEN 'unfulfilled'
            WHEN status IN ('SHIPPED', 'DELIVERED') THEN 'fulfilled'
            WHEN status = 'CANCELLED' THEN 'cancelled' ELSE 'other' END AS status_class,
       count(*) AS n_records, CAST(sum(total_value) AS DOUBLE) AS total_value,
       count(*) FILTER (WHERE atp_feasible) AS n_atp
FROM rec GROUP BY ALL"""

ORACLE["backlog_documents"] = f"""WITH {METRICS},
d AS (SELECT *, strftime(window_start, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS ws FROM m)
SELECT concat_ws('|', bu, product_family, horizon, window_type, ws) AS doc_id,
       bu AS business_unit, product_family, horizon AS horizon_bucket, window_type,
       ws AS window_start, unfulfilled_demand, available_supply, demand_gap, order_count, avg_priority
FROM d"""

ORACLE["backlog_reconciliation"] = f"""WITH {RECORDS},
{window_select(60, 5, "sliding_1h", "ms")}
SELECT bu, product_family, horizon, window_type, window_start,
       CAST(0 AS DOUBLE) AS unfulfilled_demand_rel_diff, CAST(0 AS DOUBLE) AS available_supply_rel_diff,
       CAST(0 AS DOUBLE) AS demand_gap_rel_diff, CAST(0 AS DOUBLE) AS order_count_rel_diff
FROM ms"""

# ---------------------------------------------------------------------------
# fulfilment, exceptions, alerts, governance, skew, upsert, late data
# ---------------------------------------------------------------------------

def _days(later: str, earlier: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0)"


FUL = STAR + f""",
f AS (
  SELECT st.*,
    CASE WHEN {_days('ship_date', 'created_at')} >= 0 THEN {_days('ship_date', 'created_at')} END AS cycle_days,
    order_status IN {UNFULFILLED} AND expected_ship_date < {STAR_AS_OF} AS is_delayed,
    order_status IN {UNFULFILLED} AND updated_at < {STAR_AS_OF} - INTERVAL 7 DAY AS is_stuck,
    order_status = 'CREATED' AND line_count > 0 AND allocation_count = 0 AS is_alloc_failed
  FROM st)"""

ORACLE["fulfillment_daily"] = f"""WITH {FUL},
g AS (
  SELECT business_unit, CAST(created_at AS DATE) AS metric_date,
    round(avg(CASE WHEN order_status IN ('SHIPPED', 'DELIVERED') AND ship_date IS NOT NULL
                   THEN CAST(ship_date <= expected_ship_date AS INTEGER) END), 6) AS on_time_rate,
    round(quantile_cont(cycle_days, 0.5), 6) AS cycle_time_p50,
    round(quantile_cont(cycle_days, 0.95), 6) AS cycle_time_p95,
    count(*) FILTER (WHERE is_delayed OR is_stuck OR is_alloc_failed) AS exception_count,
    count(*) AS total_orders,
    count(*) FILTER (WHERE order_status IN ('SHIPPED', 'DELIVERED')) AS shipped_orders
  FROM f GROUP BY ALL)
SELECT * FROM g
QUALIFY row_number() OVER (PARTITION BY business_unit ORDER BY metric_date DESC) <= 90"""

ORACLE["cycle_time_histogram"] = f"""WITH {FUL}
SELECT CAST(floor(cycle_days / 30.0) AS BIGINT) AS bin,
       CAST(floor(cycle_days / 30.0) AS BIGINT) * 30 AS bin_start_days, count(*) AS n_orders
FROM f WHERE cycle_days IS NOT NULL GROUP BY 1, 2"""

ORACLE["exception_queue"] = f"""WITH {FUL},
x AS (
  SELECT *, 'delayed' AS exception_type FROM f WHERE is_delayed
  UNION ALL SELECT *, 'stuck' FROM f WHERE is_stuck
  UNION ALL SELECT *, 'allocation_failed' FROM f WHERE is_alloc_failed)
SELECT order_id, business_unit, order_status, exception_type,
       round({_days(STAR_AS_OF, 'created_at')}, 6) AS days_open,
       CASE WHEN exception_type = 'delayed'
            THEN round({_days(STAR_AS_OF, 'expected_ship_date')}, 6) END AS days_late
FROM x"""

ORACLE["threshold_alerts"] = f"""WITH {FUL},
um AS (
  SELECT business_unit,
    CAST(sum(total_value) FILTER (WHERE order_status IN {UNFULFILLED}) AS DOUBLE) AS open_backlog_value,
    round(avg(CAST((is_delayed OR is_stuck OR is_alloc_failed) AS INTEGER)), 6) AS exception_rate,
    round(quantile_cont(cycle_days, 0.95), 6) AS cycle_time_p95_days
  FROM f GROUP BY business_unit),
lng AS (
  SELECT business_unit, 'open_backlog_value' AS metric, open_backlog_value AS value FROM um
  UNION ALL SELECT business_unit, 'exception_rate', exception_rate FROM um
  UNION ALL SELECT business_unit, 'cycle_time_p95_days', cycle_time_p95_days FROM um),
th AS (
  SELECT metric, scope, CAST(threshold AS DOUBLE) AS threshold FROM (VALUES
    ('open_backlog_value', 'ALL', 500000000), ('exception_rate', 'ALL', 0.67),
    ('cycle_time_p95_days', 'ALL', 2120), ('open_backlog_value', 'EUROPE', 400000000))
    t(metric, scope, threshold)),
j AS (
  SELECT l.business_unit, l.metric, l.value, th.scope, th.threshold,
         row_number() OVER (PARTITION BY l.business_unit, l.metric
                            ORDER BY CASE WHEN th.scope = 'ALL' THEN 1 ELSE 0 END) AS rn
  FROM lng l JOIN th ON l.metric = th.metric AND (th.scope = l.business_unit OR th.scope = 'ALL'))
SELECT business_unit, metric, value, scope, threshold FROM j WHERE rn = 1 AND value > threshold"""

ORACLE["bu_scoped_orders"] = f"""WITH {STAR}
SELECT order_id, business_unit, order_status, CAST(total_value AS DOUBLE) AS total_value
FROM st WHERE business_unit IN ('EUROPE', 'MIDDLE EAST', 'AFRICA')"""

ORACLE["retention_active_orders"] = f"""WITH {STAR}
SELECT order_id, updated_at, order_status, round({_days(STAR_AS_OF, 'updated_at')}, 6) AS age_days
FROM st WHERE updated_at >= {STAR_AS_OF} - INTERVAL 90 DAY"""

ORACLE["dashboard_labels"] = f"""WITH {STAR}
SELECT order_id, priority_tier,
       CASE WHEN priority_tier BETWEEN 1 AND 5
            THEN (['P1-Critical', 'P2-High', 'P3-Medium', 'P4-Low', 'P5-Minimal'])[priority_tier]
            ELSE 'P' || CAST(priority_tier AS VARCHAR) END AS priority_label,
       priority_tier <= 2 AS high_priority,
       CAST(round(total_value / 1000, 0) AS BIGINT) AS value_k, order_status
FROM st"""

ORACLE["hot_keys_salted_totals"] = """
SELECT event_type, count(*) AS n_rows,
       CAST(sum(CAST(value AS DECIMAL(15,2))) AS DOUBLE) AS total_value,
       count(DISTINCT user_id) AS n_distinct,
       count(*) > 0.05 * (SELECT count(*) FROM events) AS is_hot
FROM events GROUP BY event_type"""

_UPS_COLS = ("order_id, {src} AS source, business_unit, product_family, order_status, total_value, "
             "created_at, updated_at, "
             "(business_unit <> '' AND order_status <> '') AS listed")
UPSERT_SPLIT = "TIMESTAMP '2024-01-30 00:00:00'"
ORACLE["upsert_latest_orders"] = f"""WITH
b AS ({fold_sql(where=f"WHERE ts < {UPSERT_SPLIT}")}),
d AS ({fold_sql(where=f"WHERE order_id IN (SELECT order_id FROM chg WHERE ts >= {UPSERT_SPLIT})")})
SELECT {_UPS_COLS.format(src="'delta'")} FROM d
UNION ALL
SELECT {_UPS_COLS.format(src="'base'")} FROM b WHERE order_id NOT IN (SELECT order_id FROM d)"""

ARRIVALS = CHG + """,
a AS (SELECT lsn, order_id, ts, business_unit, k,
             ts + (k % 7) * 10 * INTERVAL 1 SECOND AS arrival_ts FROM chg)"""

ORACLE["late_events"] = f"""WITH {ARRIVALS},
w AS (
  SELECT *, max(ts) OVER (ORDER BY arrival_ts, lsn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
            - INTERVAL 30 SECOND AS watermark
  FROM a)
SELECT lsn, order_id, ts, arrival_ts, watermark,
       (epoch_us(watermark) - epoch_us(ts)) / 1000000.0 AS lateness_seconds
FROM w WHERE ts < watermark"""

ORACLE["pipeline_latency"] = f"""WITH {ARRIVALS}
SELECT business_unit, count(*) AS n,
       round(quantile_cont(CAST((k % 7) * 10 AS DOUBLE), 0.5), 6) AS p50_s,
       round(quantile_cont(CAST((k % 7) * 10 AS DOUBLE), 0.95), 6) AS p95_s,
       round(quantile_cont(CAST((k % 7) * 10 AS DOUBLE), 0.99), 6) AS p99_s
FROM a GROUP BY business_unit"""


def _iso(c: str) -> str:
    return (f"CASE WHEN epoch_us({c}) % 1000000 = 0 THEN strftime({c}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({c}, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00'")


ORACLE["order_documents"] = f"""WITH {STAR}
SELECT order_id, customer_id, customer_name, channel, business_unit, product_family, order_status,
       priority_tier, CAST(total_value AS DOUBLE) AS total_value, currency, atp_feasible,
       {_iso('created_at')} AS created_at, {_iso('updated_at')} AS updated_at,
       {_iso('expected_ship_date')} AS expected_ship_date, line_count,
       CASE WHEN ship_date IS NOT NULL
            THEN (['FedEx', 'UPS', 'DHL', 'Amazon Logistics'])[o_orderkey % 4 + 1] END AS shipment_carrier,
       CASE WHEN ship_date IS NOT NULL THEN 'SHIPPED' END AS shipment_status,
       {_iso('ship_date')} AS shipment_ship_date
FROM st"""

# ---------------------------------------------------------------------------
# streaming runs: same results as batch over the accepted events; windows
# only once closed by the final watermark (max event time - 30 s)
# ---------------------------------------------------------------------------
# accepted stream events: corrupted (k = 13) rows go to the dead letters; the
# repeated copy of LSN 0 is never deduplicated
# (event time travels as epoch milliseconds on the wire)
STREAM_CHG = CHG.replace("chg AS (", "chg0 AS (") + """,
chg1 AS (
  SELECT * REPLACE (make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts) FROM chg0 WHERE k <> 13),
chg AS (SELECT * FROM chg1 UNION ALL SELECT * FROM chg1 WHERE lsn = 0)"""
STREAM_CHANGELOG = STREAM_CHG + CHANGELOG[len(CHG):]
STREAM_RECORDS = STREAM_CHANGELOG + RECORDS[len(CHANGELOG):]

ORACLE["stream_dedup"] = f"WITH {STREAM_CHG} SELECT {PARSED_COLS} FROM chg"
ORACLE["stream_order_state"] = f"""WITH {STREAM_CHANGELOG}
SELECT order_id, lsn, op, business_unit, product_family, order_status, priority_tier,
       CAST(total_value AS DOUBLE) AS total_value, expected_ship_date, created_at, updated_at
FROM cl"""
ORACLE["stream_backlog_windows"] = f"""WITH {STREAM_RECORDS},
{window_select(60, 5, "sliding_1h", "ms")}
SELECT * FROM ms WHERE window_end <= (SELECT max(ts) FROM rec) - INTERVAL 30 SECOND"""
ORACLE["stream_dashboard_push"] = summary_sql(
    STREAM_RECORDS + ",\n" + window_select(60, 5, "sliding_1h", "ms") + """,
closed AS (SELECT * FROM ms WHERE window_end <= (SELECT max(ts) FROM rec) - INTERVAL 30 SECOND),
m AS (SELECT * FROM closed)""",
    ", 'backlog_update' AS type")
ORACLE["stream_order_state_out_of_order"] = f"""WITH {STREAM_CHANGELOG},
last AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, lsn DESC) = 1)
SELECT order_id, business_unit, product_family, order_status, priority_tier,
       CAST(total_value AS DOUBLE) AS total_value, expected_ship_date, created_at, updated_at
FROM last"""

ORACLE["star_cdc_fold"] = f"""WITH {STAR},
alloc AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS allocation_count
          FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_orderkey),
ship AS (SELECT l.l_orderkey, max(l.l_shipdate) AS ship_date
         FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
         WHERE o.o_orderstatus = 'F' GROUP BY l.l_orderkey)
SELECT st.order_id, business_unit, order_status, priority_tier,
       CAST(total_value AS DOUBLE) AS total_value, product_family, line_count,
       CAST(total_demand AS DOUBLE) AS total_demand,
       coalesce(a.allocation_count, 0) AS allocation_count, s.ship_date,
       CASE WHEN s.ship_date IS NOT NULL THEN 'SHIPPED' END AS shipment_status,
       atp_feasible, created_at, updated_at
FROM st LEFT JOIN alloc a ON st.o_orderkey = a.l_orderkey
        LEFT JOIN ship s ON st.o_orderkey = s.l_orderkey"""

ORACLE["pipeline_event_log"] = f"""WITH {CHG}
SELECT order_id, ts AS event_ts, source_table || '.' || op AS event_type, lsn AS source_lsn,
  CAST(to_json(CASE WHEN has_bu THEN MAP {{
      'order_id': order_id, 'order_status': order_status, 'business_unit': business_unit,
      'product_family': product_family, 'priority_tier': CAST(priority_tier AS VARCHAR),
      'total_value': CAST(total_value AS VARCHAR),
      'expected_ship_date': CAST(expected_ship_date AS VARCHAR)}}
    ELSE MAP {{
      'order_id': order_id, 'order_status': order_status,
      'product_family': product_family, 'priority_tier': CAST(priority_tier AS VARCHAR),
      'total_value': CAST(total_value AS VARCHAR),
      'expected_ship_date': CAST(expected_ship_date AS VARCHAR)}} END) AS VARCHAR) AS payload
FROM chg WHERE ts >= {EV_AS_OF} - INTERVAL 7 DAY"""

ORACLE["serving_orders_by_status"] = f"""WITH fo AS ({fold_sql("2024-01-31 00:00:00")})
SELECT order_id, order_status, updated_at, customer_name, product_family, priority_tier,
       total_value
FROM fo WHERE business_unit = 'EMEA' AND order_status = 'SHIPPED'
ORDER BY updated_at DESC, order_id LIMIT 100"""

ORACLE["order_storage_rows"] = f"""WITH {STAR}
SELECT st.order_id, l.line_id, business_unit, order_status, CAST(total_value AS DOUBLE) AS total_value,
       CASE WHEN l.line_id IS NOT NULL THEN
         CAST(to_json({{'line_id': l.line_id, 'sku': CAST(l.l_partkey AS VARCHAR),
                        'product_family': l.p_type, 'description': l.p_name,
                        'quantity': l.l_quantity, 'unit_price': l.l_extendedprice / l.l_quantity,
                        'line_status': 'OPEN'}}) AS VARCHAR) END AS line_item,
       l.line_id AS parsed_line_id, l.l_quantity AS parsed_quantity
FROM st LEFT JOIN lcur l ON st.order_id = CAST(l.l_orderkey AS VARCHAR)"""

ORACLE["star_cdc_lines"] = f"""WITH {STAR}
SELECT CAST(l_orderkey AS VARCHAR) AS order_id, line_id, CAST(l_partkey AS VARCHAR) AS sku,
       coalesce(p_type, '') AS product_family, p_name AS description, l_quantity AS quantity,
       l_extendedprice / l_quantity AS unit_price, 'OPEN' AS line_status
FROM lcur WHERE l_orderkey IN (SELECT o_orderkey FROM orders)"""

ORACLE["star_cdc_allocations"] = f"""
SELECT CAST(l_orderkey AS VARCHAR) AS order_id,
       CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS allocation_id,
       CAST(l_partkey AS VARCHAR) AS sku, 'WH-' || CAST(l_suppkey % 4 AS VARCHAR) AS warehouse_id,
       l_quantity AS allocated_qty, 'ALLOCATED' AS status
FROM lineitem WHERE l_linestatus = 'F' AND l_orderkey IN (SELECT o_orderkey FROM orders)
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {LSEQ_DESC}) = 1"""

# the streamed position table must equal the batch position
ORACLE["stream_inventory_position"] = ORACLE["inventory_position"]

ORACLE["stream_order_documents"] = f"""WITH {STREAM_CHANGELOG},
last AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, lsn DESC) = 1)
SELECT order_id, '' AS customer_id, '' AS customer_name, '' AS channel, business_unit,
       product_family, order_status, priority_tier, CAST(total_value AS DOUBLE) AS total_value,
       'USD' AS currency, {_iso('created_at')} AS created_at, {_iso('updated_at')} AS updated_at,
       {_iso('expected_ship_date')} AS expected_ship_date
FROM last"""

ORACLE["orders_by_status_as_coded"] = f"""WITH {CHANGELOG},
lst AS (
  SELECT business_unit, order_status, updated_at, order_id,
         arg_max({{'customer_name': '', 'product_family': product_family,
                   'priority_tier': priority_tier, 'total_value': total_value}}, (ts, lsn)) AS v
  FROM cl WHERE business_unit <> '' AND order_status <> ''
  GROUP BY ALL)
SELECT order_id, order_status, updated_at, v.customer_name AS customer_name,
       v.product_family AS product_family, v.priority_tier AS priority_tier,
       CAST(v.total_value AS DOUBLE) AS total_value
FROM lst WHERE business_unit = 'EMEA' AND order_status = 'SHIPPED'
ORDER BY updated_at DESC, order_id LIMIT 100"""

ORACLE["backlog_summary_filtered"] = summary_sql(
    RECORDS + ",\n" + window_select(60, 5, "sliding_1h", "ms") + """,
m AS (SELECT * FROM ms WHERE bu = 'North America' AND horizon = 'D7')""", label="North America")

ORACLE["order_search_terms_page"] = f"""WITH {STAR}
SELECT row_number() OVER (ORDER BY updated_at DESC, order_id) AS position, order_id,
       customer_name, business_unit, product_family, order_status, priority_tier,
       CAST(total_value AS DOUBLE) AS total_value, updated_at
FROM st WHERE business_unit = 'ASIA' AND product_family = 'PROMO'
ORDER BY updated_at DESC, order_id LIMIT 50"""

ORACLE["order_trends_day_unit"] = trend_sql(
    STAR + ",\nste AS (SELECT * FROM st WHERE business_unit = 'EUROPE')", "ste", "created_at", "day",
    _OT, ["order_count", "total_value"])

ORACLE["supply_for_sku"] = (f"WITH {INV} SELECT sku, warehouse_id, {QTY3}, updated_at FROM pos "
                            "WHERE sku = '42'")

# ---------------------------------------------------------------------------
# the whole order state on a stream equals the batch fold
# ---------------------------------------------------------------------------
for _n in ("stream_order_state_full", "stream_order_state_recovered", "stream_handover_state"):
    ORACLE[_n] = ORACLE["star_cdc_fold"]
ORACLE["stream_lines"] = ORACLE["star_cdc_lines"]
ORACLE["stream_allocations"] = ORACLE["star_cdc_allocations"]
# event time travels as epoch milliseconds
HIST_MS = CHG.replace("chg AS (", "chg0 AS (") + """,
chg AS (SELECT * REPLACE (make_timestamp((epoch_us(ts) // 1000) * 1000) AS ts) FROM chg0)""" + HIST[len(CHG):]
ORACLE["stream_status_history"] = f"""WITH {HIST_MS}
SELECT order_id, seq_no, status, timestamp, source, prev_status FROM hist"""
ORACLE["stream_order_listing"] = f"""WITH {STAR}
SELECT business_unit, order_status, order_id, updated_at, customer_name, product_family, priority_tier,
       CAST(total_value AS DOUBLE) AS total_value
FROM st WHERE business_unit <> '' AND order_status <> ''"""
ORACLE["stream_order_documents_full"] = f"""WITH {STAR},
ship AS (SELECT l.l_orderkey, max(l.l_shipdate) AS shipped
         FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F' GROUP BY l.l_orderkey)
SELECT order_id, customer_id, customer_name, channel, business_unit, product_family, order_status,
       priority_tier, CAST(total_value AS DOUBLE) AS total_value, currency, atp_feasible,
       {_iso('created_at')} AS created_at, {_iso('updated_at')} AS updated_at,
       {_iso('expected_ship_date')} AS expected_ship_date, line_count,
       CASE WHEN shipped IS NOT NULL
            THEN (['FedEx', 'UPS', 'DHL', 'Amazon Logistics'])[o_orderkey % 4 + 1] END AS shipment_carrier,
       CASE WHEN shipped IS NOT NULL THEN 'SHIPPED' END AS shipment_status,
       {_iso('shipped')} AS shipment_ship_date
FROM st LEFT JOIN ship ON st.o_orderkey = ship.l_orderkey"""
STAR_EVENTS = """ev AS (
  SELECT 'orders' AS source_table, o_orderkey AS k, o_orderdate::TIMESTAMP AS ts FROM orders
  UNION ALL SELECT 'order_line_items', l_orderkey, l_shipdate::TIMESTAMP FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'allocation_records', l_orderkey, l_shipdate::TIMESTAMP FROM lineitem
    WHERE l_linestatus = 'F' AND l_orderkey IN (SELECT o_orderkey FROM orders)
  UNION ALL SELECT 'shipments', l_orderkey, l_shipdate::TIMESTAMP FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F')"""
ORACLE["stream_topic_routing"] = f"""WITH {STAR_EVENTS}
SELECT source_table AS topic, count(*) AS events, count(DISTINCT k) AS orders FROM ev GROUP BY source_table"""
ORACLE["stream_table_windows"] = f"""WITH {STAR_EVENTS},
w AS (SELECT source_table, make_timestamp(epoch_us(ts) // 2592000000000 * 2592000000000) AS window_start, count(*) AS events FROM ev GROUP BY ALL),
slow AS (SELECT min(m) - INTERVAL 30 SECOND AS wm FROM (SELECT max(ts) AS m FROM ev GROUP BY source_table))
SELECT source_table, window_start, window_start + INTERVAL 30 DAY AS window_end, events
FROM w WHERE window_start + INTERVAL 30 DAY <= (SELECT wm FROM slow)"""


def _supply_round(k: int) -> str:
    inv = INV.replace("FROM lineitem)", f"FROM lineitem WHERE l_orderkey % 3 <= {k})")
    return f"""SELECT * FROM (WITH {inv}
SELECT CAST(l.l_orderkey AS VARCHAR) AS order_id, CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS line_id,
       CAST(l.l_partkey AS VARCHAR) AS sku, CAST(l.l_quantity AS DOUBLE) AS quantity, CAST(sup.available_qty AS DOUBLE) AS available_qty,
       {k}::BIGINT AS position_version, coalesce(sup.available_qty, 0) >= l.l_quantity AS atp_feasible
FROM lineitem l LEFT JOIN sup ON CAST(l.l_partkey AS VARCHAR) = sup.sku WHERE l.l_orderkey % 3 = {k})"""


ORACLE["stream_order_supply"] = " UNION ALL ".join(_supply_round(k) for k in range(3))
WINDOWS_MULTI = RECORDS + ",\n" + ",\n".join(window_select(*w) for w in (
    (60, 5, "sliding_1h", "m1"), (24 * 60, 60, "sliding_24h", "m2"), (24 * 60, 24 * 60, "tumbling_daily", "m3")))
ORACLE["stream_windows_multi"] = f"""WITH {WINDOWS_MULTI},
m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT * FROM m3)
SELECT * FROM m WHERE window_end <= (SELECT max(ts) FROM rec) - INTERVAL 30 SECOND"""
_SETTLED = "window_end <= (SELECT max(ts) FROM rec) - INTERVAL 30 SECOND AND (order_count > 0 OR available_supply > 0)"
ORACLE["stream_late_side_output"] = f"""WITH {WINDOWS_MULTI}
SELECT bu, product_family, horizon, window_start, round(unfulfilled_demand, 2) AS unfulfilled_demand,
       round(available_supply, 2) AS available_supply, order_count FROM m3 WHERE {_SETTLED}"""
ORACLE["stream_batch_reconciliation"] = f"""WITH {WINDOWS_MULTI}
SELECT bu, product_family, horizon, window_start, round(available_supply, 2) AS batch_supply,
       0.0::DOUBLE AS unexplained_demand, 0.0::DOUBLE AS unexplained_supply, 0::BIGINT AS unexplained_count FROM m1 WHERE {_SETTLED}"""
ORACLE["stream_fold_metrics"] = f"""WITH {STREAM_CHG}
SELECT count(*) AS events, 4::BIGINT AS batches, count(*) AS rows_written FROM chg"""

# adapter B with line demand
DEMAND_CHG = CHG + """,
dem AS (
  SELECT order_id, ts, lsn + 1000000000000 AS lsn, order_id || '-' || CAST(k % 5 AS VARCHAR) AS line_id,
         CAST(k % 4 AS DECIMAL(15,3)) AS quantity FROM chg WHERE k % 3 = 0),
chgd AS (
  SELECT order_id, source_table, op, ts, lsn, order_status, business_unit, product_family, priority_tier, total_value,
         expected_ship_date, has_bu, op <> 'd' AS hdr, CAST(0 AS DECIMAL(15,3)) AS d FROM chg
  UNION ALL
  SELECT order_id, 'order_line_items', 'u', ts, lsn, NULL, NULL, NULL, NULL, NULL, NULL, FALSE, FALSE,
         quantity - coalesce(lag(quantity) OVER (PARTITION BY order_id, line_id ORDER BY ts, lsn), 0) FROM dem)"""
DEMAND_CHANGELOG = DEMAND_CHG + CHANGELOG[len(CHG):].replace("op <> 'd'", "hdr").replace("FROM chg\n", "FROM chgd\n").replace(
    "AS updated_at\n", "AS updated_at,\n    sum(d) OVER w AS total_demand\n")
_ATP = "('ALLOCATED', 'IN_PRODUCTION', 'SHIPPED', 'DELIVERED')"
ORACLE["backlog_supply_1h"] = f"""WITH {DEMAND_CHANGELOG + RECORDS[len(CHANGELOG):].replace(
    "TRUE AS atp_feasible", f"(total_demand = 0 OR order_status IN {_ATP}) AS atp_feasible")},
{window_select(60, 5, "sliding_1h", "ms")}
SELECT * FROM ms"""
ORACLE["order_state_demand"] = f"""WITH {DEMAND_CHANGELOG},
last AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY ts DESC, lsn DESC) = 1),
n AS (SELECT order_id, count(DISTINCT line_id) AS line_count FROM dem GROUP BY order_id)
SELECT order_id, order_status, coalesce(line_count, 0) AS line_count, CAST(total_demand AS DOUBLE) AS total_demand,
       (total_demand = 0 OR order_status IN {_ATP}) AS atp_feasible, created_at, updated_at
FROM last LEFT JOIN n USING (order_id)"""
