"""Entity schemas and fixed domain values.

The values in the FIXED VALUES block must equal the source system's domain
for results to agree; they are stated once here, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the modelled order system exactly)
# ---------------------------------------------------------------------------
CDC_OPS = ["c", "u", "d", "r"]          # insert, update, delete, snapshot read
BUSINESS_UNITS = ["North America", "EMEA", "APAC", "Latin America"]
CHANNELS = ["Direct", "Distributor", "OEM", "eCommerce", "Partner"]
PRODUCT_FAMILIES = ["Networking", "Security", "Compute", "Storage", "Collaboration", "Software"]
ORDER_STATUSES = ["CREATED", "ALLOCATED", "IN_PRODUCTION", "SHIPPED", "DELIVERED", "CANCELLED"]
LEGAL_TRANSITIONS = [
    ("CREATED", "ALLOCATED"), ("CREATED", "CANCELLED"),
    ("ALLOCATED", "IN_PRODUCTION"), ("ALLOCATED", "CANCELLED"),
    ("IN_PRODUCTION", "SHIPPED"),
    ("SHIPPED", "DELIVERED"),
]
WAREHOUSES = ["WH-SJC", "WH-AMS", "WH-SIN", "WH-GRU"]
CARRIERS = ["FedEx", "UPS", "DHL", "Amazon Logistics"]
UNFULFILLED_STATUSES = ["CREATED", "ALLOCATED", "IN_PRODUCTION"]
ATP_STATUSES = ["ALLOCATED", "IN_PRODUCTION", "SHIPPED", "DELIVERED"]
SHIPPED_STATUSES = ["SHIPPED", "DELIVERED"]
HORIZON_LIMITS_DAYS = [("D1", 1), ("D7", 7), ("D30", 30)]   # else D90
HORIZONS = ["D1", "D7", "D30", "D90"]
PRIORITY_LABELS = ["P1-Critical", "P2-High", "P3-Medium", "P4-Low", "P5-Minimal"]
DEFAULT_STATUS = "CREATED"
DEFAULT_PRIORITY = 3
DEFAULT_CURRENCY = "USD"
DEFAULT_LINE_STATUS = "OPEN"
DEFAULT_ALLOCATION_STATUS = "ALLOCATED"
DEFAULT_SHIPMENT_STATUS = "PENDING"
HISTORY_SOURCE = "pipeline"
WATERMARK_DELAY = "30 seconds"
SLIDING_SIZE, SLIDING_SLIDE = "1 hour", "5 minutes"
TUMBLING_DAILY = "24 hours"
RETENTION_DAYS = {"order_state": 90, "backlog_metrics": 30, "fulfillment_metrics": 365,
                  "pipeline_event_log": 7}
PIPELINE_SOURCE = "debezium-postgres"      # static field of the unwrapped CDC record
SEARCH_PAGE_MAX = 200
BY_STATUS_LIMIT_MAX = 500
BACKLOG_SERIES_LIMIT = 100
FULFILLMENT_DAYS_LIMIT = 90
FACET_SIZES = {"order_status": 10, "business_unit": 20, "product_family": 20,
               "priority_tier": 10, "channel": 20}
SUMMARY_FAMILY_SIZE = 50
HOT_KEY_SHARE = 0.05
TOPICS = ["orders", "order_line_items", "allocation_records", "shipments"]   # one per table
# ---------------------------------------------------------------------------

MONEY = T.DecimalType(15, 2)
QTY = T.DecimalType(15, 3)

# Normalised change event: one row per CDC record, whichever wire shape it had.
CHANGE_EVENT = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("source_table", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("lsn", T.LongType()),
    T.StructField("before", T.MapType(T.StringType(), T.StringType())),
    T.StructField("after", T.MapType(T.StringType(), T.StringType())),
])

# JSON envelope as it arrives on the wire (row images stay dynamic maps).
ENVELOPE = T.StructType([
    T.StructField("op", T.StringType()),
    T.StructField("__table", T.StringType()),
    T.StructField("ts_ms", T.LongType()),
    T.StructField("lsn", T.LongType()),
    T.StructField("before", T.MapType(T.StringType(), T.StringType())),
    T.StructField("after", T.MapType(T.StringType(), T.StringType())),
])

LINE_ITEM = T.StructType([
    T.StructField("line_id", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("product_family", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("unit_price", T.DoubleType()),
    T.StructField("line_status", T.StringType()),
])

ALLOCATION = T.StructType([
    T.StructField("allocation_id", T.StringType()),
    T.StructField("sku", T.StringType()),
    T.StructField("warehouse_id", T.StringType()),
    T.StructField("allocated_qty", T.DoubleType()),
    T.StructField("status", T.StringType()),
])

SHIPMENT = T.StructType([
    T.StructField("shipment_id", T.StringType()),
    T.StructField("carrier", T.StringType()),
    T.StructField("tracking_number", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("ship_date", T.TimestampNTZType()),
    T.StructField("delivery_date", T.TimestampNTZType()),
])

STATUS_ENTRY = T.StructType([
    T.StructField("status", T.StringType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("source", T.StringType()),
])

ORDER_STATE = T.StructType([
    T.StructField("order_id", T.StringType()),
    T.StructField("customer_id", T.StringType()),
    T.StructField("customer_name", T.StringType()),
    T.StructField("channel", T.StringType()),
    T.StructField("business_unit", T.StringType()),
    T.StructField("product_family", T.StringType()),
    T.StructField("order_status", T.StringType()),
    T.StructField("priority_tier", T.IntegerType()),
    T.StructField("created_at", T.TimestampNTZType()),
    T.StructField("updated_at", T.TimestampNTZType()),
    T.StructField("total_value", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("line_items", T.ArrayType(LINE_ITEM)),
    T.StructField("allocation_records", T.ArrayType(ALLOCATION)),
    T.StructField("shipment_data", SHIPMENT),
    T.StructField("status_history", T.ArrayType(STATUS_ENTRY)),
    T.StructField("atp_feasible", T.BooleanType()),
    T.StructField("expected_ship_date", T.TimestampNTZType()),
])

# Header fields folded from `orders` change events: name -> (spark type, default).
HEADER_FIELDS = {
    "customer_id": ("string", ""),
    "customer_name": ("string", ""),
    "channel": ("string", ""),
    "business_unit": ("string", ""),
    "currency": ("string", DEFAULT_CURRENCY),
}
