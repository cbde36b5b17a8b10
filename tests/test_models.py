"""The source system's model cases, re-expressed on DataFrames: op codes,
row images, JSON parsing, defaults, nested children, storage rows, ISO
timestamps and history appends."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.operators import cdc as CDC
from orderflow.operators import state as ST
from orderflow.functions import expressions as X

ENV = ('{"op":"%s","__table":"orders","ts_ms":1700000000000,'
       '"before":%s,"after":%s}')


def _parse(spark, lines):
    raw = spark.createDataFrame([(v,) for v in lines], "value string")
    return CDC.parse_envelope(raw)


def test_op_codes():
    assert S.CDC_OPS == ["c", "u", "d", "r"]


def test_insert_update_snapshot_image_is_after(spark):
    p = _parse(spark, [ENV % ("c", "null", '{"order_id":"ORD-001","status":"CREATED"}'),
                       ENV % ("u", '{"status":"CREATED"}', '{"order_id":"ORD-001","status":"SHIPPED"}'),
                       ENV % ("r", "null", '{"order_id":"ORD-002"}')])
    rows = ST.row_image(CDC.valid(p)).orderBy("op").collect()
    assert rows[0]["row"] == {"order_id": "ORD-001", "status": "CREATED"}
    assert rows[1]["row"]["order_id"] == "ORD-002"
    assert rows[2]["row"]["status"] == "SHIPPED"


def test_delete_image_is_before(spark):
    p = _parse(spark, [ENV % ("d", '{"order_id":"ORD-999"}', "null")])
    r = ST.row_image(CDC.valid(p)).collect()[0]
    assert r["row"] == {"order_id": "ORD-999"} and r["order_id"] == "ORD-999"


def test_missing_images_give_empty_row(spark):
    p = _parse(spark, [ENV % ("c", "null", "null")])
    assert ST.row_image(CDC.valid(p)).collect()[0]["row"] == {}


def test_parse_from_bytes(spark):
    raw = spark.createDataFrame([(bytearray((ENV % ("c", "null", '{"order_id":"A"}')).encode()),)],
                                "value binary").select(F.col("value").cast("string").alias("value"))
    assert CDC.valid(CDC.parse_envelope(raw)).collect()[0]["order_id"] == "A"


def test_lsn_defaults_to_null(spark):
    p = _parse(spark, [ENV % ("c", "null", '{"order_id":"A"}')])
    assert CDC.valid(p).collect()[0]["lsn"] is None


def test_rejects_are_classified(spark):
    p = _parse(spark, ['{"op":"c",', '{"op":"x","__table":"orders","ts_ms":1}',
                       '{"op":"c","ts_ms":1}'])
    reasons = sorted(r["reason"] for r in CDC.dead_letters(p, "t").collect())
    assert reasons == ["invalid_op", "malformed_json", "missing_field"]


def test_unwrapped_form_matches_envelope(spark):
    raw = spark.createDataFrame(
        [('{"order_id":"A","order_status":"SHIPPED","__op":"u","__table":"orders",'
          '"__lsn":"7","__source_ts_ms":"1700000000000","__deleted":"false",'
          '"pipeline_source":"debezium-postgres"}',),
         ('{"order_id":"B","__op":"d","__table":"orders","__lsn":"8",'
          '"__source_ts_ms":"1700000000000","__deleted":"true"}',)], "value string")
    rows = {r["order_id"]: r for r in CDC.valid(CDC.parse_unwrapped(raw)).collect()}
    assert rows["A"]["after"] == {"order_id": "A", "order_status": "SHIPPED"}
    assert rows["A"]["lsn"] == 7 and rows["B"]["op"] == "d"
    assert rows["B"]["before"] == {"order_id": "B"} and rows["B"]["after"] is None


def test_order_defaults_without_header_events(spark):
    ch = spark.createDataFrame(
        [Row(order_id="O1", source_table="order_line_items", op="c", ts=None, lsn=1,
             before=None, after={"line_id": "L1"})], S.CHANGE_EVENT)
    st = ST.fold_orders(ch).collect()[0]
    assert (st["order_status"], st["priority_tier"], st["currency"], st["business_unit"]) == \
        ("CREATED", 3, "USD", "")
    assert float(st["total_value"]) == 0.0 and st["created_at"] is None


def test_atp_zero_demand_is_feasible(spark):
    df = spark.createDataFrame([("CREATED", 0.0), ("CREATED", 5.0), ("SHIPPED", 5.0)],
                               "s string, d double")
    got = [r[0] for r in df.select(ST.atp_by_status(F.col("s"), F.col("d"))).collect()]
    assert got == [True, False, True]


def test_iso_timestamps_carry_utc_offset(spark):
    df = spark.createDataFrame([(1700000000000,)], "ms long")
    v = df.select(X.ts_to_iso(X.ms_to_ts(F.col("ms")))).collect()[0][0]
    assert v == "2023-11-14T22:13:20+00:00"
    df = spark.createDataFrame([(1700000000640,)], "ms long")
    assert df.select(X.ts_to_iso(X.ms_to_ts(F.col("ms")))).collect()[0][0] == \
        "2023-11-14T22:13:20.640000+00:00"


def test_horizon_buckets(spark):
    df = spark.sql("""SELECT * FROM VALUES
        (NULL), (TIMESTAMP_NTZ'2024-01-30 00:00:00'), (TIMESTAMP_NTZ'2024-02-01 00:00:00'),
        (TIMESTAMP_NTZ'2024-02-05 00:00:00'), (TIMESTAMP_NTZ'2024-02-20 00:00:00'),
        (TIMESTAMP_NTZ'2024-04-20 00:00:00') AS t(esd)""")
    as_of = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    got = [r[0] for r in df.select(X.classify_horizon(F.col("esd"), as_of)).collect()]
    assert got == ["D90", "D1", "D1", "D7", "D30", "D90"]


def test_priority_labels(spark):
    df = spark.createDataFrame([(1,), (5,), (7,)], "t int")
    assert [r[0] for r in df.select(X.priority_label(F.col("t"))).collect()] == \
        ["P1-Critical", "P5-Minimal", "P7"]


def test_route_by_topic(spark):
    from orderflow.streaming.sources import route_by_topic
    df = spark.createDataFrame([("orders.enriched", "a"), ("backlog.metrics", "b"),
                                ("orders.enriched", "c")], "topic string, value string")
    r = route_by_topic(df, ["orders.enriched", "backlog.metrics"])
    assert sorted(x[0] for x in r["orders.enriched"].collect()) == ["a", "c"]
    assert [x[0] for x in r["backlog.metrics"].collect()] == ["b"]
