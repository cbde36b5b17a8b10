"""Change-data-capture parsing and normalisation (PRJ-1..5, SET-1, STR-5, SNK-9).

Two wire shapes are accepted (Q1) and normalised to ``schemas.CHANGE_EVENT``:

* envelope: ``{"op","__table","ts_ms","lsn","before":{..},"after":{..}}``
* unwrapped: flat row columns plus ``__op,__table,__lsn,__source_ts_ms``;
  deletes carry ``__deleted = "true"``.

Row images stay ``map<string,string>`` so unknown columns are tolerated and
a missing key is distinguishable from a null value. Parsing is ``from_json``
(JVM-side); rejects are kept with a reason for the dead-letter output, never
silently dropped. Every function works on batch and streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderflow import schemas as S
from orderflow.functions import expressions as X

CORRUPT = "_corrupt"
_ENVELOPE_PARSE = T.StructType(S.ENVELOPE.fields + [T.StructField(CORRUPT, T.StringType())])
_MAP = T.MapType(T.StringType(), T.StringType())
META_KEYS = ["__op", "__table", "__lsn", "__source_ts_ms", "__deleted", "pipeline_source"]


def _reason(op: Column, table: Column, ts_ms: Column, malformed: Column) -> Column:
    return (F.when(malformed, F.lit("malformed_json"))
            .when(op.isNull() | table.isNull() | ts_ms.isNull(), F.lit("missing_field"))
            .when(~op.isin(*S.CDC_OPS), F.lit("invalid_op")))


def _normalise(j: DataFrame, order_key: str = "order_id") -> DataFrame:
    image = F.coalesce(F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after")),
                       F.create_map().cast(_MAP))
    return j.select(
        image[order_key].alias("order_id"),
        F.col("source_table"), F.col("op"),
        X.ms_to_ts(F.col("ts_ms")).alias("ts"),
        F.col("lsn"), F.col("before"), F.col("after"),
        F.col("reject_reason"), F.col("payload"))


def parse_envelope(raw: DataFrame, value: str = "value") -> DataFrame:
    """PRJ-1: parse envelope JSON; invalid rows get ``reject_reason``. A line is
    parsed once: a filter is not moved below the ``explode``, where it would
    parse the line again for each field it asks for."""
    j = raw.select(F.col(value).alias("payload"),
                   F.explode(F.array(F.from_json(F.col(value), _ENVELOPE_PARSE,
                                                 {"mode": "PERMISSIVE",
                                                  "columnNameOfCorruptRecord": CORRUPT}))).alias("j"))
    malformed = F.col(f"j.{CORRUPT}").isNotNull() | F.col("j").isNull()
    j = j.select("payload", F.col("j.op").alias("op"), F.col("j.__table").alias("source_table"),
                 F.col("j.ts_ms").alias("ts_ms"), F.col("j.lsn").alias("lsn"),
                 F.col("j.before").alias("before"), F.col("j.after").alias("after"),
                 _reason(F.col("j.op"), F.col("j.__table"), F.col("j.ts_ms"), malformed)
                 .alias("reject_reason"))
    return _normalise(j)


def parse_unwrapped(raw: DataFrame, value: str = "value") -> DataFrame:
    """PRJ-4: flat record with ``__`` metadata -> envelope shape."""
    m = F.from_json(F.col(value), _MAP)
    j = raw.select(F.col(value).alias("payload"), m.alias("m"))
    mm = F.col("m")
    image = F.map_filter(mm, lambda k, v: ~k.isin(*META_KEYS))
    deleted = (mm["__deleted"] == "true") | (mm["__op"] == "d")
    op = mm["__op"]
    ts_ms = mm["__source_ts_ms"].try_cast("bigint")
    j = j.select(
        "payload", op.alias("op"), mm["__table"].alias("source_table"),
        ts_ms.alias("ts_ms"), mm["__lsn"].try_cast("bigint").alias("lsn"),
        F.when(deleted, image).alias("before"),
        F.when(~deleted, image).alias("after"),
        _reason(op, mm["__table"], ts_ms, mm.isNull()).alias("reject_reason"))
    return _normalise(j)


def valid(parsed: DataFrame) -> DataFrame:
    """PRJ-2: accepted events in CHANGE_EVENT shape."""
    return parsed.where(F.col("reject_reason").isNull()).select(*S.CHANGE_EVENT.fieldNames())


def dead_letters(parsed: DataFrame, source_topic: str) -> DataFrame:
    """SNK-9: rejected payloads with reason and topic."""
    return parsed.where(F.col("reject_reason").isNotNull()).select(
        F.col("payload"), F.col("reject_reason").alias("reason"),
        F.lit(source_topic).alias("source_topic"))


def union_changes(*streams: DataFrame) -> DataFrame:
    """SET-1: bag union of normalised streams (by name)."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def row_pk(table: Column, image: Column) -> Column:
    """Primary key of the changed row inside its table (Q11)."""
    return (F.when(table == "order_line_items", image["line_id"])
            .when(table == "allocation_records", image["allocation_id"])
            .when(table == "shipments", image["shipment_id"])
            .when(table == "inventory", F.concat_ws("|", image["sku"], image["warehouse_id"]))
            .otherwise(image["order_id"]))


def dedup_lsn(changes: DataFrame, strict: bool = False) -> DataFrame:
    """STR-5 (batch): drop repeated LSNs; null or 0 LSN is never deduplicated.

    Default key ``(order_id, source_table, row pk, lsn)`` keeps snapshot rows
    that share an LSN (Q11); ``strict=True`` keys on ``(order_id, lsn)`` only.
    Duplicates are copies; the earliest by ``ts`` survives. One scan and one
    shuffle on the full key (so even a hot order spreads over many tasks);
    rows without a usable LSN pass through the same plan untouched.
    """
    image = F.coalesce(F.when(F.col("op") == "d", F.col("before")).otherwise(F.col("after")),
                       F.create_map().cast(_MAP))
    keyed = F.col("lsn").isNotNull() & (F.col("lsn") != 0)
    key = ["order_id", "lsn"] if strict else ["order_id", "source_table", "_pk", "lsn"]
    rn = F.row_number().over(Window.partitionBy(*key).orderBy("ts"))
    return (changes.withColumn("_pk", row_pk(F.col("source_table"), image))
            .withColumn("_rn", F.when(keyed, rn).otherwise(F.lit(1)))
            .where(F.col("_rn") == 1).drop("_pk", "_rn"))


def snapshot_as_changes(df: DataFrame, table: str, order_id: Column, ts: Column,
                        columns: list[str] | None = None) -> DataFrame:
    """SRC-4: a batch table read as initial-snapshot change rows (``op='r'``),
    its columns as the string row image, ready to ``union_changes`` with the
    live stream."""
    cols = columns or df.columns
    kv = []
    for c in cols:
        kv += [F.lit(c), F.col(c).cast("string")]
    return df.select(order_id.alias("order_id"), F.lit(table).alias("source_table"),
                     F.lit("r").alias("op"), ts.cast("timestamp_ntz").alias("ts"),
                     F.lit(None).cast("bigint").alias("lsn"),
                     F.lit(None).cast(_MAP).alias("before"),
                     F.create_map(*kv).alias("after"))
