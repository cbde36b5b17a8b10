"""Order search, facets, listings and calendar histograms (FLT-1..4, LIM-1/2/5/6,
AGG-4/4b/5/6/6b/13).

Search is a predicate, not a relevance ranking: results are ordered by
``updated_at`` desc with ``order_id`` as the tie-break, so relevance never
changes the output (the original sorts by date as well). Paging is a global
top-k (``TakeOrderedAndProject``): every partition keeps only its best
``offset + size`` rows before the merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orderflow import schemas as S
from orderflow.functions import expressions as X


def filter_orders(state: DataFrame, lines: DataFrame | None = None, q: str | None = None,
                  status: str | None = None, business_unit: str | None = None,
                  product_family: str | None = None, date_from: str | None = None,
                  date_to: str | None = None) -> DataFrame:
    """FLT-1..4: AND-ed optional term filters, inclusive date range on
    ``updated_at`` (a date-only upper bound covers that whole day) and an
    any-token full-text match over customer name, order id, and line
    description / SKU (nested lines are searched, Q9). No predicate = all."""
    df = state
    for col, val in (("order_status", status), ("business_unit", business_unit),
                     ("product_family", product_family)):
        if val:
            df = df.where(F.col(col) == F.lit(val))
    if date_from:
        df = df.where(F.col("updated_at") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to:
        hi = F.lit(date_to).cast("timestamp_ntz")
        if len(date_to) == 10:
            df = df.where(F.col("updated_at") < hi + F.expr("INTERVAL 1 DAY"))
        else:
            df = df.where(F.col("updated_at") <= hi)
    if q:
        qt = X.tokens(F.lit(q))
        header = F.arrays_overlap(X.tokens(F.col("customer_name")), qt) | \
            (F.col("order_id") == F.lit(q))
        if lines is not None:
            lm = (lines.where(F.arrays_overlap(X.tokens(F.col("description")), qt) |
                              (F.col("sku") == F.lit(q)))
                  .select(F.col("order_id").alias("_hit_id")).distinct())
            df = (df.join(lm, df.order_id == lm._hit_id, "left")
                  .where(header | F.col("_hit_id").isNotNull()).drop("_hit_id"))
        else:
            df = df.where(header)
    return df


def search_page(hits: DataFrame, page: int = 1, size: int = 20) -> DataFrame:
    """LIM-1: sort by recency, skip ``(page-1)*size``, take ``size`` (1..200)."""
    if page < 1 or not 1 <= size <= S.SEARCH_PAGE_MAX:
        raise ValueError(f"page must be 1 or more, size 1 to {S.SEARCH_PAGE_MAX}")
    start = (page - 1) * size
    top = hits.orderBy(F.desc("updated_at"), F.asc("order_id")).offset(start).limit(size)
    # numbering happens after the limit: at most `size` rows reach this window
    w = Window.orderBy(F.desc("updated_at"), F.asc("order_id"))
    return top.withColumn("position", (F.row_number().over(w) + F.lit(start)).cast("bigint"))


FACETS = list(S.FACET_SIZES)


def search_facets(hits: DataFrame) -> DataFrame:
    """AGG-4/4b/5: every facet and the exact hit count in one pass
    (``GROUPING SETS``, one Expand + one hash aggregate), then top-N buckets
    per facet by count with the key as tie-break."""
    df = hits.select(*[F.col(c).cast("string").alias(c) for c in FACETS])
    g = df.groupingSets([[c] for c in FACETS] + [[]], *FACETS).agg(
        F.count(F.lit(1)).alias("doc_count"), F.grouping_id().alias("gid"))
    n = len(FACETS)
    facet = F.lit("total")
    key = F.lit(None).cast("string")
    for i, c in enumerate(FACETS):
        gid = (1 << n) - 1 - (1 << (n - 1 - i))
        facet = F.when(F.col("gid") == gid, F.lit(c)).otherwise(facet)
        key = F.when(F.col("gid") == gid, F.col(c)).otherwise(key)
    g = g.select(facet.alias("facet"), key.alias("key"), "doc_count")
    rank = F.row_number().over(Window.partitionBy("facet")
                               .orderBy(F.desc("doc_count"), F.asc("key")))
    limit = F.lit(1)
    for c, s in S.FACET_SIZES.items():
        limit = F.when(F.col("facet") == c, F.lit(s)).otherwise(limit)
    return g.withColumn("rank", rank).where(F.col("rank") <= limit) \
        .withColumn("rank", F.col("rank").cast("bigint"))


def lookup(state: DataFrame, order_id: str, key_col: str = "o_orderkey") -> DataFrame:
    """LIM-6: point lookup. A numeric id filters the native key column so
    the predicate reaches the Parquet scan (row-group skipping)."""
    if key_col in state.columns and order_id.isdigit():
        return state.where(F.col(key_col) == F.lit(int(order_id))).limit(1)
    return state.where(F.col("order_id") == F.lit(order_id)).limit(1)


def orders_by_status(state: DataFrame, business_unit: str, status: str,
                     limit: int = 100) -> DataFrame:
    """LIM-2: newest orders of one (bu, status), current status only (Q10)."""
    if not 1 <= limit <= S.BY_STATUS_LIMIT_MAX:
        raise ValueError(f"limit must be 1 to {S.BY_STATUS_LIMIT_MAX}")
    return (state.where((F.col("business_unit") == business_unit) &
                        (F.col("order_status") == status))
            .select("order_id", "order_status", "updated_at", "customer_name", "product_family",
                    "priority_tier", X.money_out(F.col("total_value")).alias("total_value"))
            .orderBy(F.desc("updated_at"), F.asc("order_id")).limit(limit))


UNIT_STEP = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS"}


def calendar_histogram(df: DataFrame, ts_col: str, unit: str,
                       measures: dict[str, object]) -> DataFrame:
    """AGG-6: ``date_trunc`` buckets with empty buckets filled between the
    first and last non-empty one (count 0). The bucket range is generated
    from one aggregate row — its size depends on the time span, not on the
    data volume."""
    b = F.date_trunc(unit, F.col(ts_col)).cast("timestamp_ntz")
    counts = df.groupBy(b.alias("bucket")).agg(*[m.alias(n) for n, m in measures.items()])
    rng = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    grid = rng.select(F.explode(F.sequence("lo", "hi", F.expr(UNIT_STEP[unit])))
                      .alias("bucket"))
    j = grid.join(counts, "bucket", "left")
    return j.select("bucket", *[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in measures])


def trailing_rate(daily: DataFrame, count_col: str, days: int = 7) -> DataFrame:
    """AGG-13: trailing ``days``-bucket average of a gap-filled series. The
    window runs over the bucket series (one row per day), not over events."""
    w = Window.orderBy("bucket").rowsBetween(-(days - 1), 0)
    return daily.withColumn(f"avg_{days}d", X.ratio(F.avg(count_col).over(w)))


def iso(col: str):
    """ISO text of a timestamp column (see ``expressions.ts_to_iso``)."""
    return X.ts_to_iso(F.col(col))



def status_listing_as_coded(changelog: DataFrame) -> DataFrame:
    """Q10 as coded: the (bu, status) listing is insert-only, one row per
    emitted state keyed by (bu, status, updated_at, order_id) — an order
    shows under every status it ever had. A later write to the same key
    overwrites it (latest by event order). Requires non-empty bu and status."""
    rows = changelog.where((F.col("business_unit") != "") & (F.col("order_status") != ""))
    key = ["business_unit", "order_status", "updated_at", "order_id"]
    vals = ["customer_name", "product_family", "priority_tier", "total_value"]
    return (rows.groupBy(*key)
            .agg(F.max_by(F.struct(*vals), F.struct("ts", "lsn")).alias("v"))
            .select(*key, "v.*"))
