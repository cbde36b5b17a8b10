"""Skew-safe running (prefix) scans.

A running value over an ordered key — "latest value so far", "first value",
"maximum so far", "count so far" — is normally a window partitioned by the
key, which puts a hot key (or a global order with no key at all) into one
task. ``segmented_scan_multi`` splits each key into ordered *segments* (e.g.
hours of event time) and computes the prefix in two levels:

1. inside each (key, segment): the local running value (a window whose
   partitions are segments, so many tasks share a hot key);
2. per (key, segment): the segment's final value — one aggregate row per
   segment — then a running value over segments (small: one row per
   segment, bounded by time span / segment width, not by data volume);
3. the carry-in from earlier segments is joined back and combined with the
   local value.

The result equals the single-window scan exactly. Cost: the carry pass
evaluates the input a second time with only the key, segment, order and
value columns, reduced map-side to one row per segment before its shuffle.
Upstream work of the input (e.g. an LSN-dedup shuffle) is repeated for those
columns; write the input to the shared checkpoint folder first when that
upstream is expensive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _local(how: str, c: str, w):
    return {"last": lambda: F.last(c, ignorenulls=True).over(w),
            "first": lambda: F.first(c, ignorenulls=True).over(w),
            "max": lambda: F.max(c).over(w),
            "sum": lambda: F.sum(c).over(w)}[how]()


def _seg_final(how: str, c: str, order: list[str]):
    nn = F.when(F.col(c).isNotNull(), F.struct(*order))
    return {"last": lambda: F.max_by(F.col(c), nn),
            "first": lambda: F.min_by(F.col(c), nn),
            "max": lambda: F.max(c),
            "sum": lambda: F.sum(c)}[how]()


def _combine(how: str, local: Column, carry: Column) -> Column:
    return {"last": lambda: F.coalesce(local, carry),
            "first": lambda: F.coalesce(carry, local),
            "max": lambda: F.greatest(local, carry),
            "sum": lambda: F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))}[how]()


def segmented_scan_multi(df: DataFrame, keys: list[str], segment: Column, order: list[str],
                         specs: list[tuple[str, Column, str]],
                         inclusive: bool = True) -> DataFrame:
    """Add one output column per ``(out, value, how)`` in ``specs``:
    the running ``how`` ('last'/'first' non-null, 'max', 'sum') of ``value``
    per ``keys`` in ``order``. ``segment`` must be non-decreasing in
    ``order`` within a key; ``inclusive=False`` excludes the current row."""
    # one struct as the key: it equals another also where fields are null, and the
    # window, the aggregate and the join share its partitioning
    d = df.withColumn("_key", F.struct(*[F.col(k) for k in keys], segment.alias("_seg")))
    for i, (_o, val, _h) in enumerate(specs):
        d = d.withColumn(f"_v{i}", val)
    hi = Window.currentRow if inclusive else -1
    w_local = (Window.partitionBy("_key").orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, hi))
    for i, (_o, _v, how) in enumerate(specs):
        d = d.withColumn(f"_l{i}", _local(how, f"_v{i}", w_local))
    segs = d.groupBy("_key").agg(
        *[_seg_final(how, f"_v{i}", order).alias(f"_f{i}") for i, (_o, _v, how) in
          enumerate(specs)])
    w_seg = (Window.partitionBy(*[f"_key.{k}" for k in keys]).orderBy("_key._seg")
             .rowsBetween(Window.unboundedPreceding, -1))
    carry_fn = {"last": lambda c: F.last(c, ignorenulls=True), "first":
                lambda c: F.first(c, ignorenulls=True), "max": F.max, "sum": F.sum}
    carry = segs.select("_key", *[carry_fn[how](f"_f{i}").over(w_seg).alias(f"_c{i}")
                                  for i, (_o, _v, how) in enumerate(specs)])
    res = d.join(carry, "_key", "left")
    for i, (out, _v, how) in enumerate(specs):
        res = res.withColumn(out, _combine(how, F.col(f"_l{i}"), F.col(f"_c{i}")))
    drop = ["_key"] + [f"_{p}{i}" for i in range(len(specs)) for p in "vlc"]
    return res.drop(*drop)


def segmented_scan(df: DataFrame, keys: list[str], segment: Column, order: list[str],
                   value: Column, how: str, out: str, inclusive: bool = True) -> DataFrame:
    """Single-column form of ``segmented_scan_multi``."""
    return segmented_scan_multi(df, keys, segment, order, [(out, value, how)], inclusive)
