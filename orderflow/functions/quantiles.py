"""Exact continuous quantiles without gathering a group's values in one place.

``F.percentile`` keeps every distinct value of a group in one aggregation
buffer, and a window over a group puts them in one task. Here the values are
first reduced to ``(group, value, count)`` (partial aggregation, shuffled on
group *and* value). A bounded sketch cuts each group into value ranges of about
equal numbers of distinct values; counts per range give how many values lie
before it, and the cumulative counts inside a range are a window over (group,
range). The sketch only deals the work, so its error doesn't touch the result.
The two ranks around ``p * (n - 1)`` are picked and linearly interpolated:
the same definition as ``percentile`` / ``quantile_cont``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: value ranges of a group: its distinct values are dealt over this many tasks
RANGES = 64
SKETCH_ACCURACY = 1000


def _same(keys: list[str], prefix: str) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(prefix + k)) for k in keys], F.lit(True))


def _renamed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: prefix + k for k in keys})


def exact_quantiles(df: DataFrame, groups: list[str], value: Column,
                    probs: dict[str, float]) -> DataFrame:
    """One row per group: ``n`` (non-null values) and one column per
    ``name -> p`` in ``probs``. A null group is a group."""
    v = (df.where(value.isNotNull())
         .groupBy(*groups, value.cast("double").alias("_x"))
         .agg(F.count(F.lit(1)).alias("_c")))
    cuts = v.groupBy(*groups).agg(F.percentile_approx(
        "_x", [i / RANGES for i in range(1, RANGES)], SKETCH_ACCURACY).alias("_cuts"))
    above = F.size(F.filter("_cuts", lambda c: c < F.col("_x")))
    v = (v.join(_renamed(cuts, groups, "_g_"), _same(groups, "_g_"))
         .select(*groups, "_x", "_c", above.alias("_r")))
    # one row per group and range
    ahead = (Window.partitionBy(*groups).orderBy("_r")
             .rowsBetween(Window.unboundedPreceding, -1))
    ranges = (v.groupBy(*groups, "_r").agg(F.sum("_c").alias("_in"))
              .select(*groups, "_r", F.coalesce(F.sum("_in").over(ahead), F.lit(0)).alias("_ahead"),
                      F.sum("_in").over(Window.partitionBy(*groups)).alias("_n")))
    inside = (Window.partitionBy(*groups, "_r").orderBy("_x")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    v = (v.withColumn("_run", F.sum("_c").over(inside))
         .join(_renamed(ranges, [*groups, "_r"], "_s_"), _same([*groups, "_r"], "_s_"))
         .withColumn("_cum", F.col("_ahead") + F.col("_run")))
    aggs = [F.max("_n").alias("n")]
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        lo, hi = F.floor(pos), F.ceil(pos)
        # value at 0-based rank r = smallest x whose cumulative count exceeds r
        aggs += [F.min(F.when(F.col("_cum") > lo, F.col("_x"))).alias(f"_lo_{name}"),
                 F.min(F.when(F.col("_cum") > hi, F.col("_x"))).alias(f"_hi_{name}"),
                 F.max(pos - lo).alias(f"_f_{name}")]
    g = v.groupBy(*groups).agg(*aggs)
    out = [*groups, "n"]
    for name in probs:
        lo_v, hi_v, f = F.col(f"_lo_{name}"), F.col(f"_hi_{name}"), F.col(f"_f_{name}")
        out.append(F.when(f == 0, lo_v).otherwise((F.lit(1.0) - f) * lo_v + f * hi_v)
                   .alias(name))
    return g.select(*out)
