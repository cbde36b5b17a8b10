"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every document of a source, in shuffled order, is a packet whose virtual finish
time is the cumulative size of its source divided by the source's target. The
packets of all sources are sorted by finish time and the queue is truncated at
the total budget. A source whose target exceeds its size sends its documents
again, in the same order, up to ``max_repeats`` times.

Nothing needs one source in one task: a source's cumulative sizes come from
(source, segment) sums plus a window inside each segment, and the point of
truncation from histograms of the finish times, refined until the rows that
still compete for the rest of the budget are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.common import WORD, apart, cut, text_of

#: Bins of one histogram of finish times, and rows that one window may order.
BINS, RACE_ROWS = 4096, 50_000


def word_count() -> Column:
    return F.regexp_count(text_of(), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeats: int) -> DataFrame:
    """(source, source_size, target) from rows of (source, size): water filling.

    Sources by code point, null last, weigh ``weights`` in turn. Targets share the
    total by weight; one over ``max_repeats`` times its source stops there and the
    excess is shared again. Sorted by limit/weight, the saturated sources come first,
    so one running sum finds the level that the others get.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((rank - 1) % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", w.alias("w"), (F.col("source_size") * float(max_repeats)).alias("most"))
    # one row a source; ties in most/w are broken by source, so reruns agree
    upto = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    per = per.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
                         / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    per = per.withColumn("full", F.col("most") <= F.col("w") * F.col("level"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return per.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * level).alias("target"))


def fair_mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), max_repeats: int = 3, seed: str = "mix",
             segment_digits: int = 3, size: Column | None = None) -> DataFrame:
    """``docs`` (doc_id, source, text, ...) with size, source_size, target, copies and taken.

    ``copies`` is how often the mix takes the document (0 to ``max_repeats``) and
    ``taken`` = copies * size. The shuffle is the md5 of seed and doc_id. A null
    source is a source of its own, last; a null doc_id sorts as the smallest; a null
    or empty text has size 0 and is never taken; repeated rows are separate packets
    in an arbitrary order among equals. An empty table gives an empty result. Input
    columns called as the added ones are replaced.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    added = ["size", "source_size", "target", "copies", "taken"]
    sized = docs.withColumn("size", size if size is not None else word_count())
    packets, back = apart(sized, {"doc_id", "source", "text", "size"}, set(added) - {"size"})
    packets = packets.withColumns({"_key": key,
                                "_seg": F.substring(key, 1, segment_digits), "_src": F.col("source")})
    narrow = cut(packets.select(F.col("_src").alias("source"), "_seg", "_key", "doc_id", "size"))
    targets = cut(source_targets(narrow, weights, max_repeats))
    seg = narrow.groupBy("source", "_seg").agg(F.sum("size").alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    seg = cut(seg.join(targets, seg["source"].eqNullSafe(targets["source"])).drop(targets["source"])
              .withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)))
              .select(F.col("source").alias("_src"), F.col("_seg").alias("_sg"), "_ahead", "source_size", "target"))

    def queued(rows: DataFrame) -> DataFrame:
        """Rows with _src, _seg, _key and size, with their cumulative size in their source."""
        rows = rows.drop("source_size", "target", "copies", "taken")
        # two keys that are never null, so the join finds the rows where the window left them
        keys = [F.col("_src").isNull(), F.coalesce(F.col("_src").cast("string"), F.lit(""))]
        ahead = seg.select(keys[0].alias("_a0"), keys[1].alias("_a1"), "_sg", "_ahead", "source_size", "target")
        rows = rows.withColumns({"_k0": keys[0], "_k1": keys[1]})
        inside = Window.partitionBy("_k0", "_k1", "_seg").orderBy("_key", F.col("doc_id").asc_nulls_first(), "size")
        return (rows.withColumn("_in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
                .join(ahead, (F.col("_k0") == F.col("_a0")) & (F.col("_k1") == F.col("_a1")) & (F.col("_seg") == F.col("_sg")))
                .withColumn("_cum", F.col("_ahead") + F.col("_in")).drop("_k0", "_k1", "_a0", "_a1", "_sg", "_ahead", "_in"))

    def finish(epoch) -> Column:
        return (F.col("_cum") + epoch * F.col("source_size")) / F.col("target")

    sent = (queued(narrow.withColumn("_src", F.col("source"))).where("size > 0")
            .withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1)))).withColumn("_f", finish(F.col("_epoch"))))
    sent = cut(sent.select("_f", "_src", "_epoch", "_key", "doc_id", "size"))
    budget = narrow.agg(F.sum("size")).first()[0] or 0
    lo, width, used, last = 0.0, 4.0 / BINS, 0, None
    # the bin in which the budget ends; the last bin is open to the right
    while True:
        bin_ = F.least(F.floor((F.col("_f") - lo) / width), F.lit(BINS)).cast("int")
        counted = sorted(tuple(r) for r in sent.groupBy(bin_.alias("b")).agg(F.sum("size"), F.count(F.lit(1))).collect())
        end = None
        for b, words, rows in counted:
            if used + words > budget:
                end = (b, rows)
                break
            used += words
        if end is None:
            break
        sent = sent.where(bin_ == end[0])
        if end[1] <= RACE_ROWS or end[0] == BINS or width < 1e-12:
            order = Window.orderBy("_f", F.col("_src").asc_nulls_last(), "_epoch", "_key", F.col("doc_id").asc_nulls_first())
            race = sent.withColumn("_run", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
            last = race.where(F.col("_run") > budget - used).orderBy("_run").select("_f", "_src", "_epoch", "_key", "doc_id").first()
            break
        lo, width = lo + end[0] * width, width / BINS
    takes = []
    for epoch in range(max_repeats):
        if last is None:
            take = F.lit(True)
        else:  # strictly before the first packet that no longer fits
            f, (lf, ls, le, lk, ld) = finish(F.lit(epoch)), last
            take = f < lf
            tie = F.lit(epoch) < le
            same = (F.col("_key") < lk) | ((F.col("_key") == lk) & (F.col("doc_id").isNull() & F.lit(ld is not None) | F.coalesce(F.col("doc_id") < ld, F.lit(False))))
            tie = tie | ((F.lit(epoch) == le) & same)
            earlier = F.col("_src").isNotNull() if ls is None else F.coalesce(F.col("_src") < ls, F.lit(False))
            take = take | ((f == lf) & (earlier | (F.col("_src").eqNullSafe(F.lit(ls)) & tie)))
        takes.append(F.when((F.col("size") > 0) & take, 1).otherwise(0))
    out = queued(packets).withColumn("copies", sum(takes[1:], takes[0])).withColumn("taken", F.col("copies") * F.col("size"))
    return back(out, *[F.col(c) for c in added[1:]])
