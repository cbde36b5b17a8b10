"""Sharding by histogram sort (DataFrame functions only).

Rows are ordered by a 63-bit key: 39 bits of the text's hash, then 24 bits of the
doc_id's, so copies lie side by side and a huge group of copies can still be cut.
Splitters are found without sorting: each round counts exact bytes (and rows) below
evenly spaced probes inside the intervals that still hold a splitter, until a
probe meets the tolerance. Then the rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderflow.llm.common import apart, cut, text_of

#: Low bits that are left of the key after each round of probes; copies of a text agree above DOC_BITS.
ROUNDS = (53, 43, 33, 24, 12, 0)
DOC_BITS = 24


def sort_key(seed: int = 7) -> Column:
    text = F.xxhash64(F.lit(seed), text_of()).bitwiseAND(F.lit((1 << 39) - 1))
    doc = F.xxhash64(F.lit(seed), F.col("doc_id")).bitwiseAND(F.lit((1 << DOC_BITS) - 1))
    return F.shiftleft(text, DOC_BITS) + doc


def byte_size() -> Column:
    return F.octet_length(text_of()).cast("long") + 1


def splitters(keys: DataFrame, n_shards: int, tolerance: float, copy_tolerance: float) -> tuple[list[int], list[int], list]:
    """Splitter keys, rows below each, and the first histogram, from rows of (_k, size).

    The driver holds at most (n_shards - 1) * 4096 counts in a round.
    """
    pending: dict[int, tuple[int, int, int]] = {}  # shard -> interval's prefix, bytes and rows below it
    found: dict[int, tuple[int, int]] = {}
    first, total, above = [], 0, 63
    for shift in ROUNDS:
        rows = keys if shift == ROUNDS[0] else keys.where(F.shiftright("_k", above).isin(sorted({p for p, _, _ in pending.values()})))
        hist = sorted((r[0], r[1], r[2]) for r in rows.groupBy(F.shiftright("_k", shift).alias("p")).agg(F.sum("size"), F.count(F.lit(1))).collect())
        if shift == ROUNDS[0]:
            first, total = hist, sum(b for _, b, _ in hist)
            pending = {j: (0, 0, 0) for j in range(1, n_shards)}
        within: dict[int, list] = {}
        for h in hist:
            within.setdefault(h[0] >> (above - shift), []).append(h)
        rest, shard_bytes = {}, total / n_shards
        for j, (prefix, below, n_below) in pending.items():
            goal, options = j * shard_bytes, []
            for p, b, n in within.get(prefix, []):
                options.append((abs(below - goal), p, below, n_below, 0))
                if below + b >= goal:
                    options.append((abs(below + b - goal), p + 1, below + b, n_below + n, n))
                    break
                below, n_below = below + b, n_below + n
            if not options:
                found[j] = (0, 0)
                continue
            inside = options[-1]  # the bin in which the goal lies ends here
            miss, p, _, n_p, _ = min(options[-2:])
            limit = copy_tolerance if shift == DOC_BITS else tolerance
            if miss <= limit * shard_bytes or shift == 0 or inside[4] == 1:
                found[j] = (p << shift, n_p)
            else:
                rest[j] = (inside[1] - 1, options[-2][2], options[-2][3])
        pending, above = rest, shift
        if not pending:
            break
    keys_, rows_ = zip(*(found[j] for j in sorted(found))) if found else ((), ())
    return list(keys_), list(rows_), first


def histogram_shard(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.001, copy_tolerance: float = 0.02) -> DataFrame:
    """``docs`` with size (bytes + 1), shard (0 .. n_shards - 1, of near equal bytes) and slot (0, 1, ... in the shard).

    A splitter lies within ``tolerance`` of a shard's bytes from its goal wherever
    single rows allow it; one that falls among copies moves to their edge if that is
    within ``copy_tolerance``. Null texts count as empty, null doc_ids hash as null.
    Rows equal in text and doc_id have one key and stay together; their slots differ.
    An empty table gives an empty result. Input columns called as the added ones are
    replaced.
    """
    rows, back = apart(docs, {"doc_id", "text"}, {"shard", "slot", "size"})
    rows = rows.withColumns({"size": byte_size(), "_k": sort_key()})
    keys = cut(rows.select("_k", "size"))
    cuts, below, hist = splitters(keys, n_shards, tolerance, copy_tolerance)
    top = ROUNDS[0]
    # slots are numbered segment by segment; a bin that copies fill is split by doc_id bits
    mean = sum(n for _, _, n in hist) / (1 << (63 - top))
    hot = [p for p, _, n in hist if n > 4 * mean + 1000]
    fine = DOC_BITS // 2
    bin_ = F.shiftright("_k", top)
    seg = F.shiftleft(bin_, top)
    if hot:
        seg = F.when(bin_.isin(hot), F.shiftleft(F.shiftright("_k", fine), fine)).otherwise(seg)
    before = Window.unboundedPreceding, -1
    segs = keys.groupBy(seg.alias("_sg")).agg(F.count(F.lit(1)).alias("_n"))
    in_bin = F.sum("_n").over(Window.partitionBy(F.shiftright("_sg", top)).orderBy("_sg").rowsBetween(*before))
    starts, at = {}, 0
    for p, _, n in hist:
        starts[p], at = at, at + n
    base = F.element_at(F.array(*[F.lit(starts.get(p, 0)).cast("long") for p in range(1 << (63 - top))]), F.shiftright("_sg", top).cast("int") + 1)
    segs = cut(segs.select("_sg", (base + F.coalesce(in_bin, F.lit(0))).alias("_start")))
    rank = F.row_number().over(Window.partitionBy("_seg").orderBy("_k", F.col("doc_id").asc_nulls_first()))
    placed = rows.withColumn("_seg", seg).withColumn("_r", rank).join(segs, F.col("_seg") == F.col("_sg"))
    shard = sum((F.when(F.col("_k") >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    first_row = F.element_at(F.array(F.lit(0).cast("long"), *[F.lit(n).cast("long") for n in below]), F.col("shard") + 1)
    placed = placed.withColumn("shard", shard).withColumn("slot", F.col("_start") + F.col("_r") - 1 - first_row)
    return back(placed, F.col("size"), F.col("shard"), F.col("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder a shard, as Parquet."""
    sharded.write.partitionBy("shard").parquet(path)
