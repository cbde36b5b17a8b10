"""SimHash near-dedup by a byte-position inverted index with count filtering.

A 64-bit fingerprint has 8 positional bytes. Two fingerprints within d bits differ in
at most d bytes, so they share at least 8 - d positional bytes. Posting lists of single
bytes would hold 1/256 of the corpus each; the index therefore posts every distinct
fingerprint under each combination of 8 - d positions with their bytes (28 lists for
d = 2). A pair meets in a list exactly if its tally of shared positional bytes reaches
the guaranteed minimum; inside the list the tally is counted, and the bits are verified.

A list's members differ in d bytes only, so it holds at most 256**d fingerprints. Pairs
are formed in lists of up to ``pair_list`` members. The members of longer lists are
linked exactly another way: two fingerprints within 2 bits have a common neighbour
within one bit of either, and all that post the same neighbour are within 2 bits.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import apart, cut, row_key

SEED = 42
#: Hashes whose bits are unpacked at once.
BLOCK = 1 << 14


def simhash(text: bytes, shingle: int) -> int:
    """Majority bits of the shingles' XXH64; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only; split at space and TAB..CR
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxh64_intdigest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: n - shingle + 1].tolist()
    hashes = np.fromiter([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), BLOCK):
        ones += np.unpackbits(hashes[k:k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint as a signed long; a null text is one without words."""

    def run(texts: pa.Array) -> pa.Array:
        prints = np.array([simhash(x.as_py() or b"", shingle) for x in texts.cast(pa.binary())], np.uint64)
        return pa.array(prints.view(np.int64))

    return F.arrow_udf(run, "long")(text)


def as_hex(print_: Column) -> Column:
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def _bytes_mask(positions) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, max_bits: int = 2, pair_list: int = 24) -> DataFrame:
    """Links (a, b), a < b, over distinct fingerprints ``p``, that connect all within ``max_bits`` bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("max_bits must be 0, 1 or 2: beyond, a posting list has no small bound")
    least = 8 - max_bits
    postings = F.array(*[F.struct(F.lit(i).cast("byte").alias("at"), F.col("p").bitwiseAND(F.lit(_bytes_mask(c))).alias("bytes"))
                         for i, c in enumerate(combinations(range(8), least))])
    lists = prints.select("p", F.explode(postings).alias("l")).groupBy("l.at", "l.bytes").agg(F.collect_list("p").alias("m")).where(F.size("m") > 1)
    def tally(a: Column, b: Column) -> Column:
        same = [F.when(a.bitwiseXOR(b).bitwiseAND(F.lit(_bytes_mask([p]))) == 0, 1).otherwise(0) for p in range(8)]
        return sum(same[1:], same[0])

    linked = lambda a, b: (tally(a, b) >= least) & (F.bit_count(a.bitwiseXOR(b)) <= max_bits)
    sorted_ = F.sort_array("m")
    pairs = F.flatten(F.transform(sorted_, lambda a, i: F.transform(F.filter(F.slice(sorted_, i + 2, F.size("m")), lambda b: linked(a, b)),
                                                                     lambda b: F.struct(a.alias("a"), b.alias("b")))))
    lists = cut(lists.select(F.when(F.size("m") > pair_list, F.col("m")).alias("long"), F.when(F.size("m") <= pair_list, pairs).alias("pairs")))
    near = lists.select(F.explode("pairs").alias("x")).select("x.a", "x.b")
    # the rest: at most 65 fingerprints post one neighbour
    flips = F.array(*[F.lit(0).cast("long")] + [F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(64)][: 64 * (max_bits > 0)])
    long_ = lists.select(F.explode("long").alias("p")).distinct()
    posted = long_.select("p", F.explode(flips).alias("f")).groupBy(F.col("p").bitwiseXOR(F.col("f")).alias("n")).agg(F.collect_list("p").alias("m"))
    if max_bits == 1:
        posted = posted.select(F.expr("filter(m, x -> x = n or array_contains(m, n))").alias("m"), "n").where(F.expr("array_contains(m, n)")).select("m")
    star = posted.where(F.size("m") > 1).select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where("a < b")
    return near.union(star).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(p, root): each node of ``edges`` (a, b), a < b, with the smallest node it reaches.

    Alternating stars: every round moves larger neighbours to the smallest neighbour
    (large star), then smaller ones (small star), until nothing changes. Rounds grow with
    the logarithm of the longest chain; each is checkpointed.
    """
    edges = cut(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("n")).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        large = cut(large)  # now a < b
        low = large.groupBy("b").agg(F.min("a").alias("m")).withColumnRenamed("b", "n")
        small = large.join(low, F.col("b") == F.col("n"))
        small = cut(small.select(F.col("m").alias("a"), F.col("b")).union(small.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct())
        # stable once every node hangs on one root that is itself no child
        again = small.groupBy("b").count().where("count > 1").select("b").union(small.select("a").join(small.select(F.col("b").alias("c")), F.col("a") == F.col("c")).select("a"))
        edges = small
        if again.isEmpty():
            break
    return edges.select(F.col("b").alias("p"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("p"), F.col("a").alias("root")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 2, keep_one: bool = False) -> DataFrame:
    """``docs`` (doc_id, text, ...) with fingerprint (long) and component_id.

    ``component_id`` is the smallest doc_id reachable over links of ``max_bits`` or fewer
    bits, the own included; null doc_ids don't count, and only a group without any other
    has a null one. With ``keep_one`` a single row of each component stays, one of that id.
    Null and empty texts, and those without words, have fingerprint 0. A text is held
    with its words, about five times its size. Fingerprints are computed once and written
    under a key of (doc_id, text), by which the rows find theirs; repeated rows share it.
    Copies share a fingerprint and meet in one row before anything is joined. Columns
    called as the added ones are replaced, others may have any name; an empty table gives an
    empty result.
    """
    rows, back = apart(docs, {"doc_id", "text"}, {"component_id", "fingerprint"})
    own = cut(rows.select(row_key().alias("key"), "doc_id", fingerprint(F.col("text"), shingle).alias("p")).distinct())
    prints = cut(own.groupBy("p").agg(F.min("doc_id").alias("least")))
    root = components(links(prints.select("p"), max_bits))
    rooted = prints.join(root, "p", "left").select("p", "least", F.coalesce("root", "p").alias("root"))
    rooted = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select(F.col("p").alias("q"), "component_id", "root")
    told = own.join(rooted, F.col("p") == F.col("q")).select("key", "p", "component_id", "root", "doc_id")
    if keep_one:
        first = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key", "p", "component_id")
        told = told.groupBy("root").agg(F.min(first).alias("r")).select("r.key", "r.p", "r.component_id")
    told = told.select(F.col("key").alias("_told"), F.col("p").alias("fingerprint"), "component_id")
    out = rows.withColumn("_key", row_key()).join(told, F.col("_key") == F.col("_told"))
    if keep_one:
        out = out.dropDuplicates(["_key"])
    return back(out, F.col("fingerprint"), F.col("component_id"))
