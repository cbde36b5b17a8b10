"""What super-k-mer partitioning and suffix merging share: which parts of a corpus can repeat.

A text is a row of units (words or bytes). Each window of W units is represented by its
anchor, the gram of least hash inside it (the leftmost, if equal); equal windows have equal
anchors at equal offsets. Consecutive windows of one anchor form a piece. A window can
only repeat if its anchor's gram does, so grams are counted first (as 64-bit hashes, where a
collision only lets a piece through) and only pieces of repeated grams are built,
exchanged and compared as text.

Copies of whole texts are counted by their hashes first and one of them is looked into.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import cut, text_of

MIX = np.uint64(0x9E3779B97F4A7C15)
#: Different strings of one gram that a task holds at once, some 100 bytes (bytes) or 500 (words) each.
#: Copies of a string are one. A gram with more is compared window by window over all tasks.
HOT = 50_000


def order(doc: str = "doc") -> Column:
    """Documents in order of their id, whatever its type; null is the largest."""
    return F.struct(F.col(doc).isNull().alias("null"), F.col(doc).alias("id"))


@dataclass(frozen=True)
class Words:
    """Words between spaces and TAB..CR as units."""

    window: int
    gram: int
    #: Whether a window that recurs in its own text only counts.
    within = True

    def split(self, text: bytes) -> list[bytes]:
        return text.split()

    def hashes(self, units: list[bytes]) -> np.ndarray:
        from xxhash import xxh64_intdigest

        words = np.fromiter(map(xxh64_intdigest, units), np.uint64, len(units))
        n = len(units) - self.gram + 1
        g = np.zeros(n, np.uint64)
        for i in range(self.gram):
            g = (g ^ words[i:n + i]) * MIX
            g ^= g >> np.uint64(32)
        return g

    def join(self, units: list[bytes]) -> bytes:
        return b" ".join(units)


@dataclass(frozen=True)
class Bytes:
    """Single bytes as units; grams of 24, which few strings share by chance."""

    window: int
    gram: int = 24
    within = False

    def split(self, text: bytes) -> bytes:
        return text

    def hashes(self, units: bytes) -> np.ndarray:
        n = len(units) - self.gram + 1
        eights = np.ndarray((n + 16,), "<u8", units, strides=(1,))
        g = np.zeros(n, np.uint64)
        for i in (0, 8, 16):
            g = (g ^ eights[i:n + i]) * MIX
            g ^= g >> np.uint64(32)
        return g

    def join(self, units: bytes) -> bytes:
        return units


def pieces(unit, units) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, end of windows, anchor and gram hash of each piece of a text."""
    count = len(units) - unit.window + 1
    if count < 1:
        none = np.zeros(0, np.int64)
        return none, none, none, none.view(np.uint64)
    grams = unit.hashes(units)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    have, need = 1, unit.window - unit.gram + 1
    while have < need:  # minima of `have` grams give those of up to twice as many
        step = min(have, need - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.concatenate([[0], np.flatnonzero(np.diff(anchor)) + 1])
    return start, np.append(start[1:], count), anchor[start], grams[anchor[start]]


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, text, k, k2): null texts are empty, k and k2 tell texts apart."""
    text = text_of()
    return docs.select(F.col("doc_id").alias("doc"), text.alias("text"), F.xxhash64(text).alias("k"), F.xxhash64(F.lit(1), text).alias("k2"))


#: Texts whose anchors one row may number; the last number marks an entry that only tells.
NUMBERED = 0xFFFF
TOLD = np.uint16(NUMBERED)
GRAMS = pa.schema([("bucket", pa.int32()), ("high", pa.binary()), ("low", pa.binary()), ("d", pa.binary()), ("ks", pa.binary())])


def batch_grams(batches: Iterator[pa.RecordBatch], unit, buckets: int) -> Iterator[pa.RecordBatch]:
    """Anchor hashes of a batch's different texts by bucket: hashes (high and low bits), text numbers d, and the texts' k.

    What the batch holds twice is known to repeat: it goes out as such (negative buckets, by
    text), and one entry (d = TOLD) tells the others. So a gram that most texts hold puts one
    entry a batch into its bucket.
    """
    for batch in (b.slice(i, NUMBERED) for b in batches for i in range(0, b.num_rows, NUMBERED)):
        ks, found, seen = [], [], set()
        for k, text in zip(batch.column("k").to_pylist(), batch.column("text").cast(pa.binary())):
            if k in seen:  # a copy, which the key counts tell already
                continue
            seen.add(k)
            h = pieces(unit, unit.split(text.as_py()))[3] >> np.uint64(16)
            found.append(np.unique(h, return_counts=True))
            ks.append(k)
        if not ks:
            continue
        k = np.array(ks, np.int64)
        h = np.concatenate([x for x, _ in found])
        d = np.repeat(np.arange(len(ks), dtype=np.uint16), [len(x) for x, _ in found])
        twice = (np.concatenate([n for _, n in found]) > 1) & unit.within
        order = np.argsort(h, kind="stable")
        h, d, twice = h[order], d[order], twice[order]
        same = h[1:] == h[:-1]
        known = twice.copy()
        known[1:] |= same
        known[:-1] |= same
        first = np.append(True, ~same) & known
        rows = []
        for sign, hs, ds in ((1, np.concatenate([h[~known], h[first]]), np.concatenate([d[~known], np.full(int(first.sum()), TOLD)])), (-1, h[known], d[known])):
            b = ((hs if sign > 0 else k[ds].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(b, kind="stable")
            hs, ds, b = hs[order], ds[order], b[order]
            edges = np.flatnonzero(np.diff(b)) + 1
            for x, y, z in zip(np.split(hs, edges), np.split(ds, edges), np.split(b, edges)) if len(b) else ():
                real = y != TOLD
                own, number = np.unique(y[real], return_inverse=True)
                y = y.copy()
                y[real] = number
                rows.append((int(z[0]) if sign > 0 else -1 - int(z[0]), (x >> np.uint64(16)).astype(np.uint32).tobytes(), x.astype(np.uint16).tobytes(), y.tobytes(), k[own].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), GRAMS)], schema=GRAMS)


def matched_grams(batches: Iterator[pa.RecordBatch], within: bool) -> Iterator[pa.RecordBatch]:
    """(k, hs) of hashes that a bucket holds twice (in two texts, if not ``within``); rows come sorted by bucket."""
    schema = pa.schema([("k", pa.int64()), ("hs", pa.list_(pa.int64()))])

    def bucket_rows(bucket: int, parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([np.frombuffer(x, np.uint32).astype(np.uint64) << np.uint64(16) | np.frombuffer(y, np.uint16) for x, y, _, _ in parts])
        k = np.concatenate([np.append(np.frombuffer(ks, np.int64), 0)[np.minimum(np.frombuffer(d, np.uint16), len(ks) // 8)] for _, _, d, ks in parts])
        told = np.concatenate([np.frombuffer(d, np.uint16) == TOLD for _, _, d, _ in parts])
        if bucket >= 0:
            order = np.lexsort((k, h))
            h, k, told = h[order], k[order], told[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            last = np.append(first[1:], len(h)) - 1
            many = last > first if within else (k[last] != k[first]) | np.maximum.reduceat(told, first)
            keep = np.repeat(many, last - first + 1) & ~told
            h, k = h[keep], k[keep]
        if len(h):
            order = np.lexsort((h, k))
            h, k = h[order].view(np.int64), k[order]
            new = np.append(True, (h[1:] != h[:-1]) | (k[1:] != k[:-1]))
            h, k = h[new], k[new]
            edges = np.append(np.append(0, np.flatnonzero(np.diff(k)) + 1), len(k))
            hs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(h))
            yield pa.RecordBatch.from_arrays([pa.array(k[edges[:-1]]), hs], schema=schema)

    last, parts = None, []
    for batch in batches:
        for bucket, *part in zip(*(c.to_pylist() for c in batch.columns)):
            if bucket != last and parts:
                yield from bucket_rows(last, parts)
                parts = []
            last = bucket
            parts.append(tuple(part))
    if parts:
        yield from bucket_rows(last, parts)


def repeated_grams(rows: DataFrame, unit) -> DataFrame:
    """(k, hs): for each text the anchors' hashes (48 bits) that occur in others too, or (``within``) twice in it.

    Hashes travel as packed arrays, one a batch and bucket; there are 4 buckets a shuffle
    partition, so their size is that of any shuffle's.
    """
    buckets = 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = rows.select("k", "text").mapInArrow(lambda batches: batch_grams(batches, unit, buckets), "bucket int, high binary, low binary, d binary, ks binary")
    met = met.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: matched_grams(batches, unit.within), "k long, hs array<long>")
    return met.select("k", F.explode("hs").alias("h")).groupBy("k").agg(F.collect_set("h").alias("hs"))


def found_pieces(docs: DataFrame, unit) -> DataFrame:
    """Pieces of repeated anchors in one document of each text, as a written table.

    (h, b, b2, k, k2, doc, weight, start, at, n, body): b and b2 tell strings apart, n is the
    number of windows, weight is 2 if the text has copies.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    rows = keyed(docs)
    texts = rows.groupBy("k", "k2").agg(F.count(F.lit(1)).alias("copies"), F.min(order()).alias("first"))
    info = texts.join(repeated_grams(rows, unit), "k").select(F.col("k").alias("i"), F.col("k2").alias("i2"), "copies", "first", "hs")
    info = cut(info)  # the hashes' shuffle ends before the texts' begins
    joined = rows.join(info, (F.col("k") == F.col("i")) & (F.col("k2") == F.col("i2")) & F.col("doc").eqNullSafe(F.col("first.id")))
    id_type = rows.schema["doc"].dataType
    schema = pa.schema([("h", pa.int64()), ("b", pa.int64()), ("b2", pa.int64()), ("k", pa.int64()), ("k2", pa.int64()), ("doc", to_arrow_type(id_type)), ("weight", pa.int64()),
                        ("start", pa.int32()), ("at", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
    ddl = f"h long, b long, b2 long, k long, k2 long, doc {id_type.simpleString()}, weight long, start int, at int, n int, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            columns: list[list] = [[] for _ in schema]
            bodies, size = columns[-1], 0
            for doc, k, k2, copies, text, hs in zip(*(batch.column(c).to_pylist() for c in ("doc", "k", "k2", "copies")), batch.column("text").cast(pa.binary()), batch.column("hs")):
                units = unit.split(text.as_py())
                start, end, at, h = pieces(unit, units)
                h = (h >> np.uint64(16)).view(np.int64)
                chosen = np.flatnonzero(np.isin(h, hs.values.to_numpy()))
                n = len(chosen)
                first, ends = start[chosen], end[chosen]
                own = [unit.join(units[a:b]) for a, b in zip(first.tolist(), (ends + unit.window - 1).tolist())]
                names = np.frombuffer(b"".join(map(xxh3_128_digest, own)), np.int64).reshape(-1, 2)
                for column, values in zip(columns, (h[chosen], names[:, 0], names[:, 1])):
                    column.extend(values.tolist())
                for column, value in zip(columns[3:7], (k, k2, doc, min(copies, 2))):
                    column += [value] * n
                for column, values in zip(columns[7:10], (first, at[chosen] - first, ends - first)):
                    column.extend(values.tolist())
                bodies += own
                size += sum(map(len, own))
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
                    columns = [[] for _ in schema]
                    bodies, size = columns[-1], 0
            if bodies:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return cut(joined.select("doc", "k", "k2", "copies", "text", "hs").mapInArrow(run, ddl))


def strings(found: DataFrame) -> DataFrame:
    """The different strings of the pieces, as a written table: (h, b, b2, body, at, n, first, weight, places).

    Copies of a string meet before any text is compared: ``first`` is the smallest document
    with it, ``weight`` counts its places with their texts' copies.
    """
    out = found.groupBy("h", "b", "b2").agg(F.min(order()).alias("first"), F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("places"),
                                            F.first("body").alias("body"), F.first("at").alias("at"), F.first("n").alias("n"))
    return cut(out)


def hot_grams(found: DataFrame, hot: int) -> tuple[DataFrame, DataFrame | None]:
    """Strings of grams with two to ``hot`` different ones, and those of grams with more, if there are any."""
    many = cut(found.groupBy("h").count().where("count > 1").select(F.col("h").alias("g"), (F.col("count") > hot).alias("crowded")))
    pair = lambda rows: found.join(rows, found["h"] == rows["g"], "left_semi")
    crowded = many.where("crowded")
    return pair(many.where("not crowded")), None if crowded.isEmpty() else pair(crowded)


def windows(found: DataFrame, unit) -> DataFrame:
    """(w binary, i, b, b2, first, weight): one row for each window of the strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                units = unit.split(batch.column("body")[row].as_py())
                n = len(units) - unit.window + 1
                rest = batch.slice(row, 1).take(pa.array([0] * n))
                own = pa.array([unit.join(units[i:i + unit.window]) for i in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([own, pa.array(range(n), pa.int32()), *rest.select(["b", "b2", "first", "weight"]).columns], names=["w", "i", "b", "b2", "first", "weight"])

    rows = found.select("body", "b", "b2", "first", "weight")
    return rows.mapInArrow(run, f"w binary, i int, b long, b2 long, first {rows.schema['first'].dataType.simpleString()}, weight long")


def hot_spans(found: DataFrame, unit, value: Column, repeats: Column) -> DataFrame:
    """(b, b2, spans) of crowded grams' strings: ``value`` is aggregated as ``v`` over equal
    windows, ``repeats`` tells by ``v`` whether a window of a string's goes."""
    each = cut(windows(found, unit))
    values = each.groupBy(F.col("w").alias("w_")).agg(value.alias("v"))
    going = each.join(values, F.col("w") == F.col("w_")).where(repeats).groupBy("b", "b2").agg(F.collect_list("i").alias("i"))
    return going.select("b", "b2", F.transform("i", lambda i: F.struct(i.alias("a"), (i + unit.window).alias("b"))).alias("spans"))


def marks(found: DataFrame, own: DataFrame, spans: DataFrame, window: int, whole: Column) -> DataFrame:
    """Marks (k, k2, a, b) of all pieces: the whole piece where ``whole`` holds of the piece and
    its string, else the string's own ``spans``."""
    spans = spans.select(F.col("b").alias("c"), F.col("b2").alias("c2"), "spans")
    told = own.join(spans, (F.col("b") == F.col("c")) & (F.col("b2") == F.col("c2")), "left").where("weight > 1 or spans is not null")
    told = cut(told.select(F.col("b").alias("c"), F.col("b2").alias("c2"), "first", F.col("weight").alias("all"), "spans"))
    # read back, it leaves Spark free to split the many places of one string
    met = found.select("k", "k2", "doc", "start", "n", "b", "b2").join(told, (F.col("b") == F.col("c")) & (F.col("b2") == F.col("c2")))
    full = F.array(F.struct(F.lit(0).alias("a"), (F.col("n") + window - 1).alias("b")))
    out = met.select("k", "k2", "start", F.explode(F.when(whole, full).otherwise(F.col("spans"))).alias("s"))
    return out.select("k", "k2", (F.col("start") + F.col("s.a")).alias("a"), (F.col("start") + F.col("s.b")).alias("b"))


SPANS = pa.schema([("b", pa.int64()), ("b2", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])
SPANS_SQL = "b long, b2 long, spans array<struct<a:int,b:int>>"


def span_rows(rows: list[tuple]) -> pa.RecordBatch:
    """(b, b2, [(a, b)]) as a batch."""
    b, b2, spans = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(b2, pa.int64()), pa.array([[{"a": x, "b": y} for x, y in s] for s in spans], SPANS.field("spans").type)], schema=SPANS)


def spread(flags: list[bool], start: int, window: int) -> list[tuple[int, int]]:
    """Unit spans that the flagged windows from ``start`` on cover."""
    out: list[list[int]] = []
    for i, flag in enumerate(flags, start):
        if flag:
            if out and i <= out[-1][1]:
                out[-1][1] = i + window
            else:
                out.append([i, i + window])
    return [(a, b) for a, b in out]


def finish(docs: DataFrame, marks: DataFrame, unit, copies_go: str) -> DataFrame:
    """(doc_id, n, n_removed, spans, kept_sha256) of every document from its text's marks.

    ``copies_go``: of documents with equal texts "all" (every window of theirs repeats) or the
    "later" ones (whose doc isn't the smallest) lose everything, if a window long.
    """
    from hashlib import sha256

    from pyspark.sql.pandas.types import to_arrow_type

    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    id_type = docs.schema["doc_id"].dataType
    schema = pa.schema([("doc", to_arrow_type(id_type)), ("n", pa.int64()), ("n_removed", pa.int64()), ("spans", span), ("sha", pa.string())])
    rows = keyed(docs)
    marks = marks.groupBy(F.col("k").alias("m"), F.col("k2").alias("m2")).agg(F.collect_set(F.struct("a", "b")).alias("marks"))
    info = rows.groupBy(F.col("k").alias("i"), F.col("k2").alias("i2")).agg(F.count(F.lit(1)).alias("copies"), F.min(order()).alias("first"))
    info = info.join(marks, (F.col("i") == F.col("m")) & (F.col("i2") == F.col("m2")), "left")
    info = cut(info)  # read back, it leaves Spark free to split the copies of a text in the join
    gone = F.col("copies") > 1 if copies_go == "all" else order() > F.col("first")
    joined = rows.join(info, (F.col("k") == F.col("i")) & (F.col("k2") == F.col("i2"))).select("doc", "text", "marks", gone.alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            # marks become Python objects a row at a time: a batch's may be millions
            for doc, gone, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc", "gone")), batch.column("text").cast(pa.binary()), batch.column("marks")):
                units = unit.split(text.as_py())
                n = len(units)
                merged: list[list[int]] = []
                for a, b in [(0, n)] if gone and n >= unit.window else sorted((x["a"], x["b"]) for x in found.as_py() or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                edges = [0, *(x for ab in merged for x in ab), n]
                parts = [units[a:b] for a, b in zip(edges[::2], edges[1::2])]
                kept = unit.join([x for part in parts for x in part] if isinstance(units, list) else b"".join(parts))
                out.append((doc, n, sum(b - a for a, b in merged), [{"start": a, "end": b} for a, b in merged], sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    out = joined.mapInArrow(run, f"doc {id_type.simpleString()}, n long, n_removed long, spans array<struct<start:int,end:int>>, sha string")
    return out.select(F.col("doc").alias("doc_id"), "n", "n_removed", "spans", F.col("sha").alias("kept_sha256"))
