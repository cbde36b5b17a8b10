"""Benchmark decontamination by winnowing.

Of every run of ``window`` words the smallest hash among its k-word grams is kept (the
rightmost, if equal), in documents and in benchmark items alike. The choice depends on the
window's words only, so a shared window shares its fingerprint: no shared span of
``window`` words is missed.

Documents keep a fingerprint only if it may be one of the benchmark's, by a bit map of
fixed size. What is left is extended to both sides where it stands, to each window that
keeps it, and training and test sides join on (fingerprint, digest of the extended
window): a gram common to many items and documents meets only where the words around it
are equal, and no text is exchanged. Longer shared spans are the union of their windows.
Items shorter than the window are windows of their own length, with grams to match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import apart, cut, text_of

#: Byte by byte: A-Z lowered; all ASCII but 0-9 and a-z parts words.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: The same words, before lower-casing, as a pattern. The parting characters are listed one
#: by one: a pattern of ranges takes the JVM 30 times as long.
TERM = "[^" + "".join(f"\\x{b:02x}" for b in range(128) if FOLD[b] == 0x20) + "]+"
BASE = np.array([0x9E3779B97F4A7C15], np.uint64)
#: Bits of the map of the benchmark's fingerprints: 2 MB, whatever the benchmark's size.
#: A fuller map lets more fingerprints of documents through and changes no result.
MAP_BITS = 1 << 24


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(FOLD).split()


def hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def winnow(words: np.ndarray, length: int, gram: int) -> np.ndarray:
    """For each window of ``length`` words, in order, the hash of the gram it keeps."""
    k = min(gram, length)
    n = len(words) - k + 1
    w = length - k + 1
    if n < w:
        return np.zeros(0, np.uint64)
    g = np.full(n, np.uint64(length)) * BASE
    for i in range(k):
        g = (g ^ words[i:n + i]) * BASE
        g ^= g >> np.uint64(29)
    views = np.lib.stride_tricks.sliding_window_view(g, w)
    return g[np.arange(n - w + 1) + (w - 1 - views[:, ::-1].argmin(1))]


def extended(words: list[bytes], start: int, length: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start:start + length]), digest_size=16).digest()


def windows(texts: DataFrame, window: int, gram: int, lengths: list[int] | None = None, wanted: np.ndarray | None = None) -> DataFrame:
    """(key, start, len, h, around) of the windows of rows (key, text).

    Without ``lengths`` a text has windows of its own length, at most ``window``, as items
    do; with ``wanted``, a bit map, only windows whose fingerprint it holds are extended.
    A text is held as its words, about five times its own size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, starts, sizes, kept, around = [], [], [], [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary())):
                words = words_of(text.as_py())
                hashed = hashes(words)
                for length in lengths if lengths is not None else [min(len(words), window)] if words else []:
                    h = winnow(hashed, length, gram)
                    if wanted is None:
                        at = np.arange(len(h))
                    else:
                        bit = h & np.uint64(MAP_BITS - 1)
                        at = np.flatnonzero(wanted[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                    if len(at):
                        keys += [key] * len(at)
                        starts.append(at)
                        sizes += [length] * len(at)
                        kept.append(h[at])
                        around += [extended(words, i, length) for i in at.tolist()]
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), pa.array(np.concatenate(starts).astype(np.int32)), pa.array(sizes, pa.int32()),
                                                  pa.array(np.concatenate(kept).view(np.int64)), pa.array(around, pa.binary())], names=["key", "start", "len", "h", "around"])

    return texts.mapInArrow(run, f"key {texts.schema['key'].dataType.simpleString()}, start int, len int, h long, around binary")


def bit_map(prints: DataFrame) -> np.ndarray:
    """The fingerprints ``h`` modulo MAP_BITS as a bit map of MAP_BITS / 8 bytes, gathered as at most MAP_BITS / 64 numbers."""
    bit = F.col("h").bitwiseAND(F.lit(MAP_BITS - 1))
    rows = prints.select(F.shiftright(bit, 6).alias("w"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(MAP_BITS // 64, "<i8")
    for batch in rows.toArrow().to_batches():
        out[batch.column("w").to_numpy()] = batch.column("b").to_numpy()
    return out.view(np.uint8)


def merged(spans: Column) -> Column:
    """Windows array<struct<start, end>> as maximal spans."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(column: pa.Array) -> pa.Array:
        rows = []
        for windows_ in column.to_pylist():
            out: list = []
            for x in sorted(windows_ or (), key=lambda x: (x["start"], x["end"])):
                if out and x["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], x["end"])
                else:
                    out.append(dict(x))
            rows.append(out)
        return pa.array(rows, kind)

    return F.arrow_udf(run, "array<struct<start:int,end:int>>")(spans)


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5) -> DataFrame:
    """(key, n_hit, spans, items) of each distinct text of ``docs`` (text) that holds a window; ``key`` is the text's md5.

    Copies of a text hit alike, so a text's windows are gathered once. The items of a set
    of windows are looked up once for all texts that hit the same set.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.md5("text").alias("key"), "text", F.col("item_id").cast("string").alias("item_id"))
    named = cut(items.select("key", "item_id").distinct())
    tested = cut(windows(items.groupBy("key").agg(F.first("text").alias("text")), window, gram))
    lengths = sorted(r[0] for r in tested.select("len").distinct().collect())  # at most `window` rows
    if not lengths:
        lengths, wanted = [window], np.zeros(MAP_BITS // 8, np.uint8)
    else:
        wanted = bit_map(tested)
    trained = windows(docs.select(F.md5("text").alias("key"), "text").where("text is not null"), window, gram, lengths, wanted)
    grams = tested.select("h", "around").distinct()
    met = cut(trained.join(grams, ["h", "around"]).select("key", "start", "len", "around").distinct())
    hit = met.groupBy("key").agg(F.collect_set(F.struct("start", (F.col("start") + F.col("len")).alias("end"))).alias("windows"),
                                 F.sort_array(F.collect_set("around")).alias("around"))
    sign = F.md5(F.aggregate("around", F.lit(b""), lambda x, y: F.concat(x, y)))
    hit = cut(hit.select("key", "windows", "around", sign.alias("sign")))
    sets = hit.groupBy("sign").agg(F.first("around").alias("around")).select("sign", F.explode("around").alias("around"))
    where = tested.select("around", F.col("key").alias("item")).distinct()
    found = sets.join(where, "around").select("sign", "item").distinct().join(named.withColumnRenamed("key", "item"), "item")
    found = found.groupBy("sign").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    out = hit.join(found, "sign").select("key", merged(F.col("windows")).alias("spans"), "items")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cut(out.select("key", n_hit.alias("n_hit"), "spans", "items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, gram: int = 5, column: str = "leak") -> DataFrame:
    """``docs`` (text, ...) with struct ``column``: n_words, n_hit, spans of hit words, items (ids as strings).

    ``benchmark`` has item_id and text. Null and empty texts have no words; items without
    words or with a null id don't occur; items of equal text are matched once and all
    named; repeated rows get equal results. Only keys are joined to the rows, as Spark's
    size check decides: broadcast while the hits are few, shuffled beyond, where a text's
    many copies can be split; a caller that drops the text shuffles none. An existing column
    of that name is replaced, any other may have any name; empty tables give no hits.
    """
    rows, back = apart(docs, {"text"}, {column})
    found = leaks(rows, benchmark, window, gram).select(F.col("key").alias("_met"), "n_hit", "spans", "items")
    rows = rows.withColumns({"_key": F.md5("text"), "_words": F.regexp_count(text_of(), F.lit(TERM)).cast("long")})
    out = rows.join(found, F.col("_key") == F.col("_met"), "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    leak = F.struct(F.col("_words").alias("n_words"), F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("spans", none).alias("spans"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    return back(out, leak.alias(column))
