"""Substring dedup by super-k-mer partitioning.

Consecutive windows that share a minimiser travel as one packed string to the task of that
minimiser, where all windows of its strings are sorted and equal neighbours counted. Equal
strings meet in an aggregate before, with a count, so only different ones are sorted.
Strings of minimisers that occur once in the corpus hold no repeated window and
don't travel (see ``anchors``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.anchors import HOT, SPANS_SQL, Words, finish, found_pieces, hot_grams, hot_spans, marks, span_rows, spread, strings


def count_windows(rows: list[tuple], window: int) -> list[tuple[int, int, list[tuple[int, int]]]]:
    """(b, b2, spans) of repeated windows in the different strings (packed, weight, b, b2) of one minimiser."""
    if len(rows) < 2:
        return []
    cuts, owner = [], []
    for r, (packed, *_) in enumerate(rows):
        ends, at = [], packed.find(b" ")
        while at >= 0:
            ends.append(at)
            at = packed.find(b" ", at + 1)
        ends.append(len(packed))
        starts = [0] + [e + 1 for e in ends[:-1]]
        cuts += [packed[a:b] for a, b in zip(starts, ends[window - 1:])]
        owner += [r] * (len(ends) - window + 1)
    order = sorted(range(len(cuts)), key=cuts.__getitem__)
    flags = [False] * len(cuts)
    i = 0
    while i < len(order):
        j = i + 1
        while j < len(order) and cuts[order[j]] == cuts[order[i]]:
            j += 1
        if j - i > 1 or rows[owner[order[i]]][1] > 1:
            for x in order[i:j]:
                flags[x] = True
        i = j
    out, at = [], 0
    for packed, weight, b, b2 in rows:
        n = packed.count(b" ") + 2 - window
        if weight < 2 and (spans := spread(flags[at:at + n], 0, window)):
            out.append((b, b2, spans))
        at += n
    return out


def count_bucket(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h; at most HOT of them share one."""
    last, rows, out = None, [], []
    for batch in batches:
        for h, *row in zip(*(batch.column(c).to_pylist() for c in ("h", "body", "weight", "b", "b2"))):
            if h != last and rows:
                out += count_windows(rows, window)
                rows = []
            last = h
            rows.append(tuple(row))
        if len(out) > 20_000:
            yield span_rows(out)
            out = []
    if rows:
        out += count_windows(rows, window)
    if out:
        yield span_rows(out)


def remove_repeats(docs: DataFrame, window: int = 35, minimiser: int = 6, hot: int = HOT) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): doc_id, n words, n_removed, spans (word numbers), kept_sha256.

    A word goes if a window of ``window`` words that covers it starts anywhere else too, in
    the same document included; windows are judged on the input. Null and empty texts
    have no words. Of equal texts every window repeats. Repeated rows are copies of each
    other. doc_ids may be of any type; null ones stay null. Equal strings meet before they
    are sorted; a minimiser with more than ``hot`` different ones is counted by exact window
    over all tasks. A text is held as its words, about five times its size. An empty
    table gives an empty result; other columns are ignored.
    """
    unit = Words(window, minimiser)
    found = found_pieces(docs, unit)
    own = strings(found)
    usual, crowded = hot_grams(own, hot)
    spans = usual.select("h", "body", "weight", "b", "b2").repartition("h").sortWithinPartitions("h").mapInArrow(lambda batches: count_bucket(batches, window), SPANS_SQL)
    if crowded is not None:
        spans = spans.union(hot_spans(crowded, unit, F.sum("weight"), F.col("v") > 1))
    # a string of two places or copies repeats as a whole
    return finish(docs, marks(found, own, spans, window, F.col("all") > 1), unit, "all")
