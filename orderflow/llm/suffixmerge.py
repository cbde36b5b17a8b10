"""Suffix-array dedup by a distributed merge sort that knows common prefixes.

Sorting all suffixes of a corpus would move many times its size. Sampled are the suffixes
at anchors (see ``anchors``): every ``window`` bytes that repeat hold one at the same
offset, so a sampled suffix with the bytes before it stands for all windows it is the
anchor of. Each task sorts its suffixes and front-codes the runs (length of the prefix shared with
the one before, and the rest); runs are exchanged by the hash of the anchor's gram, and a
loser tree merges them. Its matches start after the prefix that both sides share with the
last winner, so no known prefix is compared again, and the prefix lengths come out with the
order: a window's equals lie in a run of the order that shares the window's part of the
suffix, and the bytes before the anchor part the run. Equal strings have met before, in
an aggregate, so only different ones are sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.anchors import HOT, SPANS_SQL, Bytes, finish, found_pieces, hot_grams, hot_spans, marks, order, span_rows, spread, strings

RUN = [("bucket", pa.int64()), *((c, pa.binary()) for c in ("shared", "rests", "rest_sizes", "befores", "before_sizes", "lasts", "names"))]
RUN_SQL = "bucket long, shared binary, rests binary, rest_sizes binary, befores binary, before_sizes binary, lasts binary, names binary"


def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes need no look."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    lo, hi = known, n  # equal up to lo, different before hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def sorted_runs(batches: Iterator[pa.RecordBatch], window: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Front-coded runs, one a bucket and batch, of rows (h, body, at, id, b, b2)."""
    for batch in batches:
        schema = pa.schema([*RUN, ("ids", pa.list_(batch.schema.field("id").type))])
        by: dict[int, list] = {}
        for h, body, at, doc, b, b2 in zip(*(batch.column(c).to_pylist() for c in ("h", "body", "at", "id", "b", "b2"))):
            by.setdefault(h % buckets, []).append((body[at:at + window], body[:at], len(body) - window, b, b2, doc))
        rows = []
        for bucket, run in by.items():
            run.sort(key=lambda x: x[0])
            suffixes, befores, lasts, b, b2, ids = zip(*run)
            shared = [0] + [common(x, y) for x, y in zip(suffixes, suffixes[1:])]
            rests = [s[n:] for s, n in zip(suffixes, shared)]
            rows.append((bucket, bytes(shared), b"".join(rests), bytes(map(len, rests)), b"".join(befores), bytes(map(len, befores)), bytes(lasts),
                         np.array([b, b2], np.int64).tobytes(), list(ids)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def parted(blob: bytes, sizes: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.uint8), dtype=np.int64).tolist()
    return [blob[a:b] for a, b in zip([0, *ends], ends)]


class LoserTree:
    """Merges front-coded runs [(shared prefix lengths, rests)]; yields (shared, run, place) in order.

    ``known[r]``: bytes that the head of run r shares with the last winner. Of two heads the
    one that shares more is smaller; only equal sharers are compared, from there on, and
    the loser then shares that much with the winner.
    """

    def __init__(self, runs: list[tuple[bytes, list[bytes]]]):
        self.runs, self.width = runs, 1
        while self.width < len(runs):
            self.width *= 2
        self.place = [0] * len(runs)
        self.heads: list[bytes | None] = [rests[0] if rests else None for _, rests in runs] + [None] * (self.width - len(runs))
        self.known = [0] * self.width
        self.losers = [0] * self.width
        self.winner = self._build(1) if self.width > 1 else 0

    def _match(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        m, n = self.known[a], self.known[b]
        if m != n:
            return (a, b) if m > n else (b, a)
        shared = common(x, y, m)
        if x[shared:shared + 1] <= y[shared:shared + 1]:
            self.known[b] = shared
            return a, b
        self.known[a] = shared
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.width:
            return node - self.width
        winner, self.losers[node] = self._match(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def __iter__(self):
        while (head := self.heads[w := self.winner]) is not None:
            shared, rests = self.runs[w]
            place = self.place[w]
            yield self.known[w], w, place, head
            place += 1
            self.place[w] = place
            if place < len(rests):  # its next suffix shares this much with the winner
                self.known[w] = shared[place]
                self.heads[w] = head[:shared[place]] + rests[place]
            else:
                self.heads[w] = None
            node = (w + self.width) // 2
            while node:
                w, self.losers[node] = self._match(w, self.losers[node])
                node //= 2
            self.winner = w


def smallest_docs(group: list[tuple], window: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(b, b2, spans) of windows that also start in a document of smaller rank.

    ``group``: different strings of one gram in order of their suffixes, as (shared with the
    one before, suffix, before, last, b, b2, rank); ``last`` counts the windows after the
    first. A window with c bytes before the gram needs window - c bytes of the suffix: the
    strings that can hold it are a run of the order, in which each shares that much with
    the one before. Within a run the c bytes before decide.
    """
    ranks = [x[6] for x in group]
    if min(ranks) == max(ranks):
        return
    flags = [[False] * (x[3] + 1) for x in group]
    for c in range(max(len(x[2]) for x in group) + 1):
        run: list[int] = []
        for i, (shared, _, before, last, _, _, _) in enumerate(group):
            if shared < window - c and run:
                _least(run, group, flags, c)
                run = []
            run.append(i)
        _least(run, group, flags, c)
    for (_, _, _, _, b, b2, _), own in zip(group, flags):
        if any(own):
            yield b, b2, spread(own, 0, window)


def _least(run: list[int], group: list[tuple], flags: list[list[bool]], c: int) -> None:
    """Flags the window with ``c`` bytes before the gram in each string of a run whose rank isn't the smallest with it."""
    if len(run) < 2:
        return
    own = [(group[i][2][len(group[i][2]) - c:], group[i][6], i) for i in run if 0 <= len(group[i][2]) - c <= group[i][3]]
    own.sort()  # equal bytes before lie together, the smallest rank first
    was, least = None, 0
    for before, rank, i in own:
        if before != was:
            was, least = before, rank
        elif rank > least:
            flags[i][len(group[i][2]) - c] = True


def merge_bucket(runs: list[dict], window: int, gram: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    columns = [(parted(r["befores"], r["before_sizes"]), r["lasts"], *np.frombuffer(r["names"], np.int64).reshape(2, -1).tolist(),
                [(x is None, x) for x in r["ids"]]) for r in runs]  # null is the largest
    group: list[tuple] = []
    for shared, run, place, suffix in LoserTree([(r["shared"], parted(r["rests"], r["rest_sizes"])) for r in runs]):
        if shared < gram and group:
            if len(group) > 1:
                yield from smallest_docs(group, window)
            group = []
        group.append((shared, suffix, *(column[place] for column in columns[run])))
    if len(group) > 1:
        yield from smallest_docs(group, window)


def merged(batches: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; a bucket's runs are merged when all are there."""
    bucket, runs = None, []

    def marks(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        out = list(merge_bucket(rows, window, gram))
        if out:
            yield span_rows(out)

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket and runs:
                yield from marks(runs)
                runs = []
            bucket = row["bucket"]
            runs.append(row)
    if runs:
        yield from marks(runs)


def remove_repeats(docs: DataFrame, window: int = 50, buckets: int | None = None, hot: int = HOT) -> DataFrame:
    """Per document of ``docs`` (doc_id, text): doc_id, n bytes, n_removed, spans (byte numbers), kept_sha256.

    A byte goes if a string of ``window`` bytes that covers it also starts in a document
    with a smaller doc_id; strings are judged on the input and never cross documents. Null
    texts are empty; doc_ids may be of any type, a null one counts as the largest;
    documents of equal doc_id don't cost each other anything. Equal strings meet before
    they are sorted. ``buckets`` (2 a shuffle partition by default) part the grams, so that
    one's runs fit a task; a gram with more than ``hot`` different strings is compared by
    exact window over all tasks. A text is held about twice. An empty table gives an empty
    result; other columns are ignored.
    """
    if not 25 <= window <= 255:
        raise ValueError("window must be 25 to 255 bytes")
    unit = Bytes(window)
    buckets = buckets or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = found_pieces(docs, unit)
    own = strings(found)
    usual, crowded = hot_grams(own, hot)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    runs = usual.select("h", "body", "at", F.col("first.id").alias("id"), "b", "b2").mapInArrow(
        lambda batches: sorted_runs(batches, window, buckets), f"{RUN_SQL}, ids array<{id_type}>")
    spans = runs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: merged(batches, window, unit.gram), SPANS_SQL)
    if crowded is not None:
        spans = spans.union(hot_spans(crowded, unit, F.min("first"), F.col("v") < F.col("first")))
    # a place of a string goes as a whole if a smaller document has the string
    out = marks(found, own, spans, window, order() > F.col("first"))
    return finish(docs, out, unit, "later")
