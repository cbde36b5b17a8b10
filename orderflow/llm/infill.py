"""Fill-in-the-middle by a piece table.

A document is never copied while it is rearranged: it is a list of descriptors (buffer,
start, length) over buffers that do not change, the text and the sentinels. Cutting
splits a descriptor, an arrangement permutes the list, the inverse permutation restores
the order, and a hash streams over the descriptors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentinels before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: A form names the parts in their order (0 prefix, 1 suffix, 2 middle).
FORMS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}
#: Where the parts lie in the document: prefix, middle, suffix.
NATURAL = (0, 2, 1)
#: Characters encoded at once when a hash streams over a piece.
BLOCK = 1 << 20


class PieceTable:
    """Descriptors (buffer, start, length), in code points, over immutable buffers."""

    def __init__(self, buffers: Sequence[str], pieces: list[tuple[int, int, int]]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text: str, sentinels: Sequence[str]) -> "PieceTable":
        return cls((text, *sentinels), [(0, 0, len(text))])

    def cut(self, at: int) -> None:
        """Split the piece that holds offset ``at``; at a border an empty piece arises there."""
        for k, (buffer, start, length) in enumerate(self.pieces):
            if at <= length:
                self.pieces[k:k + 1] = [(buffer, start, at), (buffer, start + at, length - at)]
                return
            at -= length

    def arrange(self, form: str) -> "PieceTable":
        """Prefix, middle and suffix in the order of the form, each behind its sentinel."""
        parts = dict(zip(NATURAL, self.pieces))
        pieces = [p for k in FORMS[form] for p in ((1 + k, 0, len(self.buffers[1 + k])), parts[k])]
        return PieceTable(self.buffers, pieces)

    def restore(self, form: str) -> "PieceTable":
        """The inverse of ``arrange``: sentinels go, parts return to their places."""
        parts = dict(zip(FORMS[form], self.pieces[1::2]))
        return PieceTable(self.buffers, [parts[k] for k in NATURAL])

    def blocks(self) -> Iterator[str]:
        for buffer, start, length in self.pieces:
            for at in range(start, start + length, BLOCK):
                yield self.buffers[buffer][at:min(at + BLOCK, start + length)]

    def text(self) -> str:
        return "".join(self.blocks())

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for block in self.blocks():
            digest.update(block.encode())
        return digest.hexdigest()


def parse(output: str, form: str, sentinels: Sequence[str]) -> PieceTable:
    """Descriptors over an output string: its sentinels stand once, in the form's order."""
    pieces, at = [], 0
    order = [sentinels[k] for k in FORMS[form]]
    for k, mark in enumerate(order):
        start = at + len(mark)
        end = output.index(order[k + 1], start) if k + 1 < len(order) else len(output)
        pieces += [(0, at, len(mark)), (0, start, end - start)]
        at = end
    return PieceTable((output,), pieces)


def unit_ends(text: str, wanted: Sequence[int]) -> tuple[int, list[int]]:
    """(number of lines, the offsets where the first ``k`` of them end, for each ``k`` wanted)."""
    n = text.count("\n") + (not text.endswith("\n") and text != "")
    ends, at, line = {0: 0}, 0, 0
    for k in sorted(set(wanted)):
        while line < k:
            found = text.find("\n", at)
            at, line = (len(text) if found < 0 else found + 1), line + 1
        ends[k] = at
    return n, [ends[k] for k in wanted]


def infill(text: str, key: str, seed: int, rate: int, spm: int, sentinels: Sequence[str]) -> tuple:
    """(n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256) of one document."""
    h = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n, _ = unit_ends(text, ())
    if not text or any(s in text for s in sentinels) or h3 % 100 >= rate:
        digest = PieceTable.of(text, sentinels).sha256()
        return n, "plain", None, None, text, digest, digest
    form = "spm" if h4 % 100 < spm else "psm"
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    _, (a, b) = unit_ends(text, (first, second))
    table = PieceTable.of(text, sentinels)
    table.cut(b)
    table.cut(a)
    arranged = table.arrange(form)
    output = arranged.text()
    restored = parse(output, form, sentinels).restore(form)
    return n, form, a, b - a, output, arranged.sha256(), restored.sha256()


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: Sequence[str] = SENTINELS,
                   output: bool = True) -> DataFrame:
    """doc_id and ``infill`` struct<n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256>.

    ``rate`` and ``spm`` are percentages; without ``output`` that field is null and only
    digests leave the task. ``restored_sha256`` is taken from the output string, parsed by
    its form. A null text is the empty one; a null doc_id counts as the empty string; an
    empty text, or one that holds a sentinel, stays plain. Each row stands alone, so
    repeated rows get equal results, and a very long text takes its own size about three
    times. Other columns are kept but for one called ``infill``; an empty table stays empty.
    """
    if any(not re.fullmatch(r"<[^<>]+>", s) for s in sentinels) or len(set(sentinels)) != 3:
        raise ValueError("sentinels are three different strings <...>")  # so none can begin inside another
    kind = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                      ("output", pa.string()), ("output_sha256", pa.string()), ("restored_sha256", pa.string())])

    def run(keys: pa.Array, texts: pa.Array) -> pa.Array:
        rows = []
        for key, text in zip(keys, texts):
            row = infill(text.as_py() or "", key.as_py() or "", seed, rate, spm, sentinels)
            rows.append(dict(zip(kind.names, row if output else (*row[:4], None, *row[5:]))))
        return pa.array(rows, kind)

    made = F.arrow_udf(run, "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string")
    return docs.withColumn("infill", made(F.col("doc_id").cast("string"), F.col("text")))
