"""Token counts by a Viterbi search that only counts.

The vocabulary (pieces and scores of a sentencepiece file) is an Aho-Corasick
automaton. Running over a text it lists every piece that ends at each character; a
dynamic program carries only the best score and its piece count. Ties go as in the
tokenizer's own search: positions are relaxed from the left and a later candidate
replaces an earlier one only if it scores more, so the longest last piece wins. A
character that is no piece costs the least score less 10, and counts as its UTF-8
bytes (byte fallback).

No piece has a space mark after another character, so spaces split a text into parts
whose best paths are independent. Parts recur; a task keeps those it has met.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import TOKENIZERS, apart, read_bytes

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: A task keeps parts of at most so many characters, and forgets them all beyond so many
#: bytes. Both bound its memory and change no result.
KEPT_PART, KEPT_BYTES = 64, 96 << 20
COUNTS = "struct<n_pieces:long,score:double>"


class Counter(dict):
    """part -> (pieces, score) under one vocabulary."""

    def __init__(self, pieces: dict[str, float]):
        import ahocorasick

        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.held, self.longest = 0, max(map(len, pieces))
        self.unknown = min(pieces.values()) - UNKNOWN_PENALTY
        splits = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        alien = "" if any("\n" in p for p in pieces) else "\n"
        self.parts = re.compile(rf"{SPACE}*[^{SPACE}{alien}]+|{SPACE}+" + ("|\n+" if alien else "")) if splits else re.compile(r"(?s).+")

    def __missing__(self, part: str) -> tuple[int, float]:
        found = self.search(part)
        if len(part) <= KEPT_PART:
            self.held += 200 + 4 * len(part)
            if self.held > KEPT_BYTES:
                self.clear()
                self.held = 0
            self[part] = found
        return found

    def search(self, part: str) -> tuple[int, float]:
        """Pieces and score of the best path; only the last positions that a piece can reach back to are held."""
        m = self.longest + 1
        best, count = [0.0] * m, [0] * m
        matches = self.automaton.iter(part)
        match = next(matches, None)
        for i, letter in enumerate(part):
            ends = []
            while match is not None and match[0] == i:
                ends.append(match[1])
                match = next(matches, None)
            if len(ends) > 1:
                ends.sort(reverse=True)
            at, single = None, False
            for length, score in ends:
                single |= length == 1
                start = (i + 1 - length) % m
                total = best[start] + score
                if at is None or total > at:
                    at, pieces = total, count[start] + 1
            if not single:
                total = best[i % m] + self.unknown
                if at is None or total > at:
                    at, pieces = total, count[i % m] + len(letter.encode("utf-8", "surrogatepass"))
            best[(i + 1) % m], count[(i + 1) % m] = at, pieces
        return count[len(part) % m], best[len(part) % m]

    def count(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        found = list(map(self.__getitem__, self.parts.findall(SPACE + text.replace(" ", SPACE))))
        return sum(n for n, _ in found), sum(s for _, s in found)


@lru_cache(maxsize=2)
def counter(model: bytes) -> Counter:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)
    return Counter({sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not special(i)})


def token_counts(docs: DataFrame, vocabulary: str = os.path.join(TOKENIZERS, MODEL), text: str = "text") -> DataFrame:
    """``docs`` with n_pieces and score, the piece count and score of the best path.

    A very long text takes its own size a few times over; a long part without spaces takes
    no more. The text is taken as it is, a space mark put before it and in place of each space. A
    null or empty text has 0 pieces and score 0. Rows are independent; columns called as
    the added ones are replaced; an empty table stays empty.
    """
    model = read_bytes(vocabulary)
    kind = pa.struct([("n_pieces", pa.int64()), ("score", pa.float64())])

    def run(texts: pa.Array) -> pa.Array:
        count = counter(model).count
        pairs = [count(x.as_py() or "") for x in texts]
        return pa.StructArray.from_arrays([pa.array([n for n, _ in pairs], pa.int64()), pa.array([s for _, s in pairs], pa.float64())], fields=list(kind))

    rows, back = apart(docs, {text}, {"n_pieces", "score"})
    counted = rows.withColumn("_counts", F.arrow_udf(run, COUNTS)(F.col(text)))
    return back(counted, F.col("_counts.n_pieces"), F.col("_counts.score"))
