"""Quality rules with tokeniser fertility.

Two public vocabularies measure each text, word by word (a word with one space
before it): a byte-level BPE for many languages and a piece BPE with byte fallback.
Taken are characters per token of either, the share of byte-fallback tokens, and the
entropy of the text's own token distribution. Bands of these per language (or per
script, for other languages) reject texts that the vocabularies find alien or that
repeat a few tokens. Words recur, so each task keeps the tokens of words it has met.
"""

from __future__ import annotations

import base64
import os
import re
from array import array
from collections.abc import Mapping
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderflow.llm.common import TOKENIZERS, read_bytes

BYTE_BPE, PIECE_BPE = "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"
#: The rank file's splitting pattern (fixed value of that vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Least and most characters per token (byte BPE; piece BPE), most byte-fallback share,
#: least token entropy in bits. The four languages' lower edges lie below the least value of
#: any text labelled clean at sf0.1, times 0.94, 0.91 and 0.96 (tokens, pieces, entropy): how
#: far the least value of one half of these texts lies below the other half's in 1 of 100
#: random halvings. No labelled text has byte fallbacks, so these edges, the upper ones and
#: the scripts' are wide: a band must not cost a clean document.
BANDS: dict[str, tuple[float, float, float, float, float, float]] = {
    "en": (1.86, 8.0, 1.68, 8.0, 0.10, 5.32),
    "de": (2.03, 8.0, 1.86, 8.0, 0.10, 5.59),
    "fr": (1.69, 8.0, 1.50, 8.0, 0.10, 5.42),
    "es": (1.80, 8.0, 1.63, 8.0, 0.10, 5.48),
    "Latin": (1.2, 9.0, 1.2, 9.0, 0.20, 3.0),
    "Greek": (0.6, 6.0, 0.6, 6.0, 0.60, 3.0),
    "Cyrillic": (0.8, 7.0, 0.8, 7.0, 0.40, 3.0),
    "Arabic": (0.5, 6.0, 0.5, 6.0, 0.70, 3.0),
    "Han": (0.3, 3.0, 0.3, 3.0, 0.90, 3.0),
    "other": (0.2, 9.0, 0.2, 9.0, 0.95, 2.5),
}
#: First and last code points of the scripts' main blocks.
SCRIPTS = {"Latin": ((0x41, 0x24F),), "Greek": ((0x370, 0x3FF),), "Cyrillic": ((0x400, 0x52F),), "Arabic": ((0x600, 0x6FF),), "Han": ((0x3040, 0x30FF), (0x4E00, 0x9FFF))}

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A task forgets its words beyond so many, or beyond so many bytes of words and tokens at
#: the end of a text, which bounds its memory by that and one text, and changes no result.
KEPT_WORDS, KEPT_BYTES = 400_000, 64 << 20

#: Words of these letters and signs, joined by a space, have the tokens they have alone: no
#: normal form of them has a space or is empty. Others are encoded one by one.
PLAIN = re.compile("[ !-~\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u017F]+")
JOINED_WORDS = 1024

_CONTINUATION = bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"

MEASURES = "struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,n_tokens:long,n_pieces:long,chars_per_token:double,chars_per_piece:double,byte_fallback_share:double,token_entropy:double,band:string>"


@lru_cache(maxsize=2)
def encoders(ranks: bytes, model: bytes):
    """Tokenizers of this Python worker, the bytes of each token, and which piece ids are
    byte fallbacks and which begin a word (None where pieces may reach over a space)."""
    import sentencepiece
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    bpe = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=merges, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
    is_byte = np.array([pieces.is_byte(i) for i in range(pieces.vocab_size())])
    token_bytes = np.zeros(max(merges.values()) + 1, np.int64)
    token_bytes[np.fromiter(merges.values(), np.int64)] = np.fromiter(map(len, merges), np.int64)
    names = [pieces.id_to_piece(i) for i in range(pieces.vocab_size())]
    apart = pieces.encode("a b") == pieces.encode("a") + pieces.encode("b") and not any(x.strip("\u2581") and "\u2581" in x[1:] for x in names)
    begins = np.array([x.startswith("\u2581") for x in names]) if apart else None
    return bpe, pieces, token_bytes, is_byte, begins


class Words(dict):
    """word -> number; by number its tokens (in one array, with their ends) and counts of pieces and byte fallbacks."""

    def __init__(self, ranks: bytes, model: bytes):
        super().__init__()
        self.bpe, self.sp, self.token_bytes, self.is_byte, self.begins = encoders(ranks, model)
        self.tokens, self.ends = array("i"), array("q", [0])
        self.pieces, self.fallbacks = array("q"), array("q")
        self.new: list[bytes] = []
        self.held = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def settle(self) -> None:
        for i in range(0, len(self.new), JOINED_WORDS):
            new = self.new[i:i + JOINED_WORDS]
            joined = b" ".join(new).decode("utf-8", "replace")
            if self.begins is None or not PLAIN.fullmatch(joined) or not self._together(new, joined):
                self._alone([word.decode("utf-8", "replace") for word in new])
            self.held += sum(map(len, new))
        self.new.clear()

    def _together(self, new: list[bytes], joined: str) -> bool:
        ids = np.array(self.sp.encode(joined), np.int64)
        starts = np.flatnonzero(self.begins[ids])
        tokens = np.array(self.bpe.encode_ordinary(" " + joined), np.int32)
        reach = np.cumsum(self.token_bytes[tokens])
        ends = np.cumsum(np.fromiter(map(len, new), np.int64, len(new)) + 1)
        upto = np.searchsorted(reach, ends)
        if len(starts) != len(new) or starts[0] or not np.array_equal(reach[upto], ends):
            return False
        self._keep(tokens, upto + 1, ids, np.append(starts[1:], len(ids)))
        return True

    def _alone(self, new: list[str]) -> None:
        tokens = [self.bpe.encode_ordinary(" " + text) for text in new]
        ids = self.sp.encode(new, num_threads=1)
        ends, upto = (np.cumsum(np.fromiter(map(len, x), np.int64, len(new))) for x in (ids, tokens))
        self._keep(np.fromiter(chain.from_iterable(tokens), np.int32, upto[-1]), upto, np.fromiter(chain.from_iterable(ids), np.int64, ends[-1]), ends)

    def _keep(self, tokens: np.ndarray, upto: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        """The words' tokens and pieces, one word after the other, with their ends."""
        first = len(self.tokens)
        self.tokens.frombytes(tokens.tobytes())
        self.ends.frombytes((first + upto).astype(np.int64).tobytes())
        fallbacks = np.append(0, np.cumsum(self.is_byte[ids]))[ends]
        self.pieces.frombytes(np.diff(ends, prepend=0).astype(np.int64).tobytes())
        self.fallbacks.frombytes(np.diff(fallbacks, prepend=0).astype(np.int64).tobytes())
        self.held += 4 * len(tokens)

    def tokens_of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' tokens, one word after the other, and how many each has."""
        ends = np.frombuffer(self.ends, np.int64)
        start = ends[numbers]
        sizes = ends[numbers + 1] - start
        at = np.repeat(start - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return np.frombuffer(self.tokens, np.int32)[at], sizes


def script(text: str) -> str:
    """The script of most letters, by the blocks in SCRIPTS."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = {name: sum(int(((points >= a) & (points <= b)).sum()) for a, b in blocks) for name, blocks in SCRIPTS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def repeated(local: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more; words are numbered from 0."""
    n = len(local)
    if n < 4:
        return 0
    m = int(local.max()) + 1
    windows = (local[:-2] * m + local[1:-1]) * m + local[2:] if m < 2_000_000 else np.unique(np.stack([local[:-2], local[1:-1], local[2:]]), axis=1, return_inverse=True)[1].ravel()
    ordered = np.sort(windows)
    more = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(more):
        return 0
    twice = more[np.minimum(np.searchsorted(more, windows), len(more) - 1)] == windows
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip():
            n += line in seen
            seen.add(line)
    return n


def measure(text: bytes, lang: str | None, words: Words, bands: Mapping) -> dict:
    found = text.split()  # bytes split at space and TAB..CR
    n = len(found)
    chars = len(b"".join(found).translate(None, _CONTINUATION))
    ids = np.fromiter(map(words.__getitem__, found), np.int64, n)
    words.settle()
    unique, local, counts = np.unique(ids, return_inverse=True, return_counts=True)
    tokens = pieces = fallbacks = 0
    entropy = 0.0
    if n:
        found_tokens, sizes = words.tokens_of(unique)
        _, inverse = np.unique(found_tokens, return_inverse=True)
        weight = np.bincount(inverse, np.repeat(counts, sizes))
        tokens = int(weight.sum())
        entropy = float(np.log2(tokens) - (weight * np.log2(weight)).sum() / tokens)
        pieces = int((counts * np.frombuffer(words.pieces, np.int64)[unique]).sum())
        fallbacks = int((counts * np.frombuffer(words.fallbacks, np.int64)[unique]).sum())
    return {"n_words": n, "word_chars": chars, "n_symbols": len(text) - len(text.translate(None, _SYMBOLS)), "n_dup_lines": duplicate_lines(text), "n_repeat_words": repeated(local),
            "n_tokens": tokens, "n_pieces": pieces, "chars_per_token": chars / tokens if tokens else None, "chars_per_piece": chars / pieces if pieces else None,
            "byte_fallback_share": fallbacks / pieces if pieces else None, "token_entropy": entropy if n else None, "band": lang if lang in bands else script(text.decode("utf-8", "replace"))}


def measures(vocabularies: str = TOKENIZERS, bands: Mapping = BANDS):
    """An Arrow UDF of (text, language); ``vocabularies`` is the folder of the two files."""
    ranks, model = read_bytes(os.path.join(vocabularies, BYTE_BPE)), read_bytes(os.path.join(vocabularies, PIECE_BPE))
    kind = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_tokens", pa.int64()), ("n_pieces", pa.int64()),
                      ("chars_per_token", pa.float64()), ("chars_per_piece", pa.float64()), ("byte_fallback_share", pa.float64()), ("token_entropy", pa.float64()), ("band", pa.string())])

    def run(batches):
        words = Words(ranks, model)
        for texts, langs in batches:
            rows = []
            for text, lang in zip(texts.cast(pa.binary()), langs):
                if len(words) > KEPT_WORDS or words.held > KEPT_BYTES:
                    words = Words(ranks, model)
                rows.append(measure(text.as_py() or b"", lang.as_py(), words, bands))
            yield pa.array(rows, kind)

    from collections.abc import Iterator
    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, MEASURES)


def in_bands(m: str, bands: Mapping = BANDS) -> Column:
    """Whether the measures in struct ``m`` lie in their band; a text without words has none and does."""
    ok = F.lit(True)
    for name, (low, high, low2, high2, share, entropy) in bands.items():
        inside = (F.col(f"{m}.chars_per_token").between(low, high) & F.col(f"{m}.chars_per_piece").between(low2, high2)
                  & (F.col(f"{m}.byte_fallback_share") <= share) & (F.col(f"{m}.token_entropy") >= entropy))
        ok = F.when(F.col(f"{m}.band") == name, F.coalesce(inside, F.lit(True))).otherwise(ok)
    return ok


def quality(docs: DataFrame, vocabularies: str = TOKENIZERS, bands: Mapping = BANDS, column: str = "quality") -> DataFrame:
    """``docs`` (text, and lang if there is one) with struct ``column``: the measures, base_failed and kept.

    A null text is an empty one: no words, measures null, base_failed. A null or unknown
    language takes the band of its script. Copies and ties don't matter: each row is
    judged alone. An existing column of that name is replaced; an empty table stays empty.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    out = docs.withColumn(column, measures(vocabularies, bands)(F.col("text"), lang))
    failed = (F.col(f"{column}.n_words") < MIN_WORDS) | (100 * F.col(f"{column}.n_repeat_words") > MAX_REPEAT_PERCENT * F.col(f"{column}.n_words"))
    return out.withColumn(column, F.struct(f"{column}.*", failed.alias("base_failed"), (~failed & in_bands(column, bands)).alias("kept")))
