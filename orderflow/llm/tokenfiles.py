"""Token ids as flat binary files that readers map into memory.

A token file is a run of unsigned little-endian integers, 16 bits wide where the
vocabulary fits and 32 otherwise; beside it lies a file of 64-bit document offsets. A
partition of the range-sorted documents writes one such pair. Its base, the number of
ids in all partitions before it, is a prefix sum over the partitions' totals, so
``base + offset`` is a document's place in the whole sequence.

Files carry a name of their own for each attempt of a task. Only the index, a table that
Spark commits, names the files that count, so a task may fail or run twice.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderflow.llm.common import TOKENIZERS, cut, read_bytes, text_of

MODEL = "byte_bpe_50k.json"
END_ID = 0
#: White space as the byte-level splitting pattern means it: Python's own, less the
#: information separators. Between other text and white space no token crosses.
SPACE, OTHER = r"[^\S\x1c-\x1f]", r"[\S\x1c-\x1f]"
PIECE = re.compile(rf"{SPACE}*{OTHER}+|{SPACE}+")
BORDER = re.compile(rf"(?<={OTHER})(?={SPACE})")
#: Characters handled at once, and what a worker remembers: pieces of at most so many
#: characters, in at most so many bytes of ids and text. Neither changes a result.
BLOCK, KEPT_PIECE, KEPT_BYTES = 1 << 18, 48, 256 << 20


def place(uri: str):
    """(file system, path) of a folder of a shared store, by its URI."""
    from pyarrow import fs

    parts = urlparse(uri)
    return (fs.LocalFileSystem(), parts.path) if parts.scheme in ("", "file") else fs.FileSystem.from_uri(uri)


class Encoder(dict):
    """piece -> its ids as bytes, remembered up to KEPT_BYTES.

    A byte-level tokenizer with its usual pattern (no normalizer, no prefix space) encodes
    the pieces of a block it has not met, joined to one text; any other one whole texts.
    """

    def __init__(self, vocabulary: bytes):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary.decode())
        self.kind = "<u2" if max(self.tokenizer.get_vocab(True).values()) < 1 << 16 else "<u4"
        self.kept = 0
        spec = json.loads(vocabulary)
        split, added = spec["pre_tokenizer"] or {}, spec["added_tokens"]
        self.splits = (spec["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
                       and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(SPACE, t["content"]) for t in added))

    def _bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def __missing__(self, piece: str) -> bytes:
        return self._bytes(self.tokenizer.encode(piece, add_special_tokens=False).ids)

    def _learn(self, pieces: list[str]) -> None:
        """Ids of pieces that all begin with white space: encoded in a row they stay apart."""
        if not pieces:
            return
        found = self.tokenizer.encode("".join(pieces), add_special_tokens=False)
        starts = np.fromiter((a for a, _ in found.offsets), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        cuts = np.searchsorted(starts, sizes.cumsum()) * int(self.kind[-1])
        ids, at = self._bytes(found.ids), 0
        for piece, end in zip(pieces, cuts.tolist()):
            self[piece] = ids[at:end]
            at = end
        self.kept += 200 * len(pieces) + len(ids) + 4 * int(sizes.sum())

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids of a text, block by block."""
        if not self.splits:
            yield self[text]
            return
        at = 0
        while at < len(text):
            border = BORDER.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            end = border.start() if border else len(text)
            pieces = PIECE.findall(text[at:end])
            if self.kept > KEPT_BYTES:
                self.clear()
                self.kept = 0
            found = list(map(self.get, pieces))
            if None in found:
                unmet = [i for i, ids in enumerate(found) if ids is None]
                self._learn([p for p in dict.fromkeys([pieces[i] for i in unmet]) if len(p) <= KEPT_PIECE and p[0] in " \n\t" and not p.isspace()])
                for i in unmet:
                    found[i] = self[pieces[i]]
            yield b"".join(found)
            at = end


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes) -> Encoder:
    return Encoder(vocabulary)


def write_token_files(docs: DataFrame, path: str, vocabulary: str = os.path.join(TOKENIZERS, MODEL), end_id: int = END_ID) -> DataFrame:
    """Write the ids of all documents under ``path``; return the index (doc_id, part, slot, width, n_tokens).

    Documents go in ascending doc_id order, nulls first; rows of one doc_id as they
    are read, so repeated rows and nulls spread over many partitions. A null or empty
    text is its end id alone. Texts are encoded whole but handled in blocks that end
    before white space, so a very long one takes a block's memory; text without white
    space is one piece of the tokenizer and is held whole. Only doc_id and text are read,
    so other columns cannot clash. An empty table gives an empty index and no file.
    """
    model = read_bytes(vocabulary)
    rows = docs.select("doc_id", text_of().alias("text"))
    keyed = rows.select("doc_id", F.monotonically_increasing_id().alias("i"), "text")
    ordered = keyed.repartitionByRange("doc_id", "i").sortWithinPartitions("doc_id", "i").select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(model)
        width = int(encode.kind[-1])
        end = np.array([end_id], encode.kind).tobytes()
        # named by the partition, whose number is its rank, and by the attempt
        part, (store, folder) = f"{TaskContext.get().partitionId():010d}-{uuid.uuid4().hex}", place(path)
        offsets, ids = array("Q", [0]), None
        for batch in batches:
            if batch.num_rows and ids is None:
                store.create_dir(folder, recursive=True)
                ids = store.open_output_stream(f"{folder}/{part}.bin")
            first = len(offsets) - 1
            for text in batch.column(1):
                n = 0
                for block in encode.encode(text.as_py()):
                    n += ids.write(block)
                n += ids.write(end)
                offsets.append(offsets[-1] + n // width)
            here = np.array(offsets[first:], np.int64)
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([part] * batch.num_rows), pa.array(np.arange(first, first + batch.num_rows)),
                     pa.array(np.full(batch.num_rows, width, np.int32)), pa.array(np.diff(here))],
                    names=["doc_id", "part", "slot", "width", "n_tokens"])
        if ids is not None:
            ids.close()
            with store.open_output_stream(f"{folder}/{part}.off") as out:
                out.write(np.array(offsets, "<u8").tobytes())

    return cut(ordered.mapInArrow(run, f"doc_id {id_type}, part string, slot long, width int, n_tokens long"))


def bases(index: DataFrame) -> DataFrame:
    """(part, base): the ids before each part, a prefix sum over one row a part; names are in document order."""
    total = index.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return total.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("base"))


class Mapped:
    """One token file, mapped into memory where the store is a mounted one."""

    def __init__(self, path: str, part: str, width: int):
        store, folder = place(path)
        self.offsets, self.ids = (self._map(store, f"{folder}/{part}.{kind}", dtype)
                                  for kind, dtype in (("off", "<u8"), ("bin", f"<u{width}")))

    @staticmethod
    def _map(store, name: str, dtype: str) -> np.ndarray:
        if store.type_name == "local":
            return np.memmap(name, dtype, mode="r")
        with store.open_input_file(name) as f:
            return np.frombuffer(f.read_buffer(), dtype)

    def document(self, slot: int) -> tuple[int, np.ndarray]:
        start, end = int(self.offsets[slot]), int(self.offsets[slot + 1])
        return start, self.ids[start:end]


def checksum(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit integers, a block at a time."""
    crc = 0
    for at in range(0, len(ids), BLOCK):
        crc = zlib.crc32(ids[at:at + BLOCK].astype("<u4").tobytes(), crc)
    return crc


def read_token_files(index: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; with ``ids`` also the ids.

    ``start`` counts the ids of all documents before it.
    """
    fields = "doc_id {}, part string, offset long, n_tokens long, ids_crc32 long".format(index.schema["doc_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            starts, counts, sums, lists = [], [], [], []
            for part, slot, width in zip(*(batch.column(c).to_pylist() for c in ("part", "slot", "width"))):
                if part != name:
                    name, file = part, Mapped(path, part, width)
                start, found = file.document(slot)
                starts.append(start)
                counts.append(len(found))
                sums.append(checksum(found))
                if ids:
                    lists.append(found.astype(np.int64))
            out = [batch.column("doc_id"), batch.column("part"), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(sums, pa.int64())]
            names = ["doc_id", "part", "offset", "n_tokens", "ids_crc32"]
            if ids:
                out, names = [*out, pa.array(lists, pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    read = index.mapInArrow(run, fields + (", ids array<bigint>" if ids else ""))
    start: Column = F.col("base") + F.col("offset")
    return read.join(bases(index), "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files beside the checkpoints, which all executors share."""
    from orderflow.session import scratch_path

    return scratch_path(spark, f"tokens-{uuid.uuid4().hex}")
