"""Token-id files: patched frame-of-reference blocks with an index of block starts.

A file holds, in this order: MAGIC; the blocks of the ids; the blocks of the document lengths; the document
keys (one flag byte and a signed 64-bit integer each, flag 0 for null); the start of every block as unsigned
64-bit integers, ids first; and a footer with the numbers of ids, documents, id blocks and length blocks and
the places of keys and index. All integers are little-endian.

A block of up to `block` values keeps its minimum, subtracts it, and packs every difference at the width that
holds a given share of them; the rest are exceptions with position and full difference.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import arrow_slices, new_path, written
from attest.llm.tokenized import ENCODE_CHARS, text_encoder

MAGIC = b"PFORIDS1"
BLOCK = 4096
PACKED_SHARE = 0.95
_HEAD = struct.Struct("<QBII")  # minimum, width, values, exceptions
_FOOT = struct.Struct("<QQQQQQ8s")
READ_BYTES = 1 << 22
_WORD_WIDTH = 57  # wider values can lie in nine bytes


def pack_block(values: np.ndarray, share: float = PACKED_SHARE) -> bytes:
    values = values.astype(np.uint64)
    low = int(values.min())
    rest = values - np.uint64(low)
    at = min(len(rest) - 1, int(np.ceil(share * len(rest))) - 1)
    width = int(np.partition(rest, at)[at]).bit_length()
    wide = np.flatnonzero(rest >> np.uint64(width)) if width < 64 else np.empty(0, np.int64)
    low_bits = rest & np.uint64((1 << width) - 1) if width < 64 else rest
    bits = np.unpackbits(low_bits.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=width, bitorder="little") if width else np.empty(0, np.uint8)
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    return _HEAD.pack(low, width, len(rest), len(wide)) + packed + wide.astype("<u4").tobytes() + rest[wide].astype("<u8").tobytes()


def block_bytes(head: bytes) -> int:
    _, width, n, exceptions = _HEAD.unpack(head)
    return _HEAD.size + (width * n + 7) // 8 + 12 * exceptions


@lru_cache(maxsize=64)
def _places(width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first byte of each of `n` packed values, and the bits before it there."""
    bits = np.arange(n, dtype=np.int64) * width
    return bits >> 3, (bits & 7).astype(np.uint64)


def unpack_block(data: bytes) -> np.ndarray:
    low, width, n, exceptions = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = (width * n + 7) // 8
    rest = np.zeros(n, np.uint64)
    if 0 < width <= _WORD_WIDTH:
        # every value lies in the eight bytes from its first one on
        held = np.zeros(size + 8, np.uint8)
        held[:size] = np.frombuffer(data, np.uint8, size, at)
        first, shift = _places(width, n)
        rest = np.ndarray(size + 1, "<u8", held, strides=(1,))[first]
        rest >>= shift
        rest &= np.uint64((1 << width) - 1)
    elif width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), bitorder="little", count=width * n).reshape(n, width)
        whole = np.zeros((n, 64), np.uint8)
        whole[:, :width] = bits
        rest = np.packbits(whole, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)
    at += size
    places = np.frombuffer(data, "<u4", exceptions, at)
    rest[places] = np.frombuffer(data, "<u8", exceptions, at + 4 * exceptions)
    return rest + np.uint64(low)


class _Blocks:
    """Writes values in blocks as they come, and notes where each block starts."""

    def __init__(self, write, block: int, share: float):
        self._write, self._block, self._share = write, block, share
        self._held: list[np.ndarray] = []
        self._size = 0
        self.sizes: list[int] = []
        self.total = 0

    def add(self, values: np.ndarray, last: bool = False) -> None:
        self._held.append(values)
        self._size += len(values)
        self.total += len(values)
        if self._size < self._block and not last:
            return
        whole = np.concatenate(self._held)
        end = len(whole) if last else len(whole) - len(whole) % self._block
        for at in range(0, end, self._block):
            data = pack_block(whole[at : min(end, at + self._block)], self._share)
            self._write(data)
            self.sizes.append(len(data))
        self._held, self._size = [whole[end:]], len(whole) - end


def write_file(out, batches: Iterator[tuple[list, np.ndarray, np.ndarray]], block: int = BLOCK, share: float = PACKED_SHARE) -> tuple[int, int]:
    """Writes batches of (document keys, ids of all documents, ids per document); returns documents and ids."""
    out.write(MAGIC)
    ids = _Blocks(out.write, block, share)
    keys: list[bytes] = []
    counts: list[np.ndarray] = []
    n_docs = 0
    for names, values, lengths in batches:
        ids.add(values)
        keys.append(b"".join(struct.pack("<Bq", name is not None, name or 0) for name in names))
        counts.append(np.asarray(lengths, np.int64))
        n_docs += len(names)
    ids.add(np.empty(0, np.uint32), last=True)
    lengths = _Blocks(out.write, block, share)
    lengths.add(np.concatenate(counts) if counts else np.empty(0, np.int64), last=True)
    sizes = np.array(ids.sizes + lengths.sizes, np.uint64)
    starts = len(MAGIC) + np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
    out.write(b"".join(keys))
    out.write(starts[:-1].tobytes())
    keys_at = int(starts[-1])
    out.write(_FOOT.pack(ids.total, n_docs, len(ids.sizes), len(lengths.sizes), keys_at, keys_at + 9 * n_docs, MAGIC))
    return n_docs, ids.total


class TokenFile:
    """Reads a token-id file; any id is reached through the index of block starts."""

    def __init__(self, source, size: int, block: int = BLOCK):
        self._source, self._block = source, block
        source.seek(size - _FOOT.size)
        self.n_ids, self.n_docs, self._id_blocks, self._length_blocks, self._keys_at, self._index_at, magic = _FOOT.unpack(source.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file, or cut short")
        source.seek(self._index_at)
        self.starts = np.append(np.frombuffer(source.read(8 * (self._id_blocks + self._length_blocks)), "<u8"), self._keys_at).astype(np.int64)

    def _values(self, first: int, last: int) -> np.ndarray:
        """Values of the blocks [first, last)."""
        if first >= last:
            return np.empty(0, np.uint64)
        base = int(self.starts[first])
        self._source.seek(base)
        data = memoryview(self._source.read(int(self.starts[last]) - base))
        return np.concatenate([unpack_block(data[int(self.starts[i]) - base : int(self.starts[i + 1]) - base]) for i in range(first, last)])

    def ids(self, start: int, count: int) -> np.ndarray:
        if not count:
            return np.empty(0, np.uint32)
        first, last = start // self._block, (start + count - 1) // self._block + 1
        skip = start - first * self._block
        return self._values(first, last)[skip : skip + count].astype("<u4")

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Each document's key, the ids before it in this file, and its ids; about `at_once` ids are held, or one document."""
        lengths = self._values(self._id_blocks, self._id_blocks + self._length_blocks).astype(np.int64)
        self._source.seek(self._keys_at)
        raw = self._source.read(9 * self.n_docs)
        ends = np.cumsum(lengths)
        doc = 0
        while doc < self.n_docs:
            start = int(ends[doc] - lengths[doc])
            last = max(doc + 1, int(np.searchsorted(ends, start + at_once, "right")))
            held = self.ids(start, int(ends[last - 1]) - start)
            for i in range(doc, last):
                known, key = struct.unpack_from("<Bq", raw, 9 * i)
                at = int(ends[i] - lengths[i])
                yield (key if known else None), at, held[at - start : int(ends[i]) - start]
            doc = last


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(documents: DataFrame, tokenizer_path: str, end_id: int, drops_space: bool = True,
                      block: int = BLOCK, share: float = PACKED_SHARE) -> DataFrame:
    """Writes the ids of every text, each followed by `end_id`, in ascending doc_id order, and lists the files.

    Documents are range-partitioned on doc_id (null first) and sorted; each task writes one file below the
    shared folder. A retried task writes a file of another name, and only the names that the surviving task
    returns are listed. Returns one row per file: path, bytes, n_docs, n_ids, start (ids in files before it).

    Reads `doc_id` and `text` only, so other columns cannot clash. A null or empty text has the end id alone;
    repeated rows are written each; rows of one doc_id are ordered by text; an empty table
    gives no files.
    """
    spark = documents.sparkSession
    folder = new_path(spark, "token-ids")

    def write_task(batches):
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        encode = text_encoder(tokenizer_path, end_id, drops_space)
        system, base = _open(folder)
        system.create_dir(base, recursive=True)
        path = f"{base}/part-{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.ids"

        def coded():
            for batch in arrow_slices((x for part in ([first], batches) for x in part), ENCODE_CHARS):
                yield (batch.column("doc_id").to_pylist(), *encode(batch.column("text")))

        with system.open_output_stream(path) as out:
            n_docs, n_ids = write_file(out, coded(), block, share)
            size = out.tell()
        row = [[TaskContext.get().partitionId()], [path], [size], [n_docs], [n_ids]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in row], names=["task", "path", "bytes", "n_docs", "n_ids"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by_id = F.col("doc_id").asc_nulls_first()
    ranged = docs.repartitionByRange(by_id).sortWithinPartitions(by_id, F.col("text").asc_nulls_first())
    files = written(ranged.mapInArrow(write_task, "task long, path string, bytes long, n_docs long, n_ids long"), "token-files")
    # One row per file reaches the driver, as for any listing of files.
    rows, start = [], 0
    for row in files.orderBy("task").collect():
        rows.append((folder, row.path, row.bytes, row.n_docs, row.n_ids, start))
        start += row.n_ids
    return spark.createDataFrame(rows, "folder string, path string, bytes long, n_docs long, n_ids long, start long")


def read_token_files(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Reads listed files back: doc_id, start (ids of all documents before it), ids; one task per file."""

    def read_task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                system, _ = _open(row["folder"])
                with system.open_input_file(row["path"]) as source:
                    held, size = [], 0
                    for doc, at, ids in TokenFile(source, row["bytes"], block).documents():
                        held.append((doc, row["start"] + at, ids.tobytes()))
                        size += len(ids)
                        if size > READ_BYTES // 4:
                            yield _documents(held)
                            held, size = [], 0
                    if held:
                        yield _documents(held)

    return files.repartition(max(1, files.count())).mapInArrow(read_task, "doc_id long, start long, ids binary")


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    docs, starts, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])

