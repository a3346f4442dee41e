"""Bounded-space online packing of token sequences."""

from __future__ import annotations

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import arrow_slices, written
from attest.llm.tokenized import ENCODE_CHARS, TextEncoder, text_encoder

OPEN_WINDOWS = 64
MERGE_PARTITIONS = 32
PIECE = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long, part long"
_MERGED = 1 << 62


class Packer:
    """A fixed number of open windows. Rests go to the window they fit best; when none fits, the fullest is emitted."""

    def __init__(self, capacity: int, open_windows: int, first_id: int):
        self.capacity, self.most, self.next_id = capacity, open_windows, first_id
        self.open: list[list] = []  # [free, pieces]
        self.done: list[tuple] = []  # pieces with sequence and offset

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, ids.tobytes(), total, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def add(self, doc, ids, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        full = len(ids) - len(ids) % self.capacity
        for at in range(0, full, self.capacity):
            self._emit([(doc, start + at, ids[at : at + self.capacity], total)])
        rest = ids[full:]
        if not len(rest):
            return
        piece = (doc, start + full, rest, total)
        best = min((w for w in self.open if w[0] >= len(rest)), key=lambda w: w[0], default=None)
        if best is None:
            if len(self.open) == self.most:
                fullest = min(range(self.most), key=lambda i: self.open[i][0])
                self._emit(self.open.pop(fullest)[1])
            self.open.append([self.capacity - len(rest), [piece]])
            return
        best[0] -= len(rest)
        best[1].append(piece)
        if not best[0]:
            self._emit(best[1])
            self.open = [w for w in self.open if w is not best]

    def leftovers(self) -> list[tuple]:
        return [piece for _, pieces in self.open for piece in pieces]


def merge(pieces: list[tuple], capacity: int, first_id: int) -> list[tuple]:
    """Fills windows to the end, cutting a piece where a window is full; only the last window keeps padding."""
    packer, window, held = Packer(capacity, 1, first_id), [], 0
    for doc, start, ids, total in pieces:
        while len(ids):
            part = ids[: capacity - held]
            window.append((doc, start, part, total))
            held, start, ids = held + len(part), start + len(part), ids[len(part) :]
            if held == capacity:
                packer._emit(window)
                window, held = [], 0
    if window:
        packer._emit(window)
    return packer.done


def _rows(pieces: list[tuple], part) -> pa.RecordBatch:
    """Rows of the schema PIECE; `pieces` are doc, start, ids, doc_tokens, sequence, offset."""
    columns = list(zip(*pieces)) if pieces else [()] * 6
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds)] + [pa.array([part] * len(pieces), pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset", "part"])


def pack(documents: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 2048, drops_space: bool = False,
         open_windows: int = OPEN_WINDOWS, keep_words: bool = True) -> DataFrame:
    """Packs the token ids of every text, each followed by `end_id`, into sequences of at most `capacity` ids.

    Each task packs its own documents online: pieces of `capacity` ids are sequences of their own, the rest
    goes to the open window it fits best, and when none of the `open_windows` fits, the fullest is emitted.
    What is open at the end of a task (at most `open_windows` windows) meets the leftovers of
    MERGE_PARTITIONS tasks, and is merged there by filling windows to the end. Nothing is dropped.
    Without `keep_words` a worker's encoded words go with its task, which takes less memory and more time.

    Reads `doc_id` and `text` only, so other columns cannot clash. A null or empty text has the end id alone; a
    null doc_id is kept; repeated rows are documents of their own; an empty table gives no rows.
    Returns pieces: doc_id, start, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.
    """

    def pack_task(batches):
        encode = (text_encoder if keep_words else TextEncoder)(tokenizer_path, end_id, drops_space)
        task = TaskContext.get().partitionId()
        packer = Packer(capacity, open_windows, task << 32)
        for batch in arrow_slices(batches, ENCODE_CHARS):
            ids, counts = encode(batch.column("text"))
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), counts.tolist()):
                packer.add(doc, ids[at : at + n])
                at += n
            yield _rows(packer.done, None)
            packer.done = []
        left = [(doc, start, ids.tobytes(), total, None, None) for doc, start, ids, total in packer.leftovers()]
        yield _rows(left, task // MERGE_PARTITIONS)

    def merge_task(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        import numpy as np

        names = ("doc_id", "start", "ids", "doc_tokens")
        rows = sorted(zip(*(table.column(n).to_pylist() for n in names)), key=lambda r: (-len(r[2]), r[0] is None, r[0] or 0, r[1]))
        pieces = [(doc, start, np.frombuffer(ids, "<u4"), total) for doc, start, ids, total in rows]
        return pa.Table.from_batches([_rows(merge(pieces, capacity, _MERGED + (key[0].as_py() << 32)), None)])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    placed = written(docs.mapInArrow(pack_task, PIECE), "packed")
    merged = placed.filter("part is not null").groupBy("part").applyInArrow(merge_task, PIECE)
    return placed.filter("part is null").unionByName(merged).drop("part")
