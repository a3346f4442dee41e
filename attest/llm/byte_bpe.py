"""Byte-level BPE: every distinct word of the corpus is encoded once, and texts are put together by position.

1. Each task cuts its texts into pre-tokens (matches of the pattern) and keeps a chapter: the distinct words
   of a bounded amount of text, and for each document the words' numbers in order of position. The numbers stay
   in a file of the shared folder, one for each chapter.
2. The chapters' words are shuffled by word, in packed runs, and each distinct word is merged into ids once.
3. The ids of a chapter meet, its file is read, and each document's ids are gathered by position.
4. Decoding joins ids with the token-byte table, whose size is the vocabulary's and is checked.
"""

from __future__ import annotations

import base64
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from attest.llm.common import Pool, arrow_slices, new_path, open_folder, ragged, small_batches, space_pieces, written
from attest.llm.tokenized import ENCODE_CHARS

CHAPTER_WORDS = 300_000
CHAPTER_CHARS = 32_000_000
KEPT_WORDS = 100_000
TABLE_BYTES = 64 << 20
_CHAPTER = "chapter long, folder string, path string, shard int, words binary, places binary, size long"
_DOCS = pa.schema([(c, pa.binary()) for c in ("docs", "known", "counts", "numbers")])


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def byte_merger(ranks: dict[bytes, int]):
    """The ids of one word: neighbouring parts are merged, lowest rank first, leftmost on ties."""
    import tiktoken

    # The word is one match, so that the library only merges.
    whole = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    return whole.encode_ordinary


class _Chapter:
    """Distinct words numbered as they come, with the numbers of the pieces between spaces kept; documents go to a file."""

    def __init__(self, pattern, system, path: str):
        self.words: dict[str, int] = {}
        self.chars = 0
        self.path = path
        self._file = system.open_output_stream(path)
        self._docs = pa.ipc.new_stream(self._file, _DOCS)
        number = self.words

        def numbers(pieces: list[str]) -> tuple[list[int], np.ndarray]:
            found = [pattern.findall(p) for p in pieces]
            flat = [number.setdefault(w, len(number)) for words in found for w in words]
            return flat, np.fromiter(map(len, found), np.int64, len(found))

        self.pool = Pool(numbers, limit=2 * CHAPTER_WORDS)

    def add(self, docs: list, texts: pa.Array) -> None:
        known = len(self.words)
        numbers, counts = self.pool.run(*space_pieces(texts))
        self.chars += pc.sum(pc.utf8_length(texts)).as_py()
        cells = (np.array([d or 0 for d in docs], "<i8").tobytes(), np.array([d is not None for d in docs], np.uint8).tobytes(),
                 counts.astype("<i8").tobytes(), _planes(_marked(numbers, known)))
        self._docs.write_batch(pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], schema=_DOCS))

    def close(self) -> None:
        self._docs.close()
        self._file.close()


def _packed(values: list[bytes]) -> bytes:
    return zlib.compress(np.array([len(d) for d in values], "<u4").tobytes() + b"".join(values), 1)


def _unpacked(data: bytes, n: int) -> list[bytes]:
    data = zlib.decompress(data)
    ends = np.cumsum(np.frombuffer(data, "<u4", n), dtype=np.int64).tolist()
    body, start, out = data[4 * n :], 0, []
    for end in ends:
        out.append(body[start:end])
        start = end
    return out


def _planes(numbers: np.ndarray) -> bytes:
    """Integers by planes of equal bytes, which compress better than whole ones."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _marked(numbers: np.ndarray, known: int) -> np.ndarray:
    """`known`, then the numbers with 0 for each word met for the first time, as such words are numbered in turn."""
    numbers = np.asarray(numbers, np.int64)
    before = np.maximum.accumulate(np.concatenate(([known - 1], numbers)))[:-1]
    return np.concatenate(([known], np.where(numbers > before, 0, numbers + 1)))


def _unmarked(marked: np.ndarray) -> np.ndarray:
    numbers, new = marked[1:] - 1, marked[1:] == 0
    numbers[new] = marked[0] + np.arange(np.count_nonzero(new))
    return numbers


def _chapters(documents: DataFrame, pattern: str, shards: int) -> DataFrame:
    """A row for each chapter with its file of documents, and rows of words with the steps between their numbers, one for each shard.

    A retried task writes files of other names, and only those that the surviving task names are read.
    """
    folder = new_path(documents.sparkSession, "chapter-files")

    def task(batches):
        import regex

        compiled = regex.compile(pattern)
        number, chapter = 0, None
        base = TaskContext.get().partitionId() << 32

        def row(path=None, words=(None,) * 4):
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 2, pa.int64())
            arrays = [pa.array([c], k) for c, k in zip((base + number, path and folder, path, *words), kinds)]
            return pa.RecordBatch.from_arrays(arrays, names=["chapter", "folder", "path", "shard", "words", "places", "size"])

        def ended():
            chapter.close()
            yield row(path=chapter.path)
            words = list(chapter.words)
            dealt = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % shards for w in words), np.int32, len(words))
            order = np.argsort(dealt, kind="stable")
            for places in np.split(order, np.flatnonzero(np.diff(dealt[order])) + 1) if len(words) else []:
                data = _packed([words[p].encode("utf-8", "surrogatepass") for p in places.tolist()])
                yield row(words=(int(dealt[places[0]]), data, _planes(np.diff(places, prepend=0)), len(places)))

        for batch in arrow_slices(batches, ENCODE_CHARS):
            if chapter is None:
                system, place = open_folder(folder)
                system.create_dir(place, recursive=True)
                chapter = _Chapter(compiled, system, f"{place}/{base + number:x}-{uuid.uuid4().hex}")
            chapter.add(batch.column("doc_id").to_pylist(), batch.column("text"))
            if len(chapter.words) > CHAPTER_WORDS or chapter.chars > CHAPTER_CHARS:
                yield from ended()
                number, chapter = number + 1, None
        if chapter is not None:
            yield from ended()

    with small_batches(documents.sparkSession):
        return written(documents.mapInArrow(task, _CHAPTER), "chapters")


def _encoded_words(chapters: DataFrame, tokenizer_path: str) -> DataFrame:
    """chapter, places, lengths, ids of each chapter's words; equal words meet in one task and are merged once.

    A task keeps the merged words of one shard, KEPT_WORDS and those of one row at most; beyond that a word is merged again.
    """

    def merge(batches):
        encode = byte_merger(ranks_of(tokenizer_path))
        shard, kept = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != shard or len(kept) > KEPT_WORDS:
                    shard, kept = row["shard"], {}
                out = []
                for word in _unpacked(row["words"], row["size"]):
                    if (ids := kept.get(word)) is None:
                        ids = kept[word] = np.array(encode(word.decode("utf-8", "surrogatepass")), "<u4").tobytes()
                    out.append(ids)
                cells = (row["chapter"], row["places"], _planes(np.array([len(i) // 4 for i in out])), _planes(np.frombuffer(b"".join(out), "<u4")))
                kinds = (pa.int64(), *[pa.binary()] * 3)
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=["chapter", "places", "lengths", "ids"])

    rows = chapters.filter("words is not null").select("chapter", "shard", "words", "places", "size")
    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(merge, "chapter long, places binary, lengths binary, ids binary")


def _read(folder: str, path: str) -> list[dict]:
    system, _ = open_folder(folder)
    with system.open_input_stream(path) as source:
        return pa.ipc.open_stream(source).read_all().to_pylist()


def encode(documents: DataFrame, tokenizer_path: str, pattern: str) -> DataFrame:
    """Ids of every whole text by the ranks of `tokenizer_path`, each match of `pattern` alone: doc_id, ids.

    ids are little-endian unsigned 32-bit integers. The words of a chapter are at most CHAPTER_WORDS and those
    of one more slice of texts, so what meets in one task is bounded; a frequent word is sent once per chapter,
    the numbers of a text's words are stored once and never shuffled.

    Reads `doc_id` and `text` only, so other columns cannot clash. A null or empty text has no ids; a null
    doc_id is kept; repeated rows are encoded each; an empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # More shards than tasks, so that tasks get even shares; a chapter has one row of words for each.
    shards = 2 * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chapters = _chapters(docs, pattern, shards)
    words = _encoded_words(chapters, tokenizer_path)

    def assemble(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.select(["places", "lengths", "ids"]).to_pylist()
        places = np.concatenate([np.cumsum(_numbers(r["places"])) for r in rows] or [np.zeros(0, np.int64)])
        lengths = np.concatenate([_numbers(r["lengths"]) for r in rows] or [np.zeros(0, np.int64)])
        flat = np.concatenate([_numbers(r["ids"]) for r in rows] or [np.zeros(0, np.int64)]).astype("<u4")
        order = np.argsort(places)
        if len(order) != (places[order[-1]] + 1 if len(order) else 0):
            raise ValueError("a chapter's words are incomplete")
        starts = (np.cumsum(lengths) - lengths)[order]
        lengths = lengths[order]
        names, encoded = [], []
        for row in (r for place in left.select(["folder", "path"]).to_pylist() for r in _read(**place)):
            docs = np.frombuffer(row["docs"], "<i8").tolist()
            known = np.frombuffer(row["known"], np.uint8).tolist()
            counts = np.frombuffer(row["counts"], "<i8")
            at = _unmarked(_numbers(row["numbers"]))
            size = lengths[at]
            all_ids = flat[ragged(starts[at], size)]
            bounds = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
            for i, doc in enumerate(docs):
                names.append(doc if known[i] else None)
                encoded.append(all_ids[bounds[i] : bounds[i + 1]].tobytes())
        return pa.table({"doc_id": pa.array(names, pa.int64()), "ids": pa.array(encoded, pa.binary())})

    files = chapters.filter("path is not null").select("chapter", "folder", "path")
    return files.groupBy("chapter").cogroup(words.groupBy("chapter")).applyInArrow(assemble, "doc_id long, ids binary")


def token_table(spark, tokenizer_path: str):
    """Bytes of every token, broadcast; refused beyond TABLE_BYTES, as only a vocabulary is meant."""
    ranks = ranks_of(tokenizer_path)
    size = sum(map(len, ranks))
    if size + 8 * len(ranks) > TABLE_BYTES:
        raise ValueError(f"a token table of {size} bytes is too large to broadcast")
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return spark.sparkContext.broadcast(tokens)


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Joins the ids of each row with the token-byte table: all columns, and `decoded`, the bytes in id order.

    Null ids give null; no ids give no bytes; an id outside of the table is an error.
    """
    table = token_table(encoded.sparkSession, tokenizer_path)

    def task(batches):
        tokens = table.value
        lengths = np.array([len(t) for t in tokens], np.int64)
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        for batch in batches:
            out = []
            for ids in batch.column("ids").to_pylist():
                at = None if ids is None else np.frombuffer(ids, "<u4").astype(np.int64)
                out.append(None if ids is None else flat[ragged(starts[at], lengths[at])].tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    schema = StructType([*encoded.schema.fields]).add("decoded", BinaryType())
    return encoded.mapInArrow(task, schema)
