"""What the operators share: shared folders, written tables, slices of texts, the pool of word encodings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# Characters of text that a Python task works on at a time; a longer text is a slice of its own.
SLICE_CHARS = 2_000_000
# Bytes of an Arrow batch of texts where tasks need the memory for other things; a longer text is a batch of its own.
BATCH_BYTES = 2_000_000

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session without one gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _own_folders:
        own = tempfile.mkdtemp(prefix="attest-llm-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_folders[context.applicationId] = own
    return _own_folders[context.applicationId]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def open_folder(folder: str):
    """The Arrow file system of a shared folder, and the folder's path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a Parquet table in the shared folder, read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession):
    """What runs inside gets Arrow batches of BATCH_BYTES: a batch is held in the JVM, twice while it grows, and in Python."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def plain_names(df: DataFrame, *kept: str) -> DataFrame:
    """`df` with columns numbered, save those in `kept`: the Arrow maps of Spark take no names with dots."""
    return df.toDF(*(c if c in kept else f"column{i}" for i, c in enumerate(df.columns)))


def slices(lengths: list[int], most: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most `most` characters together."""
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield start, len(lengths)


def arrow_slices(batches, most: int = SLICE_CHARS):
    """Slices of Arrow batches with a column `text`, at most `most` characters each; null texts become empty."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        batch = batch.set_column(at, "text", pc.fill_null(batch.column(at), ""))
        for start, stop in slices(pc.utf8_length(batch.column(at)).to_pylist(), most):
            yield batch.slice(start, stop - start)


def text_batches(batches, most: int = SLICE_CHARS):
    """The same slices with their texts as a list."""
    for batch in arrow_slices(batches, most):
        yield batch, batch.column("text").to_pylist()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the runs [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Pool:
    """Encodings of distinct strings, kept while there are at most `limit` of them.

    `encode` turns a list of new strings into their integers, all together, and how many each has. A string is
    encoded once for as long as it is kept, so a frequent word costs a look-up.
    """

    def __init__(self, encode, limit: int = 600_000):
        self._encode, self._limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat = np.empty(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.lengths = np.zeros(1 << 14, np.int64)
        self.used = 0

    @staticmethod
    def _room(array: np.ndarray, size: int) -> np.ndarray:
        if size <= len(array):
            return array
        larger = np.zeros(max(size, 2 * len(array)), array.dtype)
        larger[: len(array)] = array
        return larger

    def _add(self, new: list[str]) -> None:
        values, lengths = self._encode(new)
        first, last = len(self.index), len(self.index) + len(new)
        self.flat = self._room(self.flat, self.used + len(values))
        self.starts, self.lengths = self._room(self.starts, last), self._room(self.lengths, last)
        self.flat[self.used : self.used + len(values)] = values
        self.starts[first:last] = self.used + np.cumsum(lengths) - lengths
        self.lengths[first:last] = lengths
        self.used += len(values)
        self.index.update(zip(new, range(first, last)))

    def run(self, pieces: pa.Array, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The encodings of all strings in order, and how many integers each group of `counts` strings has."""
        if len(self.index) > self._limit:
            self._clear()
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = list(map(self.index.get, words))
        if None in found:
            first = len(self.index)
            gaps = [i for i, x in enumerate(found) if x is None]
            self._add([words[i] for i in gaps])
            for n, i in enumerate(gaps):
                found[i] = first + n
        at = np.array(found, np.int64)[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        ids = self.flat[ragged(self.starts[at], lengths)]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        bounds = np.concatenate(([0], np.cumsum(counts)))
        return ids, ends[bounds[1:]] - ends[bounds[:-1]]


_SPACE = "[\\s\\x{1c}-\\x{1f}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_INNER_SPACE = f"{_SPACE} {_SPACE}|{_SPACE} \\z|\\x00"


def _flat(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    return lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)


def space_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Cuts texts before spaces: all pieces, and how many each text has.

    No match of the byte-level pattern lies across a cut, so pieces can be encoded alone. White space of which
    only the last character belongs to the next word is one match; a text where it holds an inner space, and
    one with the character that marks the cuts, is left whole.
    """
    whole = pc.match_substring_regex(texts, _INNER_SPACE)
    if pc.any(whole).as_py():
        pieces = [[t] if w else t.replace(" ", "\0 ").split("\0") for t, w in zip(texts.to_pylist(), whole.to_pylist())]
        return _flat(pa.array(pieces, pa.list_(pa.string())))
    return _flat(pc.split_pattern(pc.replace_substring(texts, " ", "\0 "), "\0"))


def word_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words for tokenizers that drop white space."""
    return _flat(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))
