"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, and put together in another order.

Ends of lines are found on 64-bit words of the UTF-8 bytes of a whole Arrow batch: line feeds are marked by word
arithmetic, counted per word, the word that holds the n-th one is searched in the running counts, and the byte
within that word by adding up its marks. Code points are counted from the marks of bytes that begin one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from attest.llm.common import arrow_slices, plain_names

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
COLUMNS = {"n": LongType(), "form": StringType(), "prefix_chars": LongType(), "middle_chars": LongType(), "output": StringType()}

_ONES = np.uint64(0x0101010101010101)
_LOW = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)
_FEEDS = _ONES * np.uint64(0x0A)


def line_feeds(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that is a line feed."""
    x = words ^ _FEEDS
    return ~(((x & _LOW) + _LOW) | x | _LOW)


def code_points(words: np.ndarray) -> np.ndarray:
    """The high bit of every byte that does not continue a code point (no 10xxxxxx)."""
    return (~words | (words << np.uint64(1))) & _HIGH


class Marks:
    """Rank and select over bytes marked in 64-bit words (little-endian, the first byte lowest)."""

    def __init__(self, marked: np.ndarray):
        self._marked = marked
        self._before = np.concatenate(([0], np.cumsum(np.bitwise_count(marked), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marked bytes lie before each position."""
        word = at >> 3
        inside = np.left_shift(np.uint64(1), ((at & 7) << 3).astype(np.uint64)) - np.uint64(1)
        padded = np.append(self._marked, np.uint64(0))
        return self._before[word] + np.bitwise_count(padded[word] & inside)

    def select(self, number: np.ndarray) -> np.ndarray:
        """The position of the marked byte with each number, counted from 0."""
        word = np.searchsorted(self._before, number, side="right") - 1
        left = (number - self._before[word]).astype(np.uint64)
        running = (self._marked[word] >> np.uint64(7)) * _ONES  # byte i: marks among bytes 0 to i
        below = np.zeros(len(number), np.int64)
        for i in range(8):
            below += ((running >> np.uint64(8 * i)) & np.uint64(0xFF)) <= left
        return (word << 3) + below


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, padded by zeros to whole words, and the bounds of each text."""
    texts = pa.concat_arrays([texts.cast(pa.large_string())])  # drops what lies before a slice
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    first, last = (int(bounds[0]), int(bounds[-1])) if len(texts) else (0, 0)
    held = np.zeros((last - first + 7) // 8 * 8, np.uint8)
    if last > first:
        held[: last - first] = np.frombuffer(data, np.uint8, last - first, first)
    return held, bounds - first


def cuts(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Number of lines, byte positions of both cuts, and code points of prefix and middle, for each text."""
    data, bounds = buffers(texts)
    words = data.view("<u8")
    feeds, points = Marks(line_feeds(words)), Marks(code_points(words))
    start, stop = bounds[:-1], bounds[1:]
    before = feeds.rank(start)
    fed = feeds.rank(stop) - before
    closed = np.zeros(len(start), bool)
    some = stop > start
    closed[some] = data[stop[some] - 1] == 0x0A
    n = fed + (some & ~closed)
    cut = []
    for units in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        at = np.where(units == 0, start, stop)
        inner = (units > 0) & (units <= fed)
        at[inner] = feeds.select(before[inner] + units[inner] - 1) + 1
        cut.append(at)
    ranks = [points.rank(at) for at in (start, *cut)]
    return n, cut[0] - start, cut[1] - start, ranks[1] - ranks[0], ranks[2] - ranks[1]


def rearrange(documents: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50) -> DataFrame:
    """All columns of `documents` (doc_id, text) with COLUMNS, which replace columns of these names.

    A text of n lines is cut twice, where the digest of `seed` and doc_id says. `output` is `<P>`prefix`<S>`suffix`<M>`middle
    (form psm), `<S>`suffix`<P>`prefix`<M>`middle (spm), or the text itself (plain): empty texts, texts that hold one of the three
    markers, and those beyond `fim_percent`. Null texts are empty ones. Rows without doc_id are cut by the seed alone;
    rows with equal doc_id and text have equal outputs. Works on whole texts of any length, row by row, without a shuffle.
    """
    kept = [f for f in documents.schema.fields if f.name not in COLUMNS and f.name != "fim_digest"]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    given = documents.select(*[F.col(f"`{f.name}`") for f in kept], digest.alias("fim_digest"))

    def task(batches):
        for batch in arrow_slices(batches):
            texts = batch.column("text")
            digests = batch.column("fim_digest")
            h1, h2, h3, h4 = (np.array([int(d, 16) for d in pc.utf8_slice_codeunits(digests, 8 * i, 8 * i + 8).to_pylist()], np.int64) for i in range(4))
            n, first, second, prefix, middle = cuts(texts, h1, h2)
            plain = pc.match_substring(texts, PREFIX).to_numpy(False) | pc.match_substring(texts, SUFFIX).to_numpy(False)
            plain |= pc.match_substring(texts, MIDDLE).to_numpy(False) | (n == 0) | (h3 % 100 >= fim_percent)
            forms = np.where(plain, "plain", np.where(h4 % 100 < spm_percent, "spm", "psm"))
            raw = texts.cast(pa.binary()) if texts.type == pa.string() else texts.cast(pa.large_binary())
            out = []
            for text, form, a, b in zip(raw, forms, first.tolist(), second.tolist()):
                t = text.as_py()
                if form == "psm":
                    t = b"".join((b"<P>", t[:a], b"<S>", t[b:], b"<M>", t[a:b]))
                elif form == "spm":
                    t = b"".join((b"<S>", t[b:], b"<P>", t[:a], b"<M>", t[a:b]))
                out.append(t)
            columns = batch.columns[:-1]
            columns += [pa.array(n, pa.int64()), pa.array(forms.tolist(), pa.string()), pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain)]
            columns.append(pa.array(out, pa.binary()).cast(pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in kept] + list(COLUMNS))

    return plain_names(given, "text", "fim_digest").mapInArrow(task, StructType([*kept, *(StructField(c, t) for c, t in COLUMNS.items())]))


def restore(rearranged: DataFrame, name: str = "restored") -> DataFrame:
    """The texts, rebuilt from `form` and `output` alone, as column `name`, which replaces one of that name.

    The first marker of each kind is the one put in, as the text holds none and no marker overlaps another.
    """
    p, s, m = (F.instr("output", marker) for marker in (PREFIX, SUFFIX, MIDDLE))
    end = F.length("output") + 1

    def between(start, stop):
        return F.substring("output", start + 3, stop - start - 3)

    psm = F.concat(between(p, s), between(m, end), between(s, m))
    spm = F.concat(between(p, m), between(m, end), between(s, p))
    return rearranged.withColumn(name, F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output")))
