"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_STEP = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(0xBF58476D1CE4E5B9)
_TWO = np.uint64(0x94D049BB133111EB)


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly over 64 bits; a bijection."""
    values = (values ^ (values >> np.uint64(30))) * _ONE
    values = (values ^ (values >> np.uint64(27))) * _TWO
    return values ^ (values >> np.uint64(31))


def _word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word of all texts, and the number of words of each. Words part at ASCII white space."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    filled = np.fromiter((w != "" for w in words), bool, len(words))
    at = coded.indices.to_numpy()
    kept = filled[at] if len(words) else np.empty(0, bool)
    ends = np.concatenate(([0], np.cumsum(kept)))
    bounds = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))
    return hashes[at[kept]], np.diff(ends[bounds])


def shingle_sets(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of `words` words, A-Z lower-cased; a text of fewer
    words has its whole sequence as one, a text without words none."""
    hashes, counts = _word_hashes(texts)
    with np.errstate(over="ignore"):
        held = np.zeros(max(0, len(hashes) - words + 1), np.uint64)
        for i in range(words):
            held = held * _STEP + hashes[i : i + len(held)] if len(held) else held
        held = mixed(held)
        start = 0
        for n in counts.tolist():
            if n >= words:
                yield np.unique(held[start : start + n - words + 1])
            elif n:
                short = np.uint64(n)
                for h in hashes[start : start + n]:
                    short = short * _STEP + h
                yield mixed(np.array([short ^ _TWO], np.uint64))
            else:
                yield np.empty(0, np.uint64)
            start += n
