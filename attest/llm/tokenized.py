"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per pool."""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from attest.llm.common import Pool, space_pieces, word_pieces

# Characters that a Python task encodes at a time.
ENCODE_CHARS = 6_000_000
# The pattern that the library's byte-level splitter applies (a fixed value).
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(printable))
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


def _pattern(splitter: dict | None) -> str | None:
    """What splits normalised text into the model's words, for the kinds of tokenizer known here."""
    if splitter and splitter["type"] == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"]:
        return BYTE_LEVEL_PATTERN
    parts = splitter["pretokenizers"] if splitter and splitter["type"] == "Sequence" else []
    if [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["invert"] and parts[0]["behavior"] == "Removed" and not parts[1]["use_regex"]:
        return parts[0]["pattern"].get("Regex")
    return None


class TextEncoder:
    """Encodes texts with a tokenizer file. `drops_space`: the tokenizer's words never hold white space.

    Pieces between spaces are normalised by the library one by one, split by the file's pattern, and each
    distinct word is merged by the library's model. Other kinds of file are left to the library whole, and so are
    texts that hold the string of an added token, which is one id.
    """

    def __init__(self, path: str, end_id: int, drops_space: bool):
        import regex
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        pattern = _pattern(spec["pre_tokenizer"])
        # A token that is sought in normalised text can come from any text.
        self._marks = ["" if t["normalized"] and spec["normalizer"] else t["content"] for t in spec.get("added_tokens") or []]
        self._find = regex.compile(pattern).findall if pattern else None
        self._letters = _byte_letters()
        self._cut = word_pieces if drops_space else space_pieces
        self._end = end_id
        self._merged: dict[str, bytes] = {}  # packed: a list of integers takes several times the memory
        self._pool = Pool(self._words)

    def _merge(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isalnum() else word.encode().decode("latin-1").translate(self._letters)
        ids = self._merged[word] = array("I", [t.id for t in self._model.tokenize(spelled)]).tobytes()
        return ids

    def _words(self, new: list[str]) -> tuple[list[int] | np.ndarray, np.ndarray]:
        if self._find is None:
            ids = [e.ids for e in self._tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            return [i for x in ids for i in x], np.fromiter(map(len, ids), np.int64, len(ids))
        if len(self._merged) > 600_000:
            self._merged.clear()
        if normalizer := self._tokenizer.normalizer:
            new = [normalizer.normalize_str(w) for w in new]  # alone: a normaliser can drop, merge or add white space
        parts, lengths = [], []
        for piece in new:
            size = 0
            for word in self._find(piece):
                ids = self._merged.get(word) or self._merge(word)
                parts.append(ids)
                size += len(ids)
            lengths.append(size)
        return np.frombuffer(b"".join(parts), np.uintc), np.array(lengths, np.int64) // np.dtype(np.uintc).itemsize

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by the end id, and the number of ids of each."""
        marked = np.zeros(len(texts), bool)
        for mark in self._marks:
            marked |= pc.fill_null(pc.match_substring(texts, mark), False).to_numpy(zero_copy_only=False)
        places = np.flatnonzero(marked)
        plain = pc.if_else(pa.array(marked), pa.scalar("", texts.type), texts) if len(places) else texts
        ids, counts = self._pool.run(*self._cut(plain))
        ends = np.cumsum(counts)
        if len(places):
            whole = [np.array(self._tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32) for i in places.tolist()]
            lengths = np.array([len(w) for w in whole], np.int64)
            ids = np.insert(ids, np.repeat(ends[places], lengths), np.concatenate(whole))
            counts = counts.copy()
            counts[places] = lengths
            ends = np.cumsum(counts)
        return np.insert(ids, ends, np.uint32(self._end)).astype("<u4", copy=False), counts + 1


@lru_cache(maxsize=2)
def text_encoder(path: str, end_id: int, drops_space: bool) -> TextEncoder:
    """The worker's encoder, kept with its words from task to task."""
    return TextEncoder(path, end_id, drops_space)
