"""Deep-shallow sorting of byte strings: multikey quicksort to a shallow depth, blind tries beyond it."""

from __future__ import annotations

import numpy as np

SHALLOW_WORDS = 3
SMALL = 24


def _multikey_quicksort(words: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Orders rows of 8-byte characters; returns the order and the runs of rows that are equal in all of them."""
    order = np.arange(len(words))
    ties, stack = [], [(0, len(words), 0)]
    while stack:
        start, end, depth = stack.pop()
        if end - start < 2:
            continue
        if depth == words.shape[1]:
            ties.append((start, end))
            continue
        part = order[start:end]
        if end - start <= SMALL:
            keys = [words[i, depth:].tolist() for i in part]
            ranked = sorted(range(len(part)), key=keys.__getitem__)
            order[start:end] = part[ranked]
            keys = [keys[i] for i in ranked]
            run = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[run]:
                    if i - run > 1:
                        ties.append((start + run, start + i))
                    run = i
            continue
        letters = words[part, depth]
        pivot = np.sort(letters[[0, len(part) // 2, -1]])[1]
        less, same, more = part[letters < pivot], part[letters == pivot], part[letters > pivot]
        order[start:end] = np.concatenate((less, same, more))
        one, two = start + len(less), start + len(less) + len(same)
        stack += [(start, one, depth), (one, two, depth + 1), (two, end, depth)]
    return order, ties


class BlindTrie:
    """Inner nodes keep only a depth and the bytes that part there; a string is compared once, with one leaf."""

    def __init__(self, strings: list[bytes]):
        self._strings = strings
        self._root: list | None = None  # [depth, {byte: node}] or [-1, [indexes]]

    def add(self, index: int) -> None:
        text = self._strings[index]
        if self._root is None:
            self._root = [-1, [index]]
            return
        node = self._root
        while node[0] >= 0:  # blindly to some leaf
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = self._strings[node[1][0]]
        parted = (int.from_bytes(text) ^ int.from_bytes(other)).bit_length()
        if not parted:
            node[1].append(index)
            return
        depth = len(text) - (parted + 7) // 8
        above, node = None, self._root
        while 0 <= node[0] < depth:
            above, node = node, node[1][text[node[0]]]
        if node[0] == depth:
            node[1][text[depth]] = [-1, [index]]
            return
        fork = [depth, {other[depth]: node, text[depth]: [-1, [index]]}]
        if above is None:
            self._root = fork
        else:
            above[1][text[above[0]]] = fork

    def ordered(self) -> list[int]:
        out, stack = [], [self._root] if self._root else []
        while stack:
            depth, held = stack.pop()
            if depth < 0:
                out += held
            else:
                stack += [held[byte] for byte in sorted(held, reverse=True)]
        return out


def deep_shallow_order(rows: np.ndarray, shallow: int = SHALLOW_WORDS) -> np.ndarray:
    """The order of byte strings of equal length, given as rows of at least 8 * `shallow` bytes."""
    words = np.ascontiguousarray(rows[:, : 8 * shallow]).view(">u8").astype(np.uint64)
    order, ties = _multikey_quicksort(words)
    for start, end in ties:
        members = order[start:end]
        strings = [rows[i].tobytes() for i in members]
        trie = BlindTrie(strings)
        for i in range(len(strings)):
            trie.add(i)
        order[start:end] = members[trie.ordered()]
    return order


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """For each row of an ordered array, how many bytes it shares with the row before; 0 for the first."""
    shared = np.zeros(len(rows), np.int64)
    for at in range(1, len(rows), 100_000):
        same = rows[at : at + 100_000] == rows[at - 1 : at - 1 + len(rows[at : at + 100_000])]
        shared[at : at + len(same)] = np.where(same.all(axis=1), same.shape[1], np.argmin(same, axis=1))
    return shared
