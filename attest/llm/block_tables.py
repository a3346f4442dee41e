"""Cheapest edits that bring a sequence of roles into the form `(s?(ua)+)?`, by tables over blocks of symbols.

States are what the kept roles end in: nothing, `s`, `u` or `a`. The costs to go from the four states, less their
least, form one of a few vectors. For each vector and each symbol, and so for each block of BLOCK symbols, the vector
before it is looked up instead of computed. Edits are traced forward from the state, with each block's vectors
expanded backward from the one behind it; at each place the least letter that stays cheapest is taken, which is exact as no
two sequences of edits from a state have the same letters.
"""

from __future__ import annotations

import numpy as np

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE_LETTERS = "sua"

# Symbols: a row that must go; rows with initial s, u, a or another one; the same rows when truncated.
GONE = 0
SYMBOLS = 9
BLOCK = 4
# The state that a row kept in its role leads to, for each state and initial; None where the form forbids it.
_KEPT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
# The state that a row in the role due next leads to.
DUE = (USER, USER, ASSISTANT, USER)


def symbol(initial: str, gone: bool, truncated: bool) -> int:
    if gone:
        return GONE
    at = ROLE_LETTERS.find(initial) if initial else -1
    return 1 + (at if at >= 0 else 3) + (4 if truncated else 0)


def _with_inserts(costs: tuple[int, ...]) -> tuple[int, ...]:
    out = list(costs)
    for _ in range(3):
        out = [min(out[s], INSERT_COST + out[DUE[s]]) for s in range(4)]
    return tuple(out)


def _options(state: int, of: int):
    """(letter, cost, next state) of the edits of a row with symbol `of`, in the order of their letters."""
    yield DELETE, DELETE_COST, state
    if of != GONE:
        extra = TRUNCATED_COST if of > 4 else 0
        kept = _KEPT.get((state, (of - 1) % 4))
        if kept is not None:
            yield KEEP, extra, kept
        yield REROLE, REROLE_COST + extra, DUE[state]


#: Costs to go when no row is left: nothing at the start and after `a`.
END_COSTS = _with_inserts((0, 10**6, 10**6, 0))


def _before(vector: tuple[int, ...], of: int) -> tuple[int, ...]:
    return _with_inserts(tuple(min(cost + vector[to] for _, cost, to in _options(s, of)) for s in range(4)))


def _tables() -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """All vectors that can occur, and for each and each symbol the number of the vector before it and the cost added."""
    vectors, number, found = [END_COSTS], {END_COSTS: 0}, []
    for v in vectors:
        row = []
        for of in range(SYMBOLS):
            costs = _before(v, of)
            least = min(costs)
            normal = tuple(c - least for c in costs)
            if normal not in number:
                number[normal] = len(vectors)
                vectors.append(normal)
            row.append((number[normal], least))
        found.append(row)
    both = np.array(found, np.int32)
    return vectors, both[:, :, 0], both[:, :, 1]


VECTORS, STEP, STEP_COST = _tables()


def _blocks() -> tuple[np.ndarray, np.ndarray]:
    """The same for blocks of BLOCK symbols, numbered with the first symbol highest."""
    to = np.arange(len(VECTORS), dtype=np.int32)[:, None]
    cost = np.zeros((len(VECTORS), 1), np.int32)
    for _ in range(BLOCK):  # one symbol more in front of the block
        front_to = np.stack([STEP[to, of] for of in range(SYMBOLS)], 1)
        front_cost = np.stack([cost + STEP_COST[to, of] for of in range(SYMBOLS)], 1)
        to, cost = front_to.reshape(len(VECTORS), -1), front_cost.reshape(len(VECTORS), -1)
    return to, cost


BLOCK_STEP, BLOCK_COST = _blocks()
_WEIGHTS = SYMBOLS ** np.arange(BLOCK - 1, -1, -1)
END = 0


def blocks_of(symbols: np.ndarray) -> np.ndarray:
    """Numbers of the whole blocks of a sequence; the remainder stands at its end."""
    whole = len(symbols) // BLOCK * BLOCK
    return symbols[:whole].reshape(-1, BLOCK).astype(np.int64) @ _WEIGHTS


def _vectors_behind(symbols: np.ndarray, vector: int) -> tuple[np.ndarray, list[int], int, int]:
    """Blocks, the vector behind each block, the vector before the first one, and the cost added on the way."""
    added = 0
    for of in symbols[len(symbols) // BLOCK * BLOCK :][::-1].tolist():
        added += int(STEP_COST[vector, of])
        vector = int(STEP[vector, of])
    blocks = blocks_of(symbols)
    behind = [0] * len(blocks)
    for i in range(len(blocks) - 1, -1, -1):
        behind[i] = vector
        added += int(BLOCK_COST[vector, blocks[i]])
        vector = int(BLOCK_STEP[vector, blocks[i]])
    return blocks, behind, vector, added


def backward(symbols: np.ndarray, vector: int = END) -> tuple[int, int]:
    """The vector before a sequence with `vector` behind it, and the cost added."""
    _, _, before, added = _vectors_behind(symbols, vector)
    return before, added


def backward_all(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for every vector at once: what a long conversation's parts are put together from."""
    to, cost = np.arange(len(VECTORS), dtype=np.int32), np.zeros(len(VECTORS), np.int64)
    for of in symbols[len(symbols) // BLOCK * BLOCK :][::-1].tolist():
        cost += STEP_COST[to, of]
        to = STEP[to, of]
    for block in blocks_of(symbols)[::-1].tolist():
        cost += BLOCK_COST[to, block]
        to = BLOCK_STEP[to, block]
    return to, cost


def _trace_rows(symbols: list[int], vector: int, state: int) -> tuple[str, int]:
    behind = [vector]
    for of in reversed(symbols):
        behind.append(int(STEP[behind[-1], of]))
    behind.reverse()
    letters = []
    for i, of in enumerate(symbols):
        here, there, least = VECTORS[behind[i]], VECTORS[behind[i + 1]], int(STEP_COST[behind[i + 1], of])
        while True:
            best = [(letter, to) for letter, cost, to in _options(state, of) if cost + there[to] == here[state] + least]
            insert = INSERT_COST + here[DUE[state]] == here[state]
            if best and (best[0][0] == DELETE or not insert):
                letters.append(best[0][0])
                state = best[0][1]
                break
            letters.append(INSERT)
            state = DUE[state]
    return "".join(letters), state


_known: dict[tuple[int, int, int], tuple[str, int]] = {}


def trace(symbols: np.ndarray, vector: int = END, state: int = START) -> tuple[str, int]:
    """Letters of the cheapest edits of a sequence with `vector` behind it, the least in ASCII order, and the state after it.

    Inserts behind the last row are `closing`. Blocks are expanded once and kept.
    """
    blocks, behind, _, _ = _vectors_behind(symbols, vector)
    out = []
    for i, block in enumerate(blocks.tolist()):
        key = (behind[i], block, state)
        if key not in _known:
            _known[key] = _trace_rows(symbols[i * BLOCK : (i + 1) * BLOCK].tolist(), behind[i], state)
        letters, state = _known[key]
        out.append(letters)
    letters, state = _trace_rows(symbols[len(blocks) * BLOCK :].tolist(), vector, state)
    return "".join(out) + letters, state


def closing(state: int) -> str:
    """Inserts behind the last row."""
    letters = ""
    while END_COSTS[state]:
        letters, state = letters + INSERT, DUE[state]
    return letters
