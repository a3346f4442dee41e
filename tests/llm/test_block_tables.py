"""Block tables against all sequences of edits."""

import itertools
import re

import numpy as np

from attest.llm import block_tables as bt

FORM = re.compile(r"(s(ua)+|(ua)+)?")


def cheapest(rows):
    """Least (cost, letters) over all edits, by a queue over (row, kept roles) with inserts bounded by the cost."""
    best = None
    states = {"": {(0, "")}}  # kept roles to (cost, letters)
    bound = 3 * len(rows) + 1

    def closed(found):
        """Adds inserts; keeps the Pareto set of (cost, letters)."""
        todo = list(found.items())
        while todo:
            roles, ways = todo.pop()
            for role in "ua":
                more = roles + role
                if not prefix(more):
                    continue
                new = {(c + 2, w + "I") for c, w in ways if c + 2 <= bound} - found.get(more, set())
                if new:
                    found.setdefault(more, set()).update(new)
                    todo.append((more, new))
        return found

    def prefix(roles):
        return re.fullmatch(r"s?(ua)*u?", roles) is not None

    for initial, gone, cut in rows:
        after = {}
        for roles, ways in closed(states).items():
            options = [("D", 3, roles)]
            if not gone:
                options += [("K", int(cut), roles + initial)] if initial else []
                options += [("R", 2 + int(cut), roles + r) for r in "ua"]
            for letter, cost, to in options:
                if prefix(to):
                    after.setdefault(to, set()).update((c + cost, w + letter) for c, w in ways if c + cost <= bound)
        states = after
    for roles, ways in closed(states).items():
        if FORM.fullmatch(roles):
            for way in ways:
                best = way if best is None or way < best else best
    return best


def by_tables(rows):
    symbols = np.array([bt.symbol(*r) for r in rows], np.uint8)
    vector, added = bt.backward(symbols)
    letters, state = bt.trace(symbols)
    return added + bt.VECTORS[vector][bt.START], letters + bt.closing(state)


ROWS = [("", True, False)] + [(i, False, cut) for cut in (False, True) for i in "suax"]


def test_all_short_sequences():
    for n in range(4):
        for rows in itertools.product(ROWS, repeat=n):
            assert by_tables(rows) == cheapest(rows), rows


def test_random_longer_sequences():
    rng = np.random.default_rng(5)
    for _ in range(150):
        rows = [ROWS[i] for i in rng.integers(0, len(ROWS), rng.integers(4, 8))]
        assert by_tables(rows) == cheapest(rows), rows


def test_parts_compose():
    rng = np.random.default_rng(6)
    symbols = rng.integers(0, bt.SYMBOLS, 1000).astype(np.uint8)
    whole, cost = bt.backward(symbols)
    letters, state = bt.trace(symbols)
    for cut in (1, 6, 333, 998):
        to, costs = bt.backward_all(symbols[cut:])
        first, first_cost = bt.backward(symbols[:cut], int(to[bt.END]))
        assert (first, first_cost + costs[bt.END]) == (whole, cost)
        head, middle = bt.trace(symbols[:cut], int(to[bt.END]))
        tail, last = bt.trace(symbols[cut:], bt.END, middle)
        assert (head + tail, last) == (letters, state)
    assert len(bt.VECTORS) < 200
