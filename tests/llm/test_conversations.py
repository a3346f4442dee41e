"""Conversation repair against a plain search over all edits, whole and cut into small chunks."""

import hashlib
import os
import re
import zlib

import pytest

from attest.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def cheapest(rows):
    """Least (cost, letters), forward over what the kept roles end in, with every cheapest sequence of letters."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}

    def better(found, end, cost, ways):
        old = found.get(end, (cost + 1, set()))
        if cost < old[0] or cost == old[0] and not ways <= old[1]:
            found[end] = (cost, ways | (old[1] if cost == old[0] else set()))
            return True
        return False

    def with_inserts(found):
        todo = list(found)
        while todo:
            end = todo.pop()
            cost, ways = found[end]
            if better(found, due[end], cost + 2, {w + "I" for w in ways}):
                todo.append(due[end])
        return found

    found = with_inserts({"": (0, {""})})
    for initial, gone, cut in rows:
        after = {}
        for end, (cost, ways) in found.items():
            better(after, end, cost + 3, {w + "D" for w in ways})
            if not gone:
                better(after, due[end], cost + 2 + cut, {w + "R" for w in ways})
                if initial and (initial == due[end] or (initial == "s" and end == "")):
                    better(after, initial, cost + cut, {w + "K" for w in ways})
        found = with_inserts(after)
    return min((found[end][0], min(found[end][1])) for end in ("", "a") if end in found)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def by_hand(rows, search=cheapest):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, kinds = set(), []
    for _, _, role, text in rows:
        letters = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not letters else "duplicate" if (role, text) in seen else "truncated" if letters[-1] not in ".!?" else "")
        seen.add((role, text))
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:])]
    cost, audit = search([(r[2][:1], k in ("blank", "duplicate"), k == "truncated") for r, k in zip(rows, kinds)])
    repaired, at, last = [], 0, ""
    for letter in audit:
        due = "assistant" if last == "u" else "user"
        if letter == "K":
            repaired.append(f"{rows[at][2]}:{rows[at][3]}")
        elif letter == "R":
            repaired.append(f"{due}:{rows[at][3]}")
        elif letter == "I":
            repaired.append(f"{due}:")
        if letter in "KRI":
            last = repaired[-1][0]
        at += letter != "I"
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(repaired).encode()).hexdigest())


def expected(rows, search=cheapest):
    found = {r[0]: [] for r in rows}
    for r in damaged(rows):
        found[r[0]].append(r)
    return {conv: by_hand(held, search) for conv, held in found.items()}


def answers(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


ODD = [(1, 0, "user", "Hello."), (1, 1, "assistant", "Yes!"), (2, 0, "assistant", "First."), (2, 1, "user", "Second"), (2, 1, "user", "Second"),
       (3, None, "system", "Be kind."), (3, None, None, None), (3, 5, "user", " "), (3, 9, "assistant", "日本。"), (4, 0, "system", "Only."),
       (5, 0, "", "no role."), (5, 1, "tool", "A tool."), (5, 2, "admin", "Kept?"), (None, None, "user", "No id."), (None, 2, "user", "No id."),
       (6, 3, "user", " \t\n\x0b\x0c\r "), (7, 1, "User", "Upper."), (8, -4, "user", "Minus.\n"), (8, 2, "assistant", "long " * 20_000 + "end."), (8, 2, "assistant", "tie?"),
       *[(100 + i, t, ("user", "assistant", "system")[(i * t + i // 3) % 3], ("Text.", "Cut off", "", f"Turn {t}!")[(i + t * t) % 4]) for i in range(60) for t in range(i % 6)]]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def test_whole_chunks(odd):
    assert answers(conversations.repair(conversations.damage(odd))) == expected(ODD)


@pytest.mark.parametrize("rows", [1, 3])
def test_conversations_across_chunks(odd, monkeypatch, rows):
    monkeypatch.setattr(conversations, "CHUNK_ROWS", rows)
    monkeypatch.setattr(conversations, "SEND_CHARS", 10)
    assert answers(conversations.repair(conversations.damage(odd.repartition(3)))) == expected(ODD)


def test_one_long_conversation_equals_itself_in_one_chunk(spark, monkeypatch):
    rows = [(7, t // 2, ("user", "assistant", "system", "tool")[t * t % 7 % 4], f"Words {t % 50}" + ".?! "[t % 4]) for t in range(3000)]
    rows += [(7, None, "user", "Same.")] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    whole = answers(conversations.repair(df))
    monkeypatch.setattr(conversations, "CHUNK_ROWS", 97)
    assert answers(conversations.repair(df)) == whole
    assert whole[7][2] > 2000


def test_rows_without_damage_and_extra_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 5), (1, 1, "assistant", "Ho.", "y", 6)], SCHEMA + ", chunk string, cost long")
    assert answers(conversations.repair(df)) == {1: (0, 0, 0, 0, 0, 0, "KK", hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest())}
    assert conversations.repair(conversations.damage(df.limit(0))).count() == 0
    assert conversations.damage(df).columns == ["conv_id", "turn", "role", "text", "dropped"]


def test_all_rows_dropped(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)
    assert answers(conversations.repair(conversations.damage(df))) == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query_on_whole_table(spark):
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert answers(queries.QUERIES["op12_conversation_repair"](spark, folder)) == expected(rows)
