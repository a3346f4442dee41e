"""Repair of conversations: faults of their turns, and the cheapest edits that give them an alternating form.

Rows are ordered once, over all conversations together, and dealt into chunks of consecutive rows, bounded in rows and
bytes; a long conversation lies in many chunks. Each chunk is worked on alone: its rows become symbols, and every part
of a conversation a short table of what it does to any vector of costs (`block_tables`). Only a row for each part of the conversations
that cross a chunk's end is put together by conversation; then every chunk traces its own edits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm import block_tables as bt
from attest.llm.common import written

BLANK_CHARS = " \t\n\x0b\x0c\r"
CHUNK_ROWS = 20_000
CHUNK_BYTES = 4_000_000
#: What the ordering key takes of a text; rows beyond it are ordered within their partition.
KEY_CHARS = 40

ALTERNATING = {("s", "u"), ("u", "a"), ("a", "u")}
SEND_CHARS = 8_000

_PART = ("chunk long, part int, conv_id long, rows long, blank long, duplicate long, truncated long, illegal long, turns long, least_turn long, most_turn long, "
         "first_initial string, last_initial string, opens boolean, closes boolean, symbols binary")
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _given(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damage(conversations: DataFrame, kinds: int = 20) -> DataFrame:
    """Rows (conv_id, turn, role, text, dropped) with the faults that crc32 of `conv_id:turn` modulo `kinds` gives them.

    0 drops the row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats the row, 4
    makes its role user. Null roles, texts, conv_ids and turns are read as one space. A dropped row stays, with `dropped` set, so that its
    conversation is not forgotten. Rows that repeat conv_id and turn are damaged alike.
    """
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % kinds
    held = _given(conversations).withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind").isin(0, 1), "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("dropped"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"))
    return held.select("*", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "col")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in one order over all conversations, numbered by chunk and place, in the shared folder."""
    if "dropped" not in rows.columns:
        rows = _given(rows).withColumn("dropped", F.lit(False))
    stripped = F.rtrim("text", F.lit(BLANK_CHARS))
    rows = rows.select(
        "conv_id", "turn", "role", "text", "dropped", F.octet_length("text").alias("bytes"), F.substring("text", 1, KEY_CHARS).alias("beginning"),
        F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")).alias("mark"),
        (F.length(stripped) == 0).alias("blank"), (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "beginning")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text", "dropped").drop("beginning")
    place = F.monotonically_increasing_id()

    def dealt(batches):
        chunk = rows_held = bytes_held = 0
        for batch in batches:
            first = int(batch.column("place")[0].as_py()) if batch.num_rows else 0
            partition = first >> 33 << 33
            numbers = []
            for size in batch.column("bytes").to_pylist():
                if rows_held and (rows_held >= CHUNK_ROWS or bytes_held + size > CHUNK_BYTES):
                    chunk, rows_held, bytes_held = chunk + 1, 0, 0
                rows_held += 1
                bytes_held += size + 64
                numbers.append(partition + chunk)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), *batch.columns], names=["chunk", *batch.schema.names])

    numbered = ranged.withColumn("place", place)
    schema = "chunk long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields)
    return written(numbered.mapInArrow(dealt, schema), "conversation-rows")


def _edges(column: list) -> np.ndarray:
    """Where a run of equal values begins, with the end behind them."""
    return np.array([0, *(i for i in range(1, len(column)) if column[i] != column[i - 1]), len(column)] if column else [0])


def _table(table: pa.Table) -> dict[str, list]:
    table = table.sort_by("place")
    return {c: table.column(c).to_pylist() for c in table.column_names}


def _parts(table: pa.Table, known: pa.Table) -> pa.Table:
    """A row for each conversation in a chunk: counts, symbols, and what the neighbours need to go on. `known` are marks of earlier chunks."""
    rows = _table(table)
    before = set(zip(known.column("conv_id").to_pylist(), known.column("mark").to_pylist()))
    bounds, out = _edges(rows["conv_id"]), []
    for part, (start, stop) in enumerate(zip(bounds[:-1], bounds[1:])):
        conv = rows["conv_id"][start]
        seen, symbols, initials, turns = set(), bytearray(), [], []
        counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        for i in range(start, stop):
            if rows["dropped"][i]:
                continue
            mark, initial = rows["mark"][i], rows["role"][i][:1]
            again = mark in seen or (conv, mark) in before
            seen.add(mark)
            fault = "blank" if rows["blank"][i] else "duplicate" if again else "truncated" if rows["cut"][i] else None
            if fault:
                counts[fault] += 1
            symbols.append(bt.symbol(initial, fault in ("blank", "duplicate"), fault == "truncated"))
            initials.append(initial)
            if rows["turn"][i] is not None:
                turns.append(rows["turn"][i])
        out.append((rows["chunk"][0], part, conv, len(initials), *counts.values(), sum(p not in ALTERNATING for p in zip(initials, initials[1:])),
                    len(set(turns)), turns[0] if turns else None, turns[-1] if turns else None,
                    initials[0] if initials else None, initials[-1] if initials else None, start == 0, stop == len(rows["conv_id"]), bytes(symbols)))
    return _typed(out, _PART)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _typed(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table({name: pa.array(column, _ARROW[kind]) for (name, kind), column in zip(fields, columns)})


_SPAN = ("chunk long, part int, conv_id long, rows long, blank long, duplicate long, truncated long, illegal long, turns long, least_turn long, most_turn long, "
         "first_initial string, last_initial string, steps binary, costs binary, ends binary")
_JOINED = "chunk long, part int, piece long, pieces long, vector int, state int, head_chunk long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _effects(batches):
    """For parts of conversations that lie in several chunks: the vector and cost before it for each vector behind, and the state after it for each
    vector behind and state before."""
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            symbols = np.frombuffer(row["symbols"], np.uint8)
            steps, costs = bt.backward_all(symbols)
            ends = np.array([[bt.trace(symbols, v, s)[1] for s in range(4)] for v in range(len(bt.VECTORS))], np.uint8)
            out.append((*(row[f.split()[0]] for f in _SPAN.split(", ")[:-3]), steps.astype(np.int32).tobytes(), costs.tobytes(), ends.tobytes()))
        yield from _typed(out, _SPAN).to_batches()


def _put_together(table: pa.Table) -> pa.Table:
    """The parts of one conversation, in order: the vector behind each and the state before it, and the counts of the whole."""
    rows = sorted(table.to_pylist(), key=lambda r: r["chunk"])
    vectors, vector, cost = [0] * len(rows), bt.END, 0
    for i in range(len(rows) - 1, -1, -1):
        vectors[i] = vector
        cost += int(np.frombuffer(rows[i]["costs"], np.int64)[vector])
        vector = int(np.frombuffer(rows[i]["steps"], np.int32)[vector])
    cost += bt.VECTORS[vector][bt.START]
    filled = [r for r in rows if r["rows"]]
    illegal = sum(r["illegal"] for r in rows) + sum((a["last_initial"], b["first_initial"]) not in ALTERNATING for a, b in zip(filled, filled[1:]))
    dated = [r for r in rows if r["turns"]]
    distinct = sum(r["turns"] for r in rows) - sum(a["most_turn"] == b["least_turn"] for a, b in zip(dated, dated[1:]))
    gaps = dated[-1]["most_turn"] - dated[0]["least_turn"] + 1 - distinct if dated else 0
    out, state = [], bt.START
    for i, r in enumerate(rows):
        out.append((r["chunk"], r["part"], i, len(rows), vectors[i], state, rows[0]["chunk"], gaps, *(sum(x[c] for x in rows) for c in ("blank", "duplicate", "truncated")), illegal, cost))
        state = int(np.frombuffer(r["ends"], np.uint8).reshape(-1, 4)[vectors[i], state])
    return _typed(out, _JOINED)


def _repaired(roles: list[str], texts: list[str], letters: str, state: int):
    """`role:text` of the rows that an edited conversation holds."""
    at = 0
    for letter in letters:
        if letter == bt.INSERT:
            state = bt.DUE[state]
            yield ("user:", "assistant:")[state == bt.ASSISTANT]
            continue
        if letter == bt.KEEP:
            state = {"s": bt.SYSTEM, "u": bt.USER, "a": bt.ASSISTANT}[roles[at][0]]
            yield f"{roles[at]}:{texts[at]}"
        elif letter == bt.REROLE:
            state = bt.DUE[state]
            yield ("user:", "assistant:")[state == bt.ASSISTANT] + texts[at]
        at += 1


_TRACED = ("head_chunk long, piece long, run long, pieces long, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string, text string, text_rows long")


def _traced(table: pa.Table, parts: pa.Table) -> pa.Table:
    """Whole conversations of a chunk with their edits and digest; of others the letters and the text of the part, in runs of bounded size."""
    rows = _table(table)
    bounds, out = _edges(rows["conv_id"]), []
    for r in sorted(parts.to_pylist(), key=lambda r: r["part"]):
        start, stop = int(bounds[r["part"]]), int(bounds[r["part"] + 1])
        kept = [i for i in range(start, stop) if not rows["dropped"][i]]
        roles, texts = [rows["role"][i] for i in kept], [rows["text"][i] for i in kept]
        symbols = np.frombuffer(r["symbols"], np.uint8)
        j = r["joined"]
        vector, state = (j["vector"], j["state"]) if j else (bt.END, bt.START)
        letters, last = bt.trace(symbols, vector, state)
        if not j or j["piece"] == j["pieces"] - 1:
            letters += bt.closing(last)
        if not j:
            first, added = bt.backward(symbols)
            gaps = r["most_turn"] - r["least_turn"] + 1 - r["turns"] if r["turns"] else 0
            digest = hashlib.sha256("\n".join(_repaired(roles, texts, letters, state)).encode("utf-8", "surrogatepass")).hexdigest()
            out.append((r["chunk"], 0, 0, 1, r["conv_id"], gaps, r["blank"], r["duplicate"], r["truncated"], r["illegal"], added + bt.VECTORS[first][bt.START], letters, digest, None, None))
            continue
        same = (j["head_chunk"], j["piece"])
        counts = (j["pieces"], r["conv_id"], *(j[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")))
        held, size, run = [], 0, 0
        for line in _repaired(roles, texts, letters, state):
            if size + len(line) > SEND_CHARS and held:
                out.append((*same, run, *counts, None, None, "\n".join(held), len(held)))
                held, size, run = [], 0, run + 1
            held.append(line)
            size += len(line)
        out.append((*same, run, *counts, letters, None, "\n".join(held), len(held)))
    return _typed(out, _TRACED)


def _digested(batches):
    """Streams the runs of long conversations, in order, into one digest each; holds no more than a batch of them and the letters."""
    names = [f.split()[0] for f in _RESULT.split(", ")]
    now = digest = None
    started, letters = False, []

    def ended():
        return _typed([(*(now[c] for c in names[:-2]), "".join(letters), digest.hexdigest())], _RESULT).to_batches()

    for batch in batches:
        for row in batch.to_pylist():
            if now is None or row["head_chunk"] != now["head_chunk"]:
                if now is not None:
                    yield from ended()
                now, digest, started, letters = row, hashlib.sha256(), False, []
            if row["audit"]:
                letters.append(row["audit"])
            if row["text_rows"]:
                digest.update((("\n" if started else "") + row["text"]).encode("utf-8", "surrogatepass"))
                started = True
    if now is not None:
        yield from ended()


def repair(conversations: DataFrame) -> DataFrame:
    """One row for each conv_id: faults, the cheapest edits and their cost, and the digest of the repaired conversation.

    Rows of a conversation are ordered by turn, nulls first, then role and text. A row's first fault counts: blank, duplicate (role and
    text seen earlier), truncated (its last character that is no white space ends no sentence). `gaps` are turns that are missing between the least and
    the greatest, `illegal` neighbours that do not alternate. Edits keep a row (0), change its role to user or assistant (2), delete it (3,
    required for blank and duplicate rows) or insert a row with an empty text (2); a truncated row that stays costs 1. They give role initials
    `(s?(ua)+)?`; of equal cost, those with the least letters in `audit` are taken. Null roles and texts are one space, and a role with
    another initial can stay no more than an empty one. Rows with null conv_id are one conversation; one without rows
    (marked `dropped` by `damage`) has zeros and the digest of nothing. Equal rows are duplicates of each other. Columns other than these four are not read.
    """
    rows = _ordered(conversations)
    light = rows.drop("text", "bytes")
    ends = light.groupBy("chunk").agg(F.array(F.min(F.struct("place", "conv_id")), F.max(F.struct("place", "conv_id"))).alias("ends"))
    ends = ends.select("chunk", F.explode("ends").alias("end")).select("chunk", F.col("end.conv_id").alias("conv")).distinct()
    several = written(ends.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1"), "conversation-several")
    marks = light.filter("not dropped").join(several, F.col("conv").eqNullSafe(F.col("conv_id")), "left_semi").select("conv_id", "mark", "chunk").distinct()
    marks = written(marks, "conversation-marks")
    first = marks.groupBy(F.col("conv_id").alias("conv"), F.col("mark").alias("named")).agg(F.min("chunk").alias("first"), F.count("*").alias("n")).filter("n > 1")
    known = marks.join(first, (F.col("named") == F.col("mark")) & F.col("conv").eqNullSafe(F.col("conv_id")) & (F.col("chunk") > F.col("first"))).select("chunk", "conv_id", "mark")
    parts = written(light.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_parts, _PART), "conversation-parts")

    spanning = parts.filter("opens or closes").join(several, F.col("conv").eqNullSafe(F.col("conv_id")), "left_semi")
    states = written(spanning.mapInArrow(_effects, _SPAN).groupBy("conv_id").applyInArrow(_put_together, _JOINED), "conversation-states")
    named = states.select(F.struct(*states.columns).alias("joined"), F.col("chunk").alias("its_chunk"), F.col("part").alias("its_part"))
    decided = parts.join(named, (F.col("its_chunk") == F.col("chunk")) & (F.col("its_part") == F.col("part")), "left").drop("its_chunk", "its_part")
    traced = rows.drop("mark", "blank", "cut", "bytes").groupBy("chunk").cogroup(decided.groupBy("chunk")).applyInArrow(_traced, _TRACED)
    traced = written(traced, "conversation-edits")
    names = [f.split()[0] for f in _RESULT.split(", ")]
    whole = traced.filter("pieces = 1").select(*names)
    runs = traced.filter("pieces > 1").repartition("head_chunk").sortWithinPartitions("head_chunk", "piece", "run")
    return whole.unionByName(runs.mapInArrow(_digested, _RESULT))
