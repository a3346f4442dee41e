"""Removal of byte strings that an earlier text holds, by sorting the suffixes at chosen places.

Every string of `length` bytes has an anchor: the leftmost place, among those where KEY bytes still lie inside the
string, with the least hash of its eight bytes. Equal strings have their anchors at the same offset, so
only anchors with equal keys need to be compared. An anchor stands for the run of strings that chose it.

1. Anchors are shuffled by the hash of their KEY bytes. Those whose whole run of strings is equal are settled by
   the first of them; others with the key are edges, where a repeated passage begins or ends.
2. The suffixes and the reversed prefixes at the edges are put in order by deep-shallow sorting. Ranks and common
   prefixes tell which strings around equal keys are equal, and the first of each stays.
3. A key with very many edges is settled by the hashes of its strings, which spread evenly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attest.llm.common import arrow_slices, written
from attest.llm.shingles import mixed
from attest.llm.suffixes import common_prefixes, deep_shallow_order

LENGTH = 100
KEY = 32
HOT_EDGES = 2_000
NULL_ID = -(1 << 63)
_PACKED = "shard int, kind int, keys binary, runs binary, docs binary, at binary, left binary, right binary, ids binary, marks binary"
_FOUND = "kind int, doc long, mark long, lo long, hi long, key long, at long, left int, right int"


def _words(data: bytes) -> np.ndarray:
    """The eight bytes from each place on, as integers."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def _string_hash(words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    held = np.full(len(at), length, np.uint64)
    for i in [*range(0, length - 8, 8), length - 8]:
        held = mixed(held ^ words[at + i])
    return held


def anchors(data: bytes, length: int = LENGTH, key: int = KEY) -> tuple[np.ndarray, ...]:
    """Of each anchor: key hash, hash of its run of strings, place, and how far left its first and last string start."""
    n, width = len(data) - length + 1, length - key + 1
    words = _words(data)
    with np.errstate(over="ignore"):
        places = np.arange(n + width - 1, dtype=np.uint64)
        ranked = (mixed(words[: n + width - 1] * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(0xFFFFFFFF)) | places
        blocks = np.full(-(-len(ranked) // width) * width, ~np.uint64(0), np.uint64)
        blocks[: len(ranked)] = ranked
        blocks = blocks.reshape(-1, width)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        chosen = (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
        last = np.append(first[1:], n) - 1
        at = chosen[first]
        keys = _string_hash(words, at, key)
        runs = mixed(_string_hash(words, first, length) ^ mixed(_string_hash(words, last, length) + ((at - first) << 8 | (at - last)).astype(np.uint64)))
    return keys, runs, at, at - first, at - last


def _firsts(keys, runs, ids, at):
    """Order by key, run, document and place; where each key and each run starts."""
    order = np.lexsort((at, ids, runs, keys))
    k, r = keys[order], runs[order]
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    return order, new_key, new_key | np.concatenate(([True], r[1:] != r[:-1]))


def _pack(number: int, shards: int, keys, runs, docs, at, left, right, ids, marks) -> pa.RecordBatch:
    """One row per shard. Kind 0 goes to the key's shard; kind 1, repeated inside of the slice, goes anywhere."""
    order, _, new = _firsts(keys, runs, ids[docs], at)
    first = np.zeros(len(keys), bool)
    first[order[new]] = True
    # The same place of the same document id is not earlier.
    run_first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    same = (ids[docs[order]] == ids[docs[run_first]]) & (at[order] == at[run_first])
    first[order[same]] = True
    to = np.where(first, (keys % np.uint64(shards)).astype(np.int64), (np.arange(len(keys)) + number) % shards)
    kind = np.where(first, 0, 1)
    by = np.lexsort((at, docs, kind, to))
    cells = []
    for part in np.split(by, np.flatnonzero(np.diff(to[by] * 2 + kind[by])) + 1) if len(by) else []:
        own, local = np.unique(docs[part], return_inverse=True)
        known = kind[part[0]] == 0
        cells.append((int(to[part[0]]), int(kind[part[0]]), keys[part].tobytes() if known else b"", runs[part].tobytes() if known else b"",
                      local.astype("<u4").tobytes(), at[part].astype("<u4").tobytes(), left[part].astype(np.uint8).tobytes(),
                      right[part].astype(np.uint8).tobytes(), ids[own].astype("<i8").tobytes(), marks[own].astype("<i8").tobytes()))
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 8)
    names = [c.split()[0] for c in _PACKED.split(", ")]
    columns = list(zip(*cells)) if cells else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _meet(length: int):
    """Settles the packed anchors of a shard: rows of kind 1 are removed intervals, rows of kind 2 are edges."""

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = {0: [], 1: []}
        for row in table.to_pylist():
            local = np.frombuffer(row["docs"], "<u4")
            own = [np.frombuffer(row["ids"], "<i8")[local], np.frombuffer(row["marks"], "<i8")[local], np.frombuffer(row["at"], "<u4").astype(np.int64),
                   np.frombuffer(row["left"], np.uint8).astype(np.int32), np.frombuffer(row["right"], np.uint8).astype(np.int32)]
            keyed = [np.frombuffer(row["keys"], "<u8"), np.frombuffer(row["runs"], "<u8")] if row["kind"] == 0 else [np.zeros(len(local), np.uint64)] * 2
            parts[row["kind"]].append(keyed + own)
        out = []
        if parts[1]:
            out.append((1, [np.concatenate(c) for c in zip(*parts[1])]))
        if parts[0]:
            keys, runs, ids, marks, at, left, right = (np.concatenate(c) for c in zip(*parts[0]))
            order, new_key, new_run = _firsts(keys, runs, ids, at)
            run_first = order[np.maximum.accumulate(np.where(new_run, np.arange(len(order)), 0))]
            later = (ids[order] != ids[run_first]) | (at[order] != at[run_first])
            starts = np.flatnonzero(new_key)
            n_runs = np.repeat(np.add.reduceat(new_run.astype(np.int64), starts), np.diff(np.append(starts, len(order))))
            for kind, chosen in ((1, later), (2, new_run & (n_runs > 1))):
                rows = order[chosen]
                out.append((kind, [c[rows] for c in (keys, runs, ids, marks, at, left, right)]))
        kinds = np.concatenate([np.full(len(c[0]), k, np.int32) for k, c in out])
        keys, _, ids, marks, at, left, right = (np.concatenate(c) for c in zip(*(c for _, c in out)))
        return pa.table({"kind": kinds, "doc": ids, "mark": marks, "lo": at - left, "hi": at - right + length,
                         "key": keys.view(np.int64), "at": at, "left": left.astype(np.int32), "right": right.astype(np.int32)})

    return meet


def _anchor_rows(length: int, key: int, shards: int):
    def task(batches):
        for number, batch in enumerate(arrow_slices(batches)):
            found = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                data = text.encode()
                if len(data) >= length:
                    own = anchors(data, length, key)
                    found.append((*own[:2], np.full(len(own[0]), i), *own[2:]))
            if found:
                ids, marks = (batch.column(c).to_numpy() for c in ("doc", "mark"))
                yield _pack(number, shards, *(np.concatenate(c) for c in zip(*found)), ids, marks)

    return task


def _hot_rows(length: int, shards: int):
    """The strings of edges with a hot key, each as an anchor of its own."""

    def task(batches):
        for number, batch in enumerate(arrow_slices(batches)):
            found = []
            for i, (text, edges) in enumerate(zip(batch.column("text").to_pylist(), batch.column("edges").to_pylist())):
                words = _words(text.encode())
                at = np.concatenate([np.arange(e["at"] - e["left"], e["at"] - e["right"] + 1) for e in edges])
                with np.errstate(over="ignore"):
                    keys, zero = _string_hash(words, at, length), np.zeros(len(at), np.int64)
                found.append((keys, zero.astype(np.uint64), zero + i, at, zero, zero))
            if found:
                ids, marks = (batch.column(c).to_numpy() for c in ("doc", "mark"))
                yield _pack(number, shards, *(np.concatenate(c) for c in zip(*found)), ids, marks)

    return task


def _edge_contexts(length: int, key: int, shards: int):
    """Rows with the bytes right of each edge's place, and those left of it reversed, both padded."""

    def task(batches):
        for batch in arrow_slices(batches):
            columns: list[list] = [[] for _ in range(9)]
            for doc, mark, text, edges in zip(*(batch.column(c).to_pylist() for c in ("doc", "mark", "text", "edges"))):
                data = text.encode()
                for e in edges:
                    at, left, right = e["at"], e["left"], e["right"]
                    ahead = data[at : at - right + length].ljust(length, b"\0")
                    back = data[at - left : at][::-1].ljust(length - key, b"\0")
                    for column, value in zip(columns, ((e["key"] & 0x7FFFFFFFFFFFFFFF) % shards, e["key"], doc, mark, at, left, right, ahead, back)):
                        column.append(value)
            kinds = (pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                             names=["shard", "key", "doc", "mark", "at", "left", "right", "ahead", "back"])

    return task


def _sorted_edges(length: int, key: int):
    def meet(group: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        size = table.num_rows
        docs, marks, at, left, right = (table.column(c).to_numpy() for c in ("doc", "mark", "at", "left", "right"))
        ranks, shared = [], []
        for column, width in (("ahead", length), ("back", length - key)):
            rows = np.frombuffer(b"".join(table.column(column).to_pylist()), np.uint8).reshape(size, width)
            order = deep_shallow_order(rows)
            rank = np.empty(size, np.int64)
            rank[order] = np.arange(size)
            ranks.append(rank)
            shared.append(common_prefixes(rows[order]))
        place = np.empty(size, np.int64)
        place[np.lexsort((at, docs))] = np.arange(size)
        least, most = np.full(size, length, np.int64), np.full(size, -1, np.int64)
        for offset in range(int(right.min()), int(left.max()) + 1):
            valid = np.flatnonzero((right <= offset) & (offset <= left))
            ahead = np.cumsum(shared[0] < length - offset)[ranks[0][valid]]
            back = np.cumsum(shared[1] < offset)[ranks[1][valid]] if offset else np.zeros(len(valid), np.int64)
            strings = ahead * (size + 1) + back
            order = np.lexsort((place[valid], strings))
            strings, members = strings[order], valid[order]
            new = np.concatenate(([True], strings[1:] != strings[:-1]))[: len(strings)]
            first = members[np.maximum.accumulate(np.where(new, np.arange(len(members)), 0))]
            later = members[(docs[members] != docs[first]) | (at[members] != at[first])]
            most[later] = offset
            least[later] = np.minimum(least[later], offset)
        told = most >= 0
        return pa.table({"doc": docs[told], "mark": marks[told], "lo": at[told] - most[told], "hi": at[told] - least[told] + length})

    return meet


def _cut(batches):
    for batch in arrow_slices(batches):
        out: list[list] = [[] for _ in range(6)]
        for doc, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "spans"))):
            data = text.encode()
            runs: list[list[int]] = []
            for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                if runs and lo <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], hi)
                else:
                    runs.append([lo, hi])
            ends = [0, *(x for run in runs for x in run), len(data)]
            kept = b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2]))
            for column, value in zip(out, (None if doc == NULL_ID else doc, len(data), len(data) - len(kept), len(runs), kept, kept.decode(errors="ignore"))):
                column.append(value)
        kinds = (*[pa.int64()] * 4, pa.binary(), pa.string())
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds)), batch.column("carried")],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_text", "carried"])


def remove_repeats(documents: DataFrame, length: int = LENGTH, key: int = KEY, carry: tuple[str, ...] = ()) -> DataFrame:
    """Removes each byte covered by a string of `length` bytes that also starts earlier in the corpus.

    Earlier is a smaller doc_id, or the same doc_id and an earlier start; strings are judged on the input and
    never cross documents. A null doc_id comes before all others (and equals the least 64-bit integer). The same
    start of the same doc_id is not earlier, so repeated rows of a document are treated alike and none gives
    way to the other. Texts shorter than `length`, empty and null ones stay whole. Equality of the strings of a
    run, and of strings at hot keys, is that of 128 and 64 bits of hash.

    Reads `doc_id`, `text` and the columns of `carry`, which go along in a struct `carried`, so no column can
    clash. An empty table gives no rows.
    Returns a row per row: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_text (the
    remaining characters, without those that are cut through), carried.
    """
    if not 8 <= key <= length <= key + 255 or length < 24:
        raise ValueError("key must be 8 to length bytes, and length at most 255 more")
    spark = documents.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("mark"), text.alias("text"),
                            (F.struct(*carry) if carry else F.struct(F.lit(True).alias("none"))).alias("carried"))

    packed = docs.drop("carried").mapInArrow(_anchor_rows(length, key, shards), _PACKED)
    found = written(packed.groupBy("shard").applyInArrow(_meet(length), _FOUND), "anchors")
    edges = found.filter("kind = 2").select("doc", "mark", "key", "at", "left", "right")
    hot = written(edges.groupBy("key").count().filter(F.col("count") > HOT_EDGES).select("key", F.lit(True).alias("hot")), "hot-keys")
    edges = written(edges.join(hot, "key", "left"), "edges")

    def with_text(rows: DataFrame) -> DataFrame:
        listed = rows.groupBy("doc", "mark").agg(F.collect_list(F.struct("key", "at", "left", "right")).alias("edges"))
        return docs.join(listed, ["doc", "mark"]).drop("carried")

    sort_shards = max(shards, -(-edges.count() // 50_000))
    contexts = with_text(edges.filter("hot is null")).mapInArrow(
        _edge_contexts(length, key, sort_shards),
        "shard int, key long, doc long, mark long, at long, left int, right int, ahead binary, back binary")
    spans = contexts.groupBy("shard").applyInArrow(_sorted_edges(length, key), "doc long, mark long, lo long, hi long")
    if not hot.isEmpty():
        strings = with_text(edges.filter("hot")).mapInArrow(_hot_rows(length, shards), _PACKED)
        again = strings.groupBy("shard").applyInArrow(_meet(length), _FOUND)
        spans = spans.unionByName(again.filter("kind = 1").select("doc", "mark", "lo", "hi"))
    spans = spans.unionByName(found.filter("kind = 1").select("doc", "mark", "lo", "hi"))
    listed = spans.groupBy("doc", "mark").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    return docs.join(listed, ["doc", "mark"], "left").mapInArrow(
        _cut, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_text string, carried {docs.schema['carried'].dataType.simpleString()}")
