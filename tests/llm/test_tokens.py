"""Byte-level BPE, packing and token-id files against the tokenizer libraries, and exact round trips."""

import base64
import io
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from attest.llm import byte_bpe, packing, token_files
from attest.llm.token_files import TokenFile, pack_block, unpack_block, write_file
from attest.llm.tokenized import TextEncoder, text_encoder

RANKS, BYTE, WORD = (P.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "word_bpe_49k.json"))


def tiktoken_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def by_library(path, text, end):
    tokenizer = Tokenizer.from_file(path)
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_encode_and_decode(spark, odd_documents):
    rows = byte_bpe.decode(byte_bpe.encode(odd_documents, RANKS, P.PATTERN), RANKS).collect()
    texts = {(r.doc_id, r.text or "") for r in odd_documents.collect()}
    encoding = tiktoken_encoding()
    assert len(rows) == odd_documents.count()
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in rows} == texts
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(bytes(r.decoded).decode())
    empty = odd_documents.limit(0)
    assert byte_bpe.decode(byte_bpe.encode(empty, RANKS, P.PATTERN), RANKS).count() == 0


def test_words_travel_packed(spark, monkeypatch):
    sent, words = [], byte_bpe._encoded_words

    def counted(chapters, path):
        sent.append(words(chapters, path))
        return sent[0]

    monkeypatch.setattr(byte_bpe, "_encoded_words", counted)
    texts = {i: " ".join(f"w{i}x{j}" for j in range(2000)) for i in range(4)}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    encoding = tiktoken_encoding()
    for r in byte_bpe.encode(table, RANKS, P.PATTERN).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == encoding.encode_ordinary(texts[r.doc_id])
    assert sent[0].count() <= 100


def test_numbers_of_words_are_not_shuffled(spark, monkeypatch):
    held, chapters = [], byte_bpe._chapters

    def counted(documents, pattern, shards):
        held.append(chapters(documents, pattern, shards))
        return held[0]

    monkeypatch.setattr(byte_bpe, "_chapters", counted)
    monkeypatch.setattr(byte_bpe, "CHAPTER_CHARS", 50_000)
    texts = [(i if i % 7 else None, "the same few words " * 2000 + str(i)) for i in range(20)] + [(30, ""), (31, None)]
    encoding = tiktoken_encoding()
    found = byte_bpe.encode(spark.createDataFrame(texts, "doc_id long, text string").coalesce(1), RANKS, P.PATTERN).collect()
    key = lambda x: (x[0] or 0, x[1])
    assert sorted(((r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in found), key=key) == sorted(((i, encoding.encode_ordinary(t or "")) for i, t in texts), key=key)
    rows = held[0].toArrow()
    assert rows.nbytes < 100_000 and rows.num_rows - rows.column("path").null_count >= 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=12), max_size=5))
def test_first_occurrences_are_marked(rows):
    known = {}
    for row in rows:
        before = len(known)
        numbers = np.array([known.setdefault(w, len(known)) for w in row], np.int64)
        marked = byte_bpe._marked(numbers, before)
        assert byte_bpe._unmarked(byte_bpe._numbers(byte_bpe._planes(marked))).tolist() == numbers.tolist()
        assert np.count_nonzero(marked[1:] == 0) == len(known) - before


def test_packing(spark, odd_documents):
    rows = packing.pack(odd_documents, BYTE, 1, capacity=64).collect()
    texts = {r.doc_id: r.text for r in odd_documents.collect()}
    copies = {i: 2 if i == 1 else 1 for i in texts}
    windows, pieces = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, len(r.ids) // 4))
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for held in windows.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *[n for _, n in held]])[:-1].tolist()
        assert sum(n for _, n in held) <= 64
    assert sum(sum(n for _, n in h) < 64 for h in windows.values()) <= packing.OPEN_WINDOWS
    for doc, text in texts.items():
        whole = by_library(BYTE, text, 1)
        assert sum(len(ids) for _, ids, _ in pieces[doc]) == copies[doc] * len(whole)
        for start, ids, total in pieces[doc]:
            assert ids == whole[start : start + len(ids)] and total == len(whole)
    assert packing.pack(odd_documents.limit(0), BYTE, 1).count() == 0


def test_packer_places_best_and_emits_the_fullest():
    packer = packing.Packer(10, 2, 0)
    for doc, n in enumerate((6, 8, 2, 5, 4)):
        packer.add(doc, np.arange(n))
    # 8 and 2 fill a window; 5 opens one beside 6; 4 fits 6 best
    assert [(d, s) for d, _, _, _, s, _ in packer.done] == [(1, 0), (2, 0), (0, 1), (4, 1)]
    packer.add(5, np.arange(7))
    packer.add(6, np.arange(9))
    assert packer.done[-1][0] == 5


def test_token_files(spark, odd_documents):
    files = token_files.write_token_files(odd_documents, WORD, 2, block=128)
    rows = token_files.read_token_files(files, block=128).collect()
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd_documents.collect()), key=lambda i: (i is not None, i))
    texts, at = {r.doc_id: r.text for r in odd_documents.collect()}, 0
    for r in rows:
        whole = by_library(WORD, texts[r.doc_id], 2)
        assert (r.start, np.frombuffer(r.ids, "<u4").tolist()) == (at, whole)
        at += len(whole)
    none = token_files.write_token_files(odd_documents.limit(0), WORD, 2)
    assert token_files.read_token_files(none).count() == 0


def test_blank_lines_and_inner_white_space_keep_words_apart():
    encoder = TextEncoder(WORD, 2, drops_space=True)
    for texts in (["x\n\na\tb"], ["second line\n\nthird"], ["a\u00a0b  c", "\r\n\r\nd\re f"], [" a", "\t", "", "c\n\nx"]):
        ids, counts = encoder(pa.array(texts))
        expected = [by_library(WORD, t, 2) for t in texts]
        assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", " ", "\n", "a", "Don't", "é", "12"]), max_size=6), min_size=1, max_size=5))
def test_added_tokens_are_one_id_wherever_they_stand(parts):
    texts = ["".join(p) for p in parts]
    for path, end, drops in ((WORD, 2, True), (BYTE, 1, False)):
        ids, counts = text_encoder(path, end, drops)(pa.array(texts))
        expected = [by_library(path, t, end) for t in texts]
        assert counts.tolist() == list(map(len, expected)) and ids.tolist() == [i for e in expected for i in e]


def test_rows_of_one_doc_id_start_alike_in_every_run(spark):
    rows = [(5, f"text {i * 7 % 40} " * (i % 9)) for i in range(40)] + [(5, None), (None, "x"), (None, "")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted((r.start, r.doc_id or -1, bytes(r.ids)) for r in token_files.read_token_files(token_files.write_token_files(t, WORD, 2)).collect())
            for t in (table, table.repartition(5, "text"))]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**40) | st.just(2**64 - 1) | st.integers(0, 9), min_size=1, max_size=300), st.sampled_from([0.5, 0.95, 1.0]))
def test_blocks_round_trip(values, share):
    data = pack_block(np.array(values, np.uint64), share)
    assert token_files.block_bytes(data[: token_files._HEAD.size]) == len(data)
    assert unpack_block(data).tolist() == values


def test_random_access_and_damage():
    ids = np.arange(1000, dtype=np.uint32) * 37 % 50_000
    out = io.BytesIO()
    write_file(out, iter([([5, None], ids, np.array([999, 1]))]), block=64)
    file = TokenFile(out, out.tell(), block=64)
    assert file.ids(130, 70).tolist() == ids[130:200].tolist()
    assert [(k, s, len(x)) for k, s, x in file.documents(100)] == [(5, 0, 999), (None, 999, 1)]
    with pytest.raises(ValueError):
        TokenFile(io.BytesIO(out.getvalue()[:-1]), len(out.getvalue()) - 1)
    assert zlib.crc32(ids.tobytes()) == zlib.crc32(np.concatenate([x for _, _, x in file.documents()]).tobytes())


@pytest.mark.parametrize("n", [1, 7, 128])
def test_blocks_of_every_width(monkeypatch, n):
    rng = np.random.default_rng(n)
    spread = np.unpackbits
    for width in range(65):
        values = rng.integers(0, 1 << width, n, np.uint64, endpoint=False) if width < 64 else rng.integers(0, (1 << 64) - 1, n, np.uint64, endpoint=True)
        for share in (1.0, 0.5):
            data = pack_block(values, share)
            # only values that can lie in nine bytes are spread to single bits
            monkeypatch.setattr(np, "unpackbits", spread if width > 57 else None)
            assert unpack_block(data).tolist() == values.tolist()
            monkeypatch.setattr(np, "unpackbits", spread)
