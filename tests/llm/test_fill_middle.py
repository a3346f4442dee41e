"""Fill-in-the-middle against plain string work, and an exact round trip."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from attest.llm import fill_middle

LINES = re.compile(r"[^\n]*\n|[^\n]+")


def by_hand(doc_id, text, seed=7):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    lines = LINES.findall(text or "")
    n = len(lines)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text or ""
    if h4 % 100 < 50:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_rank_and_select_equal_counting():
    rng = np.random.default_rng(1)
    for size in (0, 1, 7, 8, 9, 64, 1000):
        data = rng.choice(np.array([0x0A, 0x0B, 0x8A, 0x09, 0xC3, 0xA9, 0x00, 0xFF], np.uint8), size)
        padded = np.zeros((size + 7) // 8 * 8, np.uint8)
        padded[:size] = data
        marks = fill_middle.Marks(fill_middle.line_feeds(padded.view("<u8")))
        places = np.flatnonzero(data == 0x0A)
        assert marks.select(np.arange(len(places))).tolist() == places.tolist()
        at = np.arange(len(padded) + 1)
        assert marks.rank(at).tolist() == [int((padded[:i] == 0x0A).sum()) for i in at]
        points = fill_middle.Marks(fill_middle.code_points(padded.view("<u8")))
        assert points.rank(at).tolist() == [int(((padded[:i] & 0xC0) != 0x80).sum()) for i in at]


def test_a_slice_of_an_array_is_read_from_its_own_start():
    texts = pa.array(["skipped\n", "a\nb", "é\n\n"]).slice(1)
    n, first, second, prefix, middle = fill_middle.cuts(texts, np.array([1, 2]), np.array([2, 1]))
    assert n.tolist() == [2, 2] and first.tolist() == [2, 3] and second.tolist() == [3, 4]
    assert prefix.tolist() == [2, 2] and middle.tolist() == [1, 1]


@pytest.fixture(scope="module")
def odd_texts(spark, odd_documents):
    more = [(100 + i, t) for i, t in enumerate(["\n", "\n\n\n", "one line", "a\nb\nc", "a\n\nb\n", "é日🙂\n" * 50, "<P> held\nx", "no <S\n>marker<", "x<", "<\n<P", "\r\n\r\n", "end<M>"])]
    more += [(200 + i, f"line {i}\nsecond <\n<S third\n" * (i % 5) + "tail" * (i % 2)) for i in range(60)]
    return odd_documents.select("doc_id", "text", "lang", "vertex").unionByName(
        spark.createDataFrame([(i, t, "en", 1) for i, t in more], "doc_id long, text string, lang string, vertex long"))


def test_equals_plain_string_work_and_restores(odd_texts):
    rows = fill_middle.restore(fill_middle.rearrange(odd_texts)).collect()
    assert len(rows) == odd_texts.count()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == by_hand(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")


def test_share_of_plain_texts_and_of_either_form(odd_texts):
    assert {r["form"] for r in fill_middle.rearrange(odd_texts, fim_percent=0).collect()} == {"plain"}
    assert {r["form"] for r in fill_middle.rearrange(odd_texts, spm_percent=0).collect()} == {"plain", "psm"}


def test_clashing_columns_are_replaced_and_empty_tables_stay_empty(spark):
    rows = spark.createDataFrame([(1, "a\nb\n", "x", "y", "z")], "doc_id long, text string, form string, output string, `odd.name` string")
    out = fill_middle.restore(fill_middle.rearrange(rows))
    assert out.columns == ["doc_id", "text", "odd.name", *fill_middle.COLUMNS, "restored"]
    assert out.collect()[0]["odd.name"] == "z"
    assert fill_middle.rearrange(rows.limit(0)).count() == 0
