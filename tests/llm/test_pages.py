"""Page text and WARC archives."""

import gzip
import hashlib
import io

import duckdb
import pytest

from attest.llm import page_text, warc
from attest.llm.queries import QUERIES, SQL

MENU_LINES = ["Start", "Shop"]
MENU = "<div><p>Start</p><p>Shop</p></div>"


def test_lines_know_articles_and_boilerplate():
    html = ("<head><title>t</title></head><nav><li>Home</li></nav><!-- x --><div class='ad big'>Buy</div><article><h1>A &amp; B</h1>"
            "<p><b>bold\n text.<br><p>next &eacute;<script>var t='</p>'</script></p><div id=comments><p>first!</p></div></article><footer>(c)</footer>")
    assert page_text.lines(html) == [("A & B", True), ("bold text.", True), ("next é", True)]


def test_every_element_can_name_itself_boilerplate():
    html = ("<article><h2 class=header>A</h2><p class='notice'>paid<p>one <span class=ad>buy <span>now</span></span>two <span class=share>left open</p><p>three</p>"
            "<ul><li class=promo>x<ul><li>y</li>z</ul>w<li>four</ul><table><tr><td class=sponsored>s<td>five<tr class=ad><td>t</tr><tr><td>six</table>"
            "<button class=share>Share</button><label class=cookie>c</label>seven<blockquote class=related>r<blockquote>q</blockquote>o</blockquote>eight"
            "<a class=promo href=x><b>deal</b></a><img class=ad> <br class=ad>nine</article><p>last")
    texts = ["A", "one two", "three", "four", "five", "six", "seven", "eight", "nine"]
    found = page_text.lines(html)
    assert [t for t, _ in found] == [*texts[:7], "eight nine", "last"] and [c for _, c in found] == [True] * 8 + [False]


def test_longest_common_subsequence():
    assert page_text.shared_lines(list("abcxdye"), list("abzcde")) == {0, 1, 2, 4, 6}
    assert page_text.shared_lines([], [1]) == set()


def test_shared_lines_go_and_copies_stay(spark):
    rows = [
        (1, "http://h.org/a/1", f"{MENU}<p>one</p><p>end</p>"), (2, "http://h.org/a/2?q=1", f"{MENU}<p>two</p><p>end</p>"),
        (3, "http://other.org/a/1", f"{MENU}<p>alone</p>"), (4, "http://c.org/x", "<p>same</p>"), (5, "http://c.org/y", "<p>same</p>"),
        (6, "http://h.org/a/3", "<article><p>end</p></article>"), (7, None, None), (8, "http://e.org", ""), (None, "http://e.org", "<p>x</p>"),
        (1, "http://h.org/a/1", f"{MENU}<p>one</p><p>end</p>"),
    ]
    pages = spark.createDataFrame([(*r, 1, "g") for r in rows], "page_id long, url string, html string, page long, gone string")
    found = sorted(((r.page_id, r.text, r.n_chars) for r in page_text.main_text(pages).collect()), key=str)
    texts = {i: t for i, t, _ in found}
    assert len(found) == len(rows)
    assert texts[2] == "two" and texts[3] == "Start\nShop\nalone" and texts[4] == texts[5] == "same"
    assert texts[6] == "end" and texts[7] == texts[8] == "" and texts[None] == "x"
    assert page_text.main_text(pages.limit(0)).count() == 0


def test_copies_are_told_from_templates(spark):
    story, tale = ([f"{name} paragraph {i} of some length" for i in range(9)] for name in ("story", "tale"))
    body = lambda texts: "".join(f"<p>{t}</p>" for t in texts)
    near = [body([*MENU_LINES, *story, f"edition {i}"]) for i in range(40)]
    rows = [(i, f"http://n.org/a/{i:02}", html) for i, html in enumerate(near)]  # near copies without article
    rows += [(100, "http://n.org/b", body([*MENU_LINES, *tale]))]  # the only unlike page, beyond the run of copies
    rows += [(200 + i, f"http://p.org/{i}", body([*story, f"edition {i}"])) for i in range(2)]  # a pair alone on its host
    rows += [(300 + i, f"http://t.org/{i}", f"{MENU}<article>{body(texts)}</article><p>Imprint</p>") for i, texts in enumerate((story[:1], tale[:1]))]
    rows += [(400 + i, f"http://x.org/{i}", f"{MENU}<article>{body(story)}</article>") for i in range(3)]  # exact copies, then another page
    rows += [(403, "http://x.org/9", f"{MENU}<article>{body(tale)}</article>"), (404, "http://x.org/0a", ""), (405, "http://x.org/0b", "<article>x</article>")]
    expected = {i: "\n".join([*story, f"edition {i}"]) for i in range(40)} | {100: "\n".join(tale)}
    expected |= {200 + i: "\n".join([*story, f"edition {i}"]) for i in range(2)} | {300: story[0], 301: tale[0]}
    expected |= {400 + i: "\n".join(story) for i in range(3)} | {403: "\n".join(tale), 404: "", 405: "x"}
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    try:
        for partitions in ("1", "13"):  # runs of copies within a partition, and over many
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            assert {r.page_id: r.text for r in page_text.main_text(pages).collect()} == expected
    finally:
        for c, value in kept.items():
            spark.conf.set(c, value)


def test_archives(spark):
    big, other = "<p>é</p>" * 200, "y" * 1000
    rows = [(3, "http://a", big), (9, "http://b\r\nX: y", big), (4, None, big), (5, "u", "small"), (6, "u", "small"), (7, "u", None), (None, "u", big),
            (9, "http://b\r\nX: y", big), (1, "u", other)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], "page_id long, url string, html string, digest string, size int")
    listed = warc.write_archives(pages)
    found = warc.read_archives(warc.normalise(listed)).collect()
    digest = hashlib.sha1(big.encode()).hexdigest()
    kinds = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in found), key=str)
    assert kinds == sorted([
        (3, 1800, "revisit", 9), (9, 1800, "response", None), (9, 1800, "response", None), (4, 1800, "revisit", 9), (None, 1800, "revisit", 9),
        (5, 5, "response", None), (6, 5, "response", None), (7, 0, "response", None), (1, 1000, "response", None)], key=str)
    assert {r.payload_digest for r in found if r.payload_bytes == 1800} == {digest}
    assert warc.read_archives(warc.normalise(warc.write_archives(pages.limit(0)))).count() == 0


def test_sql_of_archives(spark, tmp_path):
    big = "<p>é</p>" * 200
    rows = [(3, big), (9, big), (9, big), (4, big), (None, big), (5, "small"), (6, "small"), (7, None), (8, ""), (None, "y" * 1000), (1, "z" * 999), (2, "z" * 999), (10, "w" * 1000)]
    spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
        expected = db.execute(SQL["op5_warc"]).fetchall()
    found = QUERIES["op5_warc"](spark, str(tmp_path))
    assert found.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(expected, key=str) and len(expected) == len(rows)


def test_gzip_streams():
    data = b"abc" * 500_000
    for packed in (gzip.compress(data), gzip.compress(data[:7]) + gzip.compress(b"") + gzip.compress(data[7:])):
        assert b"".join(warc.inflated(io.BytesIO(packed), 1000)) == data
    with pytest.raises(ValueError):
        list(warc.inflated(io.BytesIO(gzip.compress(data)[:-9])))
    record = warc.record_bytes({"page_id": 1, "url": "u", "payload": b"a\r\n\r\nb", "digest": hashlib.sha1(b"a\r\n\r\nb").hexdigest(), "refers_to": None})
    assert list(warc.records(iter([record[:20], record[20:] + record]))) == [record, record]
    assert warc.parsed(record) == (1, 6, hashlib.sha1(b"a\r\n\r\nb").hexdigest(), "response", None)
    with pytest.raises(ValueError):
        warc.parsed(record.replace(b"b\r\n\r\n", b"c\r\n\r\n"))
