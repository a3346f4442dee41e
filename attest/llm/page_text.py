"""Main text of web pages by differencing each page with the nearest page of its host.

A page is cut into lines, one per block. Lines inside of elements that name themselves boilerplate (menus,
footers, adverts, forms ...) are not text. Pages are paired with the page of the same host whose URL path is
nearest and which is no copy or near copy of it, the lines of both are aligned by a longest common subsequence,
and lines that both share go, unless they stand in an article or main element.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from attest.llm.common import written

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|iframe|textarea|title|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.I | re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
# Elements within a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BOILERPLATE = frozenset("nav footer aside form menu dialog head".split())
BOILERPLATE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies copyright "
    "disclaimer footer gdpr header masthead menu nav navbar navigation newsletter notice notices popup promo promoted related reply replies search "
    "share sharing sidebar skip social sponsor sponsored subscribe subscription widget".split())
CONTENT = frozenset(("article", "main"))
# Elements that stay open until they are closed, or an element around them is.
_NESTED = frozenset("article main section div nav header footer aside form menu dialog head body ul ol dl table figure details".split())
# Elements that a start tag of others ends.
_ROWS = frozenset("tr tbody thead tfoot".split())
_ENDED_BY = {
    "p": frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "td": _ROWS | {"td", "th"}, "th": _ROWS | {"td", "th"}, "tr": _ROWS, "option": frozenset(("option",)),
}
# The header of a heading or of a table is text.
_TITLES = frozenset("h1 h2 h3 h4 h5 h6 th td tr thead caption".split())

# Pages are copies or near copies if they share so much of their lines, and of the text in them.
COPY_LINES = 0.8
COPY_TEXT = 0.5
# Pages, each unlike the one before, that a partition offers to the pages of others.
CHAIN = 4


def _names(attributes: str) -> set[str]:
    return {w for groups in _NAMES.findall(attributes) for name in groups for w in _WORD.findall(name.lower())}


def lines(html: str) -> list[tuple[str, bool]]:
    """The page's lines of text in order, and whether each stands in an article or main element."""
    found: list[tuple[str, bool]] = []
    open_: list[tuple[str, bool, bool]] = [("", False, False)]  # element, boilerplate, content
    held: list[str] = []

    def end_line() -> None:
        if held:
            if text := " ".join(unescape("".join(held)).split()):
                found.append((text, open_[-1][2]))
            held.clear()

    def close(name: str) -> bool:
        """Ends the element; those that are not nested are looked for up to the innermost nested one."""
        for i in range(len(open_) - 1, 0, -1):
            if open_[i][0] == name:
                del open_[i:]
                return True
            if open_[i][0] in _NESTED and name not in _NESTED:
                return False
        return False

    at = 0
    for token in _TOKEN.finditer(html):
        if token.start() > at and not open_[-1][1]:
            held.append(html[at : token.start()])
        at = token.end()
        if token[1]:
            held.append(" ")
            continue
        if not token[3]:
            continue
        name = token[3].lower()
        inline = name in INLINE
        if inline:
            if name in ("br", "img"):
                held.append(" ")
        else:
            end_line()
        if token[2]:
            if not close(name) and not inline:
                while open_[-1][0] in INLINE:  # left open in the element that ends
                    open_.pop()
            continue
        if not inline:
            while name in _ENDED_BY.get(open_[-1][0], ()):
                open_.pop()
        if name in VOID or token[4].endswith("/"):
            continue
        _, skip, content = open_[-1]
        own = name in CONTENT
        named = False
        if not own and name != "body" and token[4]:
            names = _names(token[4])
            named = not BOILERPLATE_NAMES.isdisjoint(names - {"header"} if name in _TITLES else names)
        if name in _NESTED:
            open_.append((name, skip or named or name in BOILERPLATE or (name == "header" and not content), content or own))
        elif name != "html" and (named or any(name == other[0] for other in open_)):
            open_.append((name, skip or named, content))
    if at < len(html) and not open_[-1][1]:
        held.append(html[at:])
    end_line()
    return found


def shared_lines(one: list, two: list) -> set[int]:
    """Places in `one` of a longest common subsequence of both lists."""
    start = 0
    while start < min(len(one), len(two)) and one[start] == two[start]:
        start += 1
    end = 0
    while end < min(len(one), len(two)) - start and one[-1 - end] == two[-1 - end]:
        end += 1
    shared = {*range(start), *range(len(one) - end, len(one))}
    places: dict = {}
    for j in range(len(two) - end - 1, start - 1, -1):
        places.setdefault(two[j], []).append(j)
    # Longest increasing chain of places in `two`; the chain's last places are kept sorted.
    tails: list[int] = []
    ends: list[tuple] = []
    for i in range(start, len(one) - end):
        for j in places.get(one[i], ()):
            k = bisect_left(tails, j)
            link = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(link)
            else:
                tails[k], ends[k] = j, link
    link = ends[-1] if ends else None
    while link:
        shared.add(link[0])
        link = link[1]
    return shared


def url_parts(url: str | None) -> tuple[str, str]:
    """Host and path; query and fragment are left out."""
    _, _, rest = (url or "").rpartition("://")
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, _, path = rest.partition("/")
    return host.lower(), path


def _marks(found: list[tuple[str, bool]]) -> tuple[bytes, bytes]:
    """Hashes of a page's lines, and their lengths, which are negative in an article or main element."""
    import xxhash

    hashes = np.fromiter((xxhash.xxh3_64_intdigest(t) for t, _ in found), np.uint64, len(found))
    return hashes.tobytes(), np.fromiter((-len(t) if content else len(t) for t, content in found), np.int32, len(found)).tobytes()


def _arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


class Page:
    """What pages of a host compare: the path, and hashes and lengths of all lines."""

    __slots__ = ("row", "path", "hashes", "sizes")

    def __init__(self, row, path: str, hashes: bytes, sizes: bytes):
        self.row, self.path, self.hashes, self.sizes = row, path, hashes, sizes

    def _lines(self) -> tuple[list[int], list[int]]:
        return np.frombuffer(self.hashes, np.uint64).tolist(), np.frombuffer(self.sizes, np.int32).tolist()

    def open_lines(self) -> list[int]:
        """Hashes of the lines outside of article and main elements."""
        return np.frombuffer(self.hashes, np.uint64)[np.frombuffer(self.sizes, np.int32) > 0].tolist()

    def like(self, other: Page) -> bool:
        """Whether the two are copies or near copies, so that they cannot tell template from text.

        Copies share most lines, those in articles included, and these hold a good part of the text. Pages whose
        articles differ are no copies, whatever surrounds them.
        """
        if self.hashes == other.hashes:
            return True
        (own, sizes), (others, other_sizes) = self._lines(), other._lines()
        common = Counter(own) & Counter(others)
        if common.total() < COPY_LINES * max(len(own), len(others)):
            return False
        length = dict(zip(own, map(abs, sizes)))
        if sum(n * length[line] for line, n in common.items()) < COPY_TEXT * max(sum(map(abs, sizes)), sum(map(abs, other_sizes))):
            return False
        one = Counter(line for line, size in zip(own, sizes) if size < 0)
        two = Counter(line for line, size in zip(others, other_sizes) if size < 0)
        return (one & two).total() >= COPY_LINES * max(one.total(), two.total())


def unlike_before(pages: list[Page]) -> list[int]:
    """For each page the place of the nearest earlier page that is no copy or near copy of it, or -1.

    Pages between a page and its own unlike neighbour are copies of it, so they are passed over at once: a run
    of copies costs a comparison or two a page.
    """
    found: list[int] = []
    for i, page in enumerate(pages):
        at = i - 1
        while at >= 0 and page.like(pages[at]):
            at = found[at]
        found.append(at)
    return found


def _gone(page: Page, before: Page | None, after: Page | None) -> list[int]:
    """Numbers of the page's open lines that the nearer of its unlike neighbours shares."""
    best, near = -1, None
    for other in (before, after):
        if other is not None:
            one, two = page.path, other.path
            same = next((i for i, (a, b) in enumerate(zip(one, two)) if a != b), min(len(one), len(two)))
            if same > best:
                best, near = same, other
    return sorted(shared_lines(page.open_lines(), near.open_lines())) if near is not None else []


def _line_marks(batches):
    """host, path, and hashes and lengths of all lines, for pages with lines outside of articles."""
    for batch in batches:
        out: list[list] = [[] for _ in range(5)]
        for page, url, html in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "html"))):
            found = lines(html)
            if all(content for _, content in found):
                continue
            for column, value in zip(out, (page, *url_parts(url), *_marks(found))):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["page", "host", "path", "hashes", "sizes"])


_SIDE = "path string, hashes binary, sizes binary"
_MET = (f"part int, page long, gone array<int>, host string, {_SIDE}, before struct<{_SIDE}>, after struct<{_SIDE}>, first_host string, first array<struct<{_SIDE}>>, "
        f"last_host string, last array<struct<{_SIDE}>>")


def _side(page: Page | None) -> dict | None:
    return None if page is None else {"path": page.path, "hashes": page.hashes, "sizes": page.sizes}


def _page(side: dict | None) -> Page | None:
    return None if side is None else Page(None, side["path"], side["hashes"], side["sizes"])


def _chain(pages: list[Page], nearest: list[int], at: int) -> list[dict]:
    """The page at a place, its unlike neighbour, that one's, and so on: what a page of another partition can meet."""
    found = []
    while at >= 0 and len(found) < CHAIN:
        found.append(_side(pages[at]))
        at = nearest[at]
    return found


def _host_runs(batches):
    """Rows of one host at a time."""
    host, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if held and row["host"] != host:
                yield host, held
                held = []
            host = row["host"]
            held.append(Page(row["page"], row["path"], row["hashes"], row["sizes"]))
    if held:
        yield host, held


def _meet(schema: pa.Schema):
    """Meets the pages of a partition, sorted by host and path.

    A page whose unlike neighbours may lie in other partitions is handed on with its lines; a last row holds what
    the pages of other partitions can meet here.
    """

    def task(batches):
        part = TaskContext.get().partitionId()
        edges: dict = {}
        runs = _host_runs(batches)
        run = next(runs, None)
        while run is not None:
            following = next(runs, None)
            host, pages = run
            n = len(pages)
            before = unlike_before(pages)
            after = [n - 1 - p if p >= 0 else -1 for p in reversed(unlike_before(pages[::-1]))]
            if not edges:
                edges = {"part": part, "first_host": host, "first": _chain(pages, after, 0)}
            if following is None:
                edges |= {"last_host": host, "last": _chain(pages, before, n - 1)}
            rows = []
            for i, page in enumerate(pages):
                sides = [pages[p] if p >= 0 else None for p in (before[i], after[i])]
                unmet = (sides[0] is None and host == edges["first_host"]) or (sides[1] is None and following is None)
                if unmet:
                    rows.append({"part": part, "page": page.row, "host": host, **_side(page), "before": _side(sides[0]), "after": _side(sides[1])})
                elif gone := _gone(page, *sides):
                    rows.append({"page": page.row, "gone": gone})
                if len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)
            run = following
        if edges:
            yield pa.RecordBatch.from_pylist([edges], schema)

    return task


def _carried(edges: list[dict], host: str, chain: str, onward: str) -> list[list[dict]]:
    """For each partition in order the chain of unlike pages that the partitions before it end with."""
    out, carry, carry_host = [], [], None
    for edge in edges:
        out.append([{"host": carry_host, "page": side} for side in carry])
        whole = edge[host] == edge[onward]
        if edge[onward] != carry_host or not whole:
            carry = []
        sides = list(edge[chain])
        for side in carry:
            if len(sides) < CHAIN and not _page(sides[-1]).like(_page(side)):
                sides.append(side)
        carry, carry_host = sides, edge[onward]
    return out


_ENDS = f"part int, earlier array<struct<host string, page struct<{_SIDE}>>>, later array<struct<host string, page struct<{_SIDE}>>>"


def _ends(schema: pa.Schema):
    """What each partition's pages can meet in the partitions before and after it; one row per partition comes in."""

    def task(batches):
        edges = sorted((row for batch in batches for row in batch.to_pylist()), key=lambda row: row["part"])
        earlier = _carried(edges, "first_host", "last", "last_host")
        later = _carried(edges[::-1], "last_host", "first", "first_host")[::-1]
        for edge, one, two in zip(edges, earlier, later):
            yield pa.RecordBatch.from_pylist([{"part": edge["part"], "earlier": one, "later": two}], schema)

    return task


def _meet_ends(batches):
    for batch in batches:
        out: list[list] = [[], []]
        for row in batch.to_pylist():
            page = _page(row)
            sides = []
            for own, ends in (("before", "earlier"), ("after", "later")):
                met = _page(row[own])
                if met is None:
                    others = (_page(end["page"]) for end in row[ends] or () if end["host"] == row["host"])
                    met = next((other for other in others if not page.like(other)), None)
                sides.append(met)
            if gone := _gone(page, *sides):
                out[0].append(row["page"])
                out[1].append(gone)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.int32()))], names=["page", "gone"])


def _extract(batches):
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for page_id, url, html, gone in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "gone"))):
            kept, number, gone = [], 0, set(gone or ())
            for text, content in lines(html):
                if content:
                    kept.append(text)
                    continue
                if number not in gone:
                    kept.append(text)
                number += 1
            text = "\n".join(kept)
            for column, value in zip(out, (page_id, url, text, len(text))):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    Neighbours are found by a range partitioning on host, path and page, so that a hot host spreads over many
    tasks; they exchange only hashes and lengths of lines, and the first and last pages of partitions meet like all
    others. Copies and near copies of a page are passed over, however many there are, as are pages without a line
    outside of articles, and the next page is its neighbour; a host's only page, or only copies, have no
    neighbour, and nothing of them is deleted. A page that is like every page up to its partition's end meets the
    nearest CHAIN pages beyond, each unlike the one before.

    Reads `page_id`, `url` and `html` only, so other columns cannot clash. A null or empty html gives empty text; a
    null url is a host of its own name. Rows are told apart by page_id, url and html; equal rows are treated
    alike. An empty table gives no rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    page = F.xxhash64(F.coalesce(F.col("page_id"), F.lit(-1)), F.col("page_id").isNull(), F.coalesce("url", F.lit("")), "html")
    rows = rows.withColumn("page", page)
    order = [F.col(c) for c in ("host", "path", "page")]
    marked = rows.select("page", "url", "html").mapInArrow(_line_marks, f"page long, host string, {_SIDE}")
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order)
    met = written(ranged.mapInArrow(_meet(_arrow_schema(_MET)), _MET), "met-pages")
    # One row per partition comes together in a task.
    ends = met.filter("first_host is not null").select("part", "first_host", "first", "last_host", "last").repartition(1).mapInArrow(_ends(_arrow_schema(_ENDS)), _ENDS)
    unmet = met.filter("host is not null").select("part", "page", "host", "path", "hashes", "sizes", "before", "after")
    late = unmet.join(F.broadcast(ends), "part", "left").mapInArrow(_meet_ends, "page long, gone array<int>")
    gone = met.filter("gone is not null").select("page", "gone").unionByName(late).dropDuplicates(["page"])
    return rows.join(gone, "page", "left").select("page_id", "url", "html", "gone").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
