"""Similarity join of documents on word shingles through a token-group matrix.

A document's tokens are not single shingles but classes of them: the hash space is cut into so many classes
that two documents which reach the threshold must agree on some classes whole (a differing shingle
spoils one class). A shared passage rarely fills a class, so tokens are shared by near copies only.

1. Tokens that one document alone has are dropped. Each document is put into a group with the holder it shares
   most tokens with, of the least holders of its tokens, if these are MET or more. Groups that still meet are
   joined in the same way, so that a cluster of near copies is one group and not many that all meet each other.
   Members of a group are compared in blocks.
2. The matrix keeps each group's token union. A document's overlap with the unions of other groups bounds its
   overlap with their members; only groups that reach the bound are opened.
3. Members of opened groups that share enough tokens are verified. All verified links give the components.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import arrow_slices, ragged, small_batches, written
from attest.llm.graph import components, least_roots
from attest.llm.shingles import mixed, shingle_sets

BLOCK = 1024
ORDERS = 3
MET = 3
ROUNDS = 4
COLUMNS = 2048
ID_BITS = 16
MOST_BITS = 1 << 26
_TOKEN_BYTES = 7
_ROW = "doc_id long, n long, vertex long"


class Bands:
    """Bands of set sizes such that documents that can link lie in the same or in neighbouring bands."""

    def __init__(self, percent: int):
        self.percent = percent
        self.edges = [1]

    def of(self, n: int) -> int:
        while self.edges[-1] <= n:
            self.edges.append(self.edges[-1] * 100 // self.percent + 1)
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def classes(self, band: int) -> tuple[int, int]:
        """Number of classes, and how many of them a pair must agree on whose smaller set lies in the band."""
        while len(self.edges) < band + 2:
            self.edges.append(self.edges[-1] * 100 // self.percent + 1)
        differing = (self.edges[band + 1] - 1) * (100 - self.percent) // self.percent
        agree = 3 + differing // 4
        return (differing + agree, agree) if differing else (0, 0)


def class_tokens(shingles: np.ndarray, band: int, classes: int, agree: int) -> tuple[np.ndarray, int]:
    """The document's tokens for a band, and how many of them a pair must share.

    An empty class is a token too, but a common one: it is left out while there are fewer empty classes than
    classes to agree on, as then some other class must agree.
    """
    own = (shingles % np.uint64(classes)).astype(np.int64)
    order = np.argsort(own, kind="stable")
    number, first = np.unique(own[order], return_index=True)
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mixed(shingles + np.uint64(band))[order], first)
        empty = classes - len(number)
        if empty >= agree:
            sums = np.concatenate((sums, np.zeros(empty, np.uint64)))
            number = np.concatenate((number, np.setdiff1d(np.arange(classes), number)))
            empty = agree  # the other document may leave its empty classes out
        tokens = mixed(sums ^ mixed(np.uint64(band << 32) + number.astype(np.uint64)))
    return tokens >> np.uint64(8 * (8 - _TOKEN_BYTES)), max(1, agree - empty)


def _vertex(shingles: np.ndarray) -> int:
    digest = hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=8, salt=len(shingles).to_bytes(8, "little")).digest()
    return int.from_bytes(digest, "little") >> 1


def _source(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _rows(documents: DataFrame, words: int) -> DataFrame:
    def task(batches):
        for batch in arrow_slices(batches):
            sets = list(shingle_sets(batch.column("text"), words))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            vertices = pa.array([_vertex(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, vertices], names=["doc_id", "n", "vertex"])

    return written(documents.mapInArrow(task, _ROW), "shingled")


def _shared_tokens(documents: DataFrame, words: int, percent: int, shards: int) -> DataFrame:
    """token, vertex, band, need, n: the holders of every token that two vertices hold, some of them more than once.

    Each task sends a token once per slice of texts; other holders of the slice go along unasked, spread
    over the shards, so that no shard gets more of a hot token than one holder per slice.
    """
    bands = Bands(percent)

    def cut(batches):
        for number, batch in enumerate(arrow_slices(batches)):
            held: dict[int, list] = {}
            for shingles in shingle_sets(batch.column("text"), words):
                if len(shingles) and (vertex := _vertex(shingles)) not in held:
                    parts = []
                    top = bands.of(len(shingles))
                    for band in (top - 1, top):
                        classes, agree = bands.classes(band) if band >= 0 else (0, 0)
                        if classes:
                            parts.append((*class_tokens(shingles, band, classes, agree), band))
                    if parts:
                        held[vertex] = [len(shingles), parts]
            if not held:
                continue
            vertices = np.array(list(held), np.int64)
            sizes = np.array([n for n, _ in held.values()], np.int64)
            tokens = np.concatenate([t for _, parts in held.values() for t, _, _ in parts])
            # Band and need of a token travel in one integer.
            needs = np.concatenate([np.full(len(t), band << 20 | need, np.int32) for _, parts in held.values() for t, need, band in parts])
            docs = np.repeat(np.arange(len(held)), [sum(len(t) for t, _, _ in parts) for _, parts in held.values()])
            order = np.lexsort((vertices[docs], tokens))
            tokens, needs, docs = tokens[order], needs[order], docs[order]
            first = np.concatenate(([True], tokens[1:] != tokens[:-1]))
            again = np.repeat(np.diff(np.append(np.flatnonzero(first), len(tokens))) > 1, np.diff(np.append(np.flatnonzero(first), len(tokens))))
            shard = (tokens % np.uint64(shards)).astype(np.int64)
            spread = (np.arange(len(tokens)) + number) % shards
            out = []
            for kind, chosen, to in ((0, first, shard), (1, again & ~first, spread), (2, again & first, spread)):
                at = np.flatnonzero(chosen)
                by = at[np.argsort(to[at], kind="stable")]
                for part in np.split(by, np.flatnonzero(np.diff(to[by])) + 1) if len(by) else []:
                    own = np.unique(docs[part])
                    out.append((int(to[part[0]]), kind, tokens[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_TOKEN_BYTES].tobytes(),
                                np.searchsorted(own, docs[part]).astype("<u4").tobytes(), needs[part].astype("<i4").tobytes(),
                                vertices[own].astype("<i8").tobytes(), sizes[own].astype("<i8").tobytes()))
            kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["shard", "kind", "tokens", "docs", "needs", "vertices", "sizes"])

    def meet(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = {0: [], 1: []}
        for row in table.to_pylist():
            tokens = np.zeros((len(row["needs"]) // 4, 8), np.uint8)
            tokens[:, :_TOKEN_BYTES] = np.frombuffer(row["tokens"], np.uint8).reshape(-1, _TOKEN_BYTES)
            docs = np.frombuffer(row["docs"], "<u4")
            parts[min(row["kind"], 1)].append((tokens.view("<u8").ravel().astype(np.int64), np.frombuffer(row["vertices"], "<i8")[docs],
                                               np.frombuffer(row["needs"], "<i4"), np.frombuffer(row["sizes"], "<i8")[docs]))
        found = []
        if parts[0]:
            columns = [np.concatenate(c) for c in zip(*parts.pop(0))]
            order = np.lexsort((columns[1], columns[0]))
            tokens, vertices = columns[0][order], columns[1][order]
            starts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
            ends = np.append(starts[1:], len(tokens))
            several = vertices[starts] != vertices[ends - 1]
            kept = order[ragged(starts[several], (ends - starts)[several])]
            found.append([c[kept] for c in columns])
        found += parts[1]
        tokens, vertices, needs, sizes = (np.concatenate(c) for c in zip(*found))
        return pa.table({"token": tokens, "vertex": vertices, "band": needs >> 20, "need": needs & 0xFFFFF, "n": sizes})

    packed = documents.mapInArrow(cut, "shard int, kind int, tokens binary, docs binary, needs binary, vertices binary, sizes binary")
    holders = packed.groupBy("shard").applyInArrow(meet, "token long, vertex long, band int, need int, n long")
    return written(holders, "shared-tokens")


def _thinned(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is in `ids`, and few others, so that a join with the ids need not shuffle every text.

    Ids are marked by hash in ID_BITS bits for each, which the driver collects: MOST_BITS, or 8 MB, at most. With more
    ids than these bits can tell apart more documents pass, never fewer.
    """
    count = ids.count()
    size = min(MOST_BITS, 1 << max(10, (ID_BITS * count).bit_length()))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(size)))

    words = placed(ids).groupBy(F.expr("place div 64").alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")).toArrow()
    marks = np.zeros(size // 64, np.int64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    marks = documents.sparkSession.sparkContext.broadcast(marks)

    def task(batches):
        for batch in batches:
            place = batch.column("place").to_numpy()
            marked = marks.value[place >> 6] >> (place & 63) & 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(marked.astype(bool)))

    return placed(documents).mapInArrow(task, "doc_id long, text string")


def _sets(wanted: DataFrame, rows: DataFrame, documents: DataFrame, words: int) -> DataFrame:
    """The shingle sets of the wanted vertices, made again from the text of one document each."""
    chosen = written(rows.join(wanted, "vertex").groupBy("vertex").agg(F.min("doc_id").alias("doc_id")), "chosen")

    def sets(batches):
        for batch in arrow_slices(batches):
            held = [(v, s.astype("<u8").tobytes()) for v, s in ((_vertex(s), s) for s in shingle_sets(batch.column("text"), words) if len(s))]
            columns = list(zip(*held)) if held else [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.binary())], names=["vertex", "shingles"])

    ids = chosen.select(F.col("doc_id").alias("wanted"))
    texts = _thinned(documents, chosen.select("doc_id")).join(ids, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi")
    return written(texts.select("doc_id", "text").mapInArrow(sets, "vertex long, shingles binary").dropDuplicates(["vertex"]), "sets")


def _verified(pairs: DataFrame, rows: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of vertices whose exact shingle sets reach the threshold."""
    kept = _sets(pairs.select(F.explode(F.array("a", "b")).alias("vertex")).distinct(), rows, documents, words)

    def compare(batches):
        for batch in batches:
            good = []
            for one, two in zip(batch.column("one").to_pylist(), batch.column("two").to_pylist()):
                one, two = np.frombuffer(one, "<u8"), np.frombuffer(two, "<u8")
                common = len(np.intersect1d(one, two, assume_unique=True))
                good.append(100 * common >= percent * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = pairs.join(kept.select(F.col("vertex").alias("a"), F.col("shingles").alias("one")), "a")
    both = left.join(kept.select(F.col("vertex").alias("b"), F.col("shingles").alias("two")), "b")
    return written(both.mapInArrow(compare, "a long, b long"), "verified")


def _common(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered in `one` with those in `two`."""
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = count[column] > 1  # a shingle of one set is in no intersection
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    found = np.zeros((len(one), len(two)), np.float32)
    width = int(column[-1]) + 1 if len(column) else 0
    for low in range(0, width, COLUMNS):
        start, end = np.searchsorted(column, (low, low + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[start:end], column[start:end] - low] = 1
        found += held[one] @ held[two].T
    return found.astype(np.int64)


def _inside(groups: DataFrame, rows: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between members of a group, as a spanning forest of each block of members or pair of blocks.

    A group of more than BLOCK members is cut into blocks, and each pair of blocks is compared on its own.
    """
    sets = _sets(groups.select(F.col("node").alias("vertex")), rows, documents, words)
    sized = written(groups.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "group-sizes")
    placed = written(groups.join(sized, "component").select(F.col("node").alias("vertex"), "component", "blocks"), "members")
    held = sets.join(placed, "vertex").withColumn("own", F.pmod(F.xxhash64("vertex"), F.col("blocks")).cast("int"))
    spread = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "vertex", "shingles")

    def compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        vertices, own = table.column("vertex").to_numpy(), table.column("own").to_numpy()
        sets = [np.frombuffer(s, "<u8") for s in table.column("shingles").to_pylist()]
        sizes = np.array([len(s) for s in sets], np.int64)
        one, two = np.flatnonzero(own == low), np.flatnonzero(own == high)
        common = _common(sets, one, two)
        i, j = np.nonzero(100 * common >= percent * (sizes[one][:, None] + sizes[two][None, :] - common))
        roots = least_roots(len(sets), one[i], two[j])
        told = np.flatnonzero(roots != np.arange(len(sets)))
        return pa.table({"a": vertices[told], "b": vertices[roots[told]]})

    return written(spread.groupBy("component", "low", "high").applyInArrow(compare, "a long, b long"), "inside")


def _apart(held: DataFrame) -> DataFrame:
    """The rows of `held` that can matter between groups.

    Tokens of one group alone, and then documents with fewer tokens of a band than they must share, cannot.
    """
    in_band = Window.partitionBy("vertex", "band")
    for _ in range(2):
        apart = held.groupBy("token").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low <> high").select("token")
        held = written(held.drop("tokens").join(written(apart, "tokens-apart"), "token", "left_semi").withColumn(
            "tokens", F.count("*").over(in_band)).filter("tokens >= need"), "holders-apart")
    return held


def _meeting(held: DataFrame) -> DataFrame:
    """Pairs (a, b) of groups: for each document, of the least groups of its tokens, that which holds most of them."""
    rank = [F.struct(F.xxhash64("grp", F.lit(i)).alias("rank"), F.col("grp").alias("b"), F.lit(i).alias("turn")) for i in range(ORDERS)]
    # The greatest too, so that the documents of a token's least group see another one.
    seen = [*[F.min(r) for r in rank], F.max(rank[0].withField("turn", F.lit(ORDERS)))]
    least = written(held.groupBy("token").agg(F.array(*seen).alias("least")), "least-groups")
    stars = held.join(least, "token").select("vertex", "band", "need", "grp", F.inline("least")).filter("grp <> b").groupBy(
        "vertex", "grp", "turn", "b", "band").agg(F.count("*").alias("shared"), F.min("need").alias("need")).filter(f"shared >= least(need, {MET})")
    best = stars.groupBy("vertex", "grp", "turn").agg(F.max(F.struct("shared", "b")).alias("best"))
    return written(best.select(F.col("grp").alias("a"), "best.b").distinct(), "meeting-groups")


def _joined_groups(holders: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups (node, component) after joining those that meet, and the holders that matter between them.

    A group that a document shares MET tokens with may hold a link. Where many such groups meet, asking each
    document for each of them would grow with the square of their number; joined they are compared in blocks.
    """
    held = holders.join(groups, F.col("vertex") == F.col("node"), "left").select(
        "token", "vertex", "band", "need", "n", F.coalesce("component", "vertex").alias("grp")).distinct()
    held = _apart(written(held, "holders"))
    for _ in range(ROUNDS):
        meeting = _meeting(held)
        if meeting.isEmpty():
            break
        into = written(components(meeting).select(F.col("node").alias("grp"), F.col("component").alias("into")), "joined-groups")
        alone = into.select(F.col("grp").alias("node"), F.col("grp").alias("component")).join(groups.select("node"), "node", "left_anti")
        groups = groups.unionByName(alone).join(into, F.col("component") == F.col("grp"), "left").select(
            "node", F.coalesce("into", "component").alias("component"))
        groups = written(groups, "groups")
        held = _apart(held.join(into, "grp", "left").withColumn("grp", F.coalesce("into", "grp")).drop("into"))
    return groups, held


def _sizes_allow(percent: int):
    return F.expr(f"100 * least(n, other_n) >= {percent} * greatest(n, other_n)")


def join_similar(documents: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents linked by a shingle-set Jaccard similarity of `percent` or more.

    A document's set holds its distinct shingles of `words` words; a text of fewer words is one shingle; a null or
    empty text, and one of white space, has an empty set and links with nothing. Equal sets are one vertex, named
    by 63 bits of their digest, and are compared once. Candidates are exact: no link between unlike sets is lost.

    Reads `doc_id` and `text` only, so other columns cannot clash. A row without doc_id links like any other, but
    never names a component. Rows of one doc_id are documents of their own. An empty table gives no rows.
    Returns a row per row: doc_id, n_shingles, component_id (smallest doc_id reached, itself included).
    """
    with small_batches(documents.sparkSession):
        return _join_similar(documents, words, percent)


def _join_similar(documents: DataFrame, words: int, percent: int) -> DataFrame:
    docs = _source(documents)
    rows = _rows(docs, words)
    shards = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    holders = _shared_tokens(docs, words, percent, shards)

    # Similar documents: each vertex with that least holder of its tokens which it shares most of them with.
    # Several orders of the holders give several such neighbours, which joins what belongs together into few groups.
    first = [F.min(F.struct(F.xxhash64("vertex", F.lit(i)).alias("rank"), "vertex", "n", F.lit(i).alias("turn"))) for i in range(ORDERS)]
    least = written(holders.groupBy("token").agg(F.array(*first).alias("least")), "least-holders")
    stars = holders.join(least, "token").select(
        F.col("vertex").alias("a"), F.col("n").alias("own_n"), "band", "need", F.inline("least"))
    stars = stars.select("a", "band", "need", "turn", F.col("vertex").alias("b"), F.col("own_n").alias("n"), F.col("n").alias("other_n"))
    stars = stars.filter("a <> b").filter(_sizes_allow(percent)).groupBy("a", "turn", "b", "band").agg(
        F.count("*").alias("shared"), F.min("need").alias("need")).filter(f"shared >= least(need, {MET})")
    stars = written(stars.groupBy("a", "turn").agg(F.max(F.struct("shared", "b")).alias("best")).select("a", "best.b"), "stars")
    groups = written(components(stars), "groups")
    groups, held = _joined_groups(holders, groups)
    links = _inside(groups, rows, docs, words, percent)

    # The matrix: which groups hold a token.
    in_band = Window.partitionBy("vertex", "band")
    matrix = written(held.select("token", F.col("grp").alias("other")).distinct(), "matrix")
    # A group that shares `need` of a document's tokens has MET of them among all but its `need` - MET commonest.
    # Only groups met there are asked for the others.
    common = written(matrix.groupBy("token").agg(F.count("*").alias("groups")), "token-groups")
    ranked = held.join(common, "token").withColumn("at", F.row_number().over(in_band.orderBy("groups", "token")))
    ranked = written(ranked.withColumn("met", F.least("need", F.lit(MET))).withColumn("probe", F.expr("at <= tokens - need + met")).select(
        "token", "vertex", "band", "grp", "need", "met", "probe"), "ranked-tokens")
    one = ["vertex", "band", "other", "need"]
    met = ranked.filter("probe").join(matrix, "token").filter("grp <> other").groupBy(*one, "met").agg(F.count("*").alias("overlap"))
    met = written(met.filter("overlap >= met").select(*one, "overlap"), "groups-met")
    others = ranked.filter("not probe").select("token", "vertex", "band").join(met.drop("overlap"), ["vertex", "band"]).join(
        matrix, ["token", "other"], "left_semi").select(*one, F.lit(1).cast("long").alias("overlap"))
    opened = met.unionByName(others).groupBy(*one).agg(F.sum("overlap").alias("overlap")).filter("overlap >= need").select("vertex", "band", "other")
    queries = held.select("token", "vertex", "band", "need", "n").join(written(opened, "opened"), ["vertex", "band"])
    members = held.select("token", F.col("vertex").alias("member"), F.col("grp").alias("other"), F.col("need").alias("other_need"), F.col("n").alias("other_n"))
    pairs = queries.join(members, ["token", "other"]).filter(_sizes_allow(percent)).groupBy(
        F.least("vertex", "member").alias("a"), F.greatest("vertex", "member").alias("b"), "band", "vertex").agg(
        F.count("*").alias("shared"), F.max(F.greatest("need", "other_need")).alias("need")).filter("shared >= need").select("a", "b")
    pairs = written(pairs.distinct(), "pairs")
    more = _verified(pairs, rows, docs, words, percent)
    whole = components(links.unionByName(more))

    first = written(rows.filter("vertex is not null").groupBy("vertex").agg(F.min("doc_id").alias("first")).join(
        whole, F.col("vertex") == F.col("node"), "left").select("vertex", "first", F.coalesce("component", "vertex").alias("root")), "vertices")
    named = written(first.groupBy("root").agg(F.min("first").alias("least")), "components")
    result = written(first.join(named, "root").select("vertex", "least"), "vertex-components")
    return rows.join(result, "vertex", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))
