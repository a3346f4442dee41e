"""Chains that are continued from their heads, and trees over their segments.

A head holds what a chain needs to go on: its length and last hash, the payload digests of its open segment, and the running
hashes behind the closed ones (`ledger` tells how segments are anchored). A head is of bounded size, so a chain
grows without a stored record being read. A ledger folder takes commits one after the other: a writer claims the next
version by creating a file that must not exist yet, and the loser of a race is refused.

A tree holds a node for each segment and each FANOUT nodes below, so that a proof or a comparison reads a few nodes for each
level and not the records.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.functions.vocab import GENESIS
from attest.operators import ledger
from attest.operators.position import with_position
from attest.session import broadcast_if_small, checkpointed

FANOUT = 16
HEAD = ("length bigint, last_hash string, open_digests array<string>, anchor string, block_start string, block_digest string")
_HEAD_NAMES = [f.split()[0] for f in HEAD.split(", ")]


class Conflict(Exception):
    """Another writer has taken the version that this commit was made for."""


def link(before: Column, digest: Column) -> Column:
    """The running hash behind one more digest."""
    return F.sha2(F.concat(before, F.lit("|"), digest), 256)


def _each(entries: str, start: Column) -> Column:
    """The start, and the running hash behind each entry."""
    return F.aggregate(entries, F.array(start), lambda done, e: F.concat(done, F.array(link(F.element_at(done, -1), e["digest"]))))


def no_heads(spark: SparkSession, records: DataFrame, chain_id: str) -> DataFrame:
    return records.select(chain_id).limit(0).select(chain_id, *[F.expr(f"cast(null as {f.split(' ', 1)[1]})").alias(f.split()[0]) for f in HEAD.split(", ")])


def continued(heads: DataFrame, records: DataFrame, chain_id: str, order: list[str], columns: list[str],
              segment_size: int) -> tuple[DataFrame, DataFrame]:
    """New records of chains, linked to their heads, and the new heads of these chains; equal to chaining all at once.

    New records stand after the stored ones, in the given order. Only heads of chains that receive records are used, and no
    stored record is read. At most `segment_size` records, segments or blocks meet in one group, up to segment_size ** 3
    new records of a chain. A chain without a head begins here; NULL is a chain like any other.
    """
    placed = with_position(records, order, [chain_id])
    old = heads.select(F.col(chain_id).alias("_c"), *[F.col(n).alias(f"_{n}") for n in _HEAD_NAMES])
    placed = placed.join(old, F.col(chain_id).eqNullSafe(F.col("_c")), "left").select(
        *records.columns, (F.col("position") + F.coalesce("_length", F.lit(0))).alias("position"), F.col("_length"), F.col("_last_hash"))
    placed = placed.withColumn("_payload", ledger.payload(placed, chain_id, columns)).withColumn(
        "segment", F.floor((F.col("position") - 1) / segment_size).cast("bigint"))
    others = [c for c in placed.columns if c not in (chain_id, "segment", "position", "_payload", "_length", "_last_hash")]
    groups = placed.groupBy(chain_id, "segment").agg(
        F.array_sort(F.collect_list(F.struct("position", "_payload", *others))).alias("_rows"),
        F.max("_length").alias("_length"), F.max("_last_hash").alias("_last_hash"))
    # written once: the rows are needed for the digests and again for the hashes
    groups = checkpointed(groups)
    opened = F.floor(F.coalesce("_length", F.lit(0)) / segment_size).cast("bigint")
    goes_on = (F.col("segment") == opened) & (F.coalesce("_length", F.lit(0)) % segment_size > 0)
    slim = groups.select(chain_id, "segment", goes_on.alias("goes_on"), opened.alias("opened"), F.transform(
        "_rows", lambda r: F.sha2(r["_payload"], 256)).alias("_own"), F.size("_rows").alias("_n")).join(
        old, F.col(chain_id).eqNullSafe(F.col("_c")), "left")
    held = F.when(F.col("goes_on"), F.concat("_open_digests", "_own")).otherwise(F.col("_own"))
    digested = slim.select(
        chain_id, "segment", "goes_on", "opened", held.alias("held"), F.sha2(F.array_join(held, ""), 256).alias("digest"), F.floor(F.col("segment") / segment_size).alias("block"),
        F.coalesce("_anchor", F.lit(GENESIS)).alias("_anchor"), F.coalesce("_block_start", F.lit(GENESIS)).alias("_block_start"), F.coalesce("_block_digest", F.lit("")).alias("_block_digest"))
    digested = checkpointed(digested)
    begun = F.floor(F.col("opened") / segment_size)
    blocks = digested.groupBy(chain_id, "block", "opened", "_anchor", "_block_start", "_block_digest").agg(
        F.array_sort(F.collect_list(F.struct("segment", "digest"))).alias("_segments"))
    first = F.col("block") == begun
    within = blocks.select("*", _each("_segments", F.when(first, F.col("_block_digest")).otherwise(F.lit(""))).alias("_within"))
    chained = within.groupBy(chain_id, "_block_start").agg(F.array_sort(F.collect_list(F.struct(
        "block", F.element_at("_within", -1).alias("digest")))).alias("_blocks"))
    starts = chained.select(F.col(chain_id).alias("_k"), _each("_blocks", F.col("_block_start")).alias("_starts"), F.posexplode("_blocks").alias("_i", "_b")).select(
        "_k", F.col("_b.block").alias("_at"), F.get("_starts", F.col("_i")).alias("_start"))
    anchored = within.join(starts, F.col(chain_id).eqNullSafe(F.col("_k")) & (F.col("block") == F.col("_at")))
    running = _each("_segments", F.when(first, F.col("_anchor")).otherwise(F.col("_start")))
    anchors = checkpointed(anchored.select(chain_id, "_start", "_within", running.alias("_running"), F.posexplode("_segments").alias("_i", "_s")).select(
        F.col(chain_id).alias("_k"), F.col("_s.segment").alias("_at"), "_start", F.col("_s.digest").alias("_digest"),
        F.get("_running", F.col("_i")).alias("_before"), F.get("_within", F.col("_i")).alias("_inner")))

    met = groups.withColumn("goes_on", goes_on).join(anchors, F.col(chain_id).eqNullSafe(F.col("_k")) & (F.col("segment") == F.col("_at")))
    begin = F.when(F.col("goes_on"), F.col("_last_hash")).otherwise(F.col("_before"))
    hashes = F.aggregate("_rows", F.array(begin), lambda done, r: F.concat(done, F.array(ledger.record_hash(F.element_at(done, -1), r["_payload"]))))
    rows = met.withColumn("_hashes", hashes).select(chain_id, "segment", "_hashes", F.posexplode("_rows").alias("_i", "_row")).select(
        chain_id, "segment", "_row.position", *[F.col("_row").getField(c).alias(c) for c in others],
        F.get("_hashes", F.col("_i")).alias("previous_hash"), F.get("_hashes", F.col("_i") + 1).alias("record_hash"))
    return rows, _new_heads(rows, digested, anchors, chain_id, segment_size)


def _new_heads(rows: DataFrame, digested: DataFrame, anchors: DataFrame, chain_id: str, size: int) -> DataFrame:
    ends = rows.groupBy(chain_id).agg(F.max("position").alias("length"), F.max_by("record_hash", "position").alias("last_hash"))
    last = digested.groupBy(F.col(chain_id).alias("_c")).agg(F.max_by(F.struct("segment", "held"), "segment").alias("l"))
    last = last.select("_c", F.col("l.segment").alias("_s"), F.col("l.held").alias("_held"))
    met = ends.join(last, F.col(chain_id).eqNullSafe(F.col("_c"))).join(anchors, F.col(chain_id).eqNullSafe(F.col("_k")) & (F.col("_s") == F.col("_at")))
    closed = F.col("length") % size == 0
    ended = closed & ((F.col("_s") + 1) % size == 0)
    inner = F.when(closed, link(F.col("_inner"), F.col("_digest"))).otherwise(F.col("_inner"))
    next_start = F.when(ended, link(F.col("_start"), link(F.col("_inner"), F.col("_digest")))).otherwise(F.col("_start"))
    return met.select(
        chain_id, "length", "last_hash", F.when(closed, F.expr("cast(array() as array<string>)")).otherwise(F.col("_held")).alias("open_digests"),
        F.when(ended, next_start).when(closed, link(F.col("_before"), F.col("_digest"))).otherwise(F.col("_before")).alias("anchor"),
        next_start.alias("block_start"), F.when(ended, F.lit("")).otherwise(inner).alias("block_digest"))


# --- commits ----------------------------------------------------------------


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def _versions(spark: SparkSession, folder: str) -> list[str]:
    """Names of the commits, in order; the file of a version holds the name of its commit."""
    fs, path = _files(spark, f"{folder}/versions")
    if not fs.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(path))
    found = {r["number"]: r["value"] for r in spark.read.text(f"{folder}/versions").select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("number"), "value").collect()} if names else {}
    if len(found) < len(names):
        raise Conflict(f"version {len(names)} of '{folder}' has no commit yet")
    return [found[n] for n in names]


def read_heads(spark: SparkSession, folder: str) -> DataFrame | None:
    """The last head of every chain, or None before the first commit."""
    names = _versions(spark, folder)
    if not names:
        return None
    parts = [spark.read.parquet(f"{folder}/heads/{n}") for n in names]
    log = reduce(DataFrame.unionByName, parts)
    chain_id = log.columns[0]
    return ledger.latest(log, [chain_id], ["length"])


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all commits. What a refused or broken writer left is not among them."""
    return spark.read.parquet(*[f"{folder}/records/{n}" for n in _versions(spark, folder)])


def commit(records: DataFrame, folder: str, chain_id: str, order: list[str], columns: list[str], segment_size: int,
           expected_version: int | None = None) -> int:
    """Appends records to the ledger in `folder` and returns the new version.

    Records and heads are written aside first; the commit counts once the file of its version is there. That file is
    created only if it does not exist, so of two writers who start from one version the second is refused with `Conflict`, and no
    reader sees its rows. `expected_version` refuses at once where the ledger has moved on. The list of versions has one
    name for each commit. The file system must create files atomically, as HDFS and local ones do.
    """
    spark = records.sparkSession
    version = len(_versions(spark, folder))
    if expected_version is not None and expected_version != version:
        raise Conflict(f"'{folder}' is at version {version}, not {expected_version}")
    heads = read_heads(spark, folder)
    rows, new_heads = continued(no_heads(spark, records, chain_id) if heads is None else heads, records, chain_id, order, columns, segment_size)
    name = uuid.uuid4().hex
    rows.write.parquet(f"{folder}/records/{name}")
    new_heads.write.parquet(f"{folder}/heads/{name}")
    claim(spark, folder, version + 1, name)
    return version + 1


def claim(spark: SparkSession, folder: str, version: int, name: str) -> None:
    fs, _ = _files(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/versions/{version:012d}")
    try:
        out = fs.create(path, False)
    except Exception as error:
        raise Conflict(f"version {version} of '{folder}' was taken by another writer") from error
    out.write(bytearray(name.encode()))
    out.close()


# --- trees over segments ----------------------------------------------------


def tree(stored: DataFrame, chain_id: str, columns: list[str], segment_size: int, fanout: int = FANOUT) -> DataFrame:
    """Nodes (chain, level, place, hash) over the segments of every chain: level 0 are the segments' digests, each node above is the hash
    of at most `fanout` below, and a chain ends in the level with one node. Levels are written one by one; the driver reads one number."""
    rows = stored.withColumn("place", F.floor((F.col("position") - 1) / segment_size).cast("bigint")).withColumn("_payload", ledger.payload(stored, chain_id, columns))
    digests = F.transform(F.array_sort(F.collect_list(F.struct("position", F.sha2("_payload", 256).alias("d")))), lambda r: r["d"])
    level = checkpointed(rows.groupBy(chain_id, "place").agg(F.sha2(F.array_join(digests, ""), 256).alias("hash")))
    levels, number = [level], 0
    while (level.agg(F.max("place")).first()[0] or 0) > 0:
        above = level.groupBy(chain_id, F.floor(F.col("place") / fanout).cast("bigint").alias("place")).agg(
            F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("below"), F.count("*").alias("n"))
        # a chain that has ended goes up no further
        ended = level.groupBy(F.col(chain_id).alias("_c")).agg(F.max("place").alias("top")).filter("top = 0").select("_c")
        grown = above.join(ended, F.col(chain_id).eqNullSafe(F.col("_c")), "left_anti")
        level = checkpointed(grown.select(chain_id, "place", node_hash(F.transform("below", lambda b: b["hash"])).alias("hash")))
        levels.append(level)
        number += 1
    return reduce(DataFrame.unionByName, [df.select(chain_id, F.lit(i).alias("level"), "place", "hash") for i, df in enumerate(levels)])


def node_hash(children: Column) -> Column:
    return F.sha2(F.array_join(children, "|"), 256)


def roots(nodes: DataFrame, chain_id: str) -> DataFrame:
    """The last node of every chain: what is kept apart to check proofs against."""
    return nodes.groupBy(chain_id).agg(F.max_by("hash", "level").alias("root"), F.max("level").alias("height"))


def proofs(nodes: DataFrame, wanted: DataFrame, chain_id: str, segment_size: int, fanout: int = FANOUT) -> DataFrame:
    """An inclusion proof for each row of `wanted` (chain, position): `segment`, `digest` of the segment, and `path`: for each level the children of
    the node above, and which of them is proven. Reads a node's siblings on each level, never a record."""
    tall = roots(nodes, chain_id).select(F.col(chain_id).alias("_c"), "height")
    asked = wanted.select(chain_id, "position", F.floor((F.col("position") - 1) / segment_size).cast("bigint").alias("segment"))
    steps = asked.join(tall, F.col(chain_id).eqNullSafe(F.col("_c"))).select(chain_id, "segment", "height").distinct()
    steps = steps.filter("height > 0").select(chain_id, "segment", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("level"))
    parent = F.floor(F.col("segment") / F.pow(F.lit(fanout), F.col("level") + 1)).cast("bigint")
    families = nodes.groupBy(F.col(chain_id).alias("_c"), F.col("level").alias("_level"), F.floor(F.col("place") / fanout).cast("bigint").alias("_parent")).agg(
        F.array_sort(F.collect_list(F.struct("place", "hash"))).alias("family"))
    met = steps.withColumn("parent", parent).join(families, F.col(chain_id).eqNullSafe(F.col("_c")) & (F.col("level") == F.col("_level")) & (F.col("parent") == F.col("_parent")))
    own = F.floor(F.col("segment") / F.pow(F.lit(fanout), F.col("level"))).cast("bigint") - F.element_at("family", 1)["place"]
    paths = met.groupBy(chain_id, "segment").agg(F.array_sort(F.collect_list(F.struct(
        "level", own.alias("at"), F.transform("family", lambda f: f["hash"]).alias("children")))).alias("path")).withColumnsRenamed({chain_id: "_p", "segment": "_ps"})
    leaves = nodes.filter("level = 0").select(F.col(chain_id).alias("_l"), F.col("place").alias("_ls"), F.col("hash").alias("digest"))
    none = F.expr("cast(array() as array<struct<level:int,at:bigint,children:array<string>>>)")
    return asked.join(leaves, F.col(chain_id).eqNullSafe(F.col("_l")) & (F.col("segment") == F.col("_ls"))).join(
        paths, F.col(chain_id).eqNullSafe(F.col("_p")) & (F.col("segment") == F.col("_ps")), "left").select(
        chain_id, "position", "segment", "digest", F.coalesce("path", none).alias("path"))


def proven_root(digest: str = "digest", path: str = "path") -> Column:
    """The root that a proof leads to; NULL where a level does not hold the hash below it."""
    return F.aggregate(path, F.col(digest), lambda below, step: F.when(
        F.get(step["children"], step["at"].cast("int")) == below, node_hash(step["children"])))


def differing_segments(ours: DataFrame, theirs: DataFrame, chain_id: str, fanout: int = FANOUT) -> DataFrame:
    """Segments (chain, segment) in which two ledgers differ, found from their trees: roots first, then only what lies below nodes
    that differ. Chains of other heights, and chains that one side lacks, differ in every segment that has no equal node."""
    top = max(ours.agg(F.max("level")).first()[0] or 0, theirs.agg(F.max("level")).first()[0] or 0)

    def side(nodes: DataFrame, level: int, name: str) -> DataFrame:
        return nodes.filter(F.col("level") == level).select(F.col(chain_id).alias("_c"), F.col("place").alias("place"), F.col("hash").alias(name))

    frontier, found = None, None
    for level in range(top, -1, -1):
        sides = side(ours, level, "a").unionByName(side(theirs, level, "b"), allowMissingColumns=True)
        met = sides.groupBy("_c", "place").agg(F.max("a").alias("a"), F.max("b").alias("b"))
        odd = met.filter(~F.col("a").eqNullSafe(F.col("b")))
        if frontier is not None:
            heads = sides.groupBy(F.col("_c").alias("_t")).agg(F.max("place").alias("_top")).filter("_top = 0").select("_t")
            below = odd.join(frontier, F.col("_c").eqNullSafe(F.col("_f")) & (F.floor(F.col("place") / fanout) == F.col("_at")), "left_semi")
            odd = below.unionByName(odd.join(heads, F.col("_c").eqNullSafe(F.col("_t")), "left_semi")).distinct()
        found = broadcast_if_small(odd.select(F.col("_c").alias("_f"), F.col("place").alias("_at")))
        frontier = found
    return found.select(F.col("_f").alias(chain_id), F.col("_at").cast("bigint").alias("segment"))


def changed_records(ours: DataFrame, theirs: DataFrame, segments: DataFrame, chain_id: str, columns: list[str], segment_size: int) -> DataFrame:
    """Records (chain, position, problem) of the given segments that differ, or that one side lacks. Only these segments are compared."""
    where = segments.select(F.col(chain_id).alias("_c"), F.col("segment").alias("_s"))

    def side(stored: DataFrame, name: str) -> DataFrame:
        segment = F.floor((F.col("position") - 1) / segment_size).cast("bigint")
        rows = stored.select(chain_id, "position", ledger.payload(stored, chain_id, columns).alias("_payload"), segment.alias("_in"))
        near = rows.join(where, F.col(chain_id).eqNullSafe(F.col("_c")) & (F.col("_in") == F.col("_s")), "left_semi")
        return near.select(chain_id, "position", F.sha2("_payload", 256).alias(name))

    met = side(ours, "a").unionByName(side(theirs, "b"), allowMissingColumns=True).groupBy(chain_id, "position").agg(
        F.max("a").alias("a"), F.max("b").alias("b"))
    problem = F.when(F.col("b").isNull(), "only_ours").when(F.col("a").isNull(), "only_theirs").when(F.col("a") != F.col("b"), "changed")
    return met.select(chain_id, "position", problem.alias("problem")).filter("problem is not null")
