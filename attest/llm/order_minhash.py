"""Order MinHash fingerprints of documents, with DataFrame operations alone.

A text's k-mers are runs of `k` words, numbered by occurrence, so that a repeated run counts as often as it stands.
Under each of `permutations` hash orders the two least k-mers are taken, put back into the order of the text, and
hashed as a tuple. A fingerprint changes with the k-mers and with their order, as the edit distance does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attest.llm.common import written

K = 2
PERMUTATIONS = 32
LINE = 32
NULL_ID = -(1 << 63)
_HASH_BITS = 0x7FFFFFFF00000000  # a rank holds 31 bits of hash above 32 bits of position


def successors(ids: DataFrame) -> DataFrame:
    """doc, next: the next larger id of each, and the least after the largest; `ids` has a distinct column `doc`.

    Ids are range-partitioned and sorted; only the least and largest id of each partition meet.
    """
    placed = written(ids.repartitionByRange("doc").sortWithinPartitions("doc").withColumn("place", F.monotonically_increasing_id()), "ids")
    part = F.shiftright("place", 33)
    across = Window.orderBy("part")
    ends = placed.groupBy(part.alias("part")).agg(F.min("doc").alias("first"), F.max("place").alias("high"))
    ends = ends.select("high", F.lead("first").over(across).alias("beyond"))
    least = placed.agg(F.min("doc").alias("least"))
    following = placed.select((F.col("place") - 1).alias("place"), F.col("doc").alias("next"))
    return placed.join(following, "place", "left").join(F.broadcast(ends), F.col("place") == F.col("high"), "left").join(
        F.broadcast(least)).select("doc", F.coalesce("next", "beyond", "least").alias("next"))


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text", k: int = K, permutations: int = PERMUTATIONS,
                 carried: tuple[str, ...] = ()) -> DataFrame:
    """The fingerprint of each text as an array of integers: the key columns, `fingerprint`, and `carried` columns.

    The keys tell the rows of `texts` apart. If the rows are already partitioned by some of the keys, nothing is
    shuffled. A text of fewer than `k` words has k-mers that start before it; a null text has no fingerprint.
    """
    # The words are a column of their own, or each k-mer would split the text again.
    split = texts.select(*keys, *carried, F.split(text, r"\s+").alias("words"))
    rows = split.select(*keys, *carried, "words", F.posexplode("words").alias("at", "word"))
    run = F.xxhash64(*[F.get("words", F.col("at") - j) for j in range(1, k)], "word")
    rows = rows.select(*keys, *[F.when(F.col("at") == 0, F.col(c)).alias(c) for c in carried], "at", run.alias("run"))
    occurrence = F.row_number().over(Window.partitionBy(*keys, "run").orderBy("at"))
    rows = rows.withColumn("run", F.xxhash64("run", occurrence))
    # Places in a grid of LINE columns: any two lie in different lines or in different columns, so the two least
    # ranks of a text are each the least of some line or column, and only these least ones are compared.
    lines = F.explode(F.array(F.expr(f"at div {LINE}"), F.expr(f"-1L - at % {LINE}")))
    rows = rows.select(*keys, *carried, "at", "run", lines.alias("line"))
    ranks = [F.xxhash64("run", F.lit(i)).bitwiseAND(F.lit(_HASH_BITS)).bitwiseOR(F.col("at").cast("long")) for i in range(permutations)]
    ranked = rows.groupBy(*keys, *carried, "line").agg(*[F.min(r).alias(f"r{i}") for i, r in enumerate(ranks)])
    whole = Window.partitionBy(*keys)
    least = ranked.select(*keys, *carried, *[f"r{i}" for i in range(permutations)], *[F.min(f"r{i}").over(whole).alias(f"m{i}") for i in range(permutations)])
    two = least.groupBy(*keys).agg(
        *[F.max(c).alias(c) for c in carried],
        *[F.min(f"m{i}").alias(f"m{i}") for i in range(permutations)],
        *[F.min(F.when(F.col(f"r{i}") > F.col(f"m{i}"), F.col(f"r{i}"))).alias(f"s{i}") for i in range(permutations)])

    def tuple_hash(i: int) -> Column:
        one, two = F.col(f"m{i}"), F.col(f"s{i}")
        place = F.lit(0xFFFFFFFF)
        first = F.when(one.bitwiseAND(place) < two.bitwiseAND(place), one).otherwise(two)
        second = F.when(one.bitwiseAND(place) < two.bitwiseAND(place), two).otherwise(one)
        return F.hash(F.shiftright(first, 32), F.shiftright(second, 32))

    return two.select(*keys, *carried, F.array(*[tuple_hash(i) for i in range(permutations)]).alias("fingerprint"))


def likeness(one: Column, two: Column) -> Column:
    """The share of equal tuples, 0 to 1."""
    return F.size(F.filter(F.zip_with(one, two, lambda a, b: a == b), lambda same: same)) / F.size(one)


def as_text(fingerprint: Column) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), ""))


def compare_edited(documents: DataFrame, k: int = K, permutations: int = PERMUTATIONS) -> DataFrame:
    """Fingerprints of every text, of its edited text, and how alike they and the next document's are.

    The edited text has its last half, floor(n_chars / 2) code points, replaced by as many first code points of
    the next document by doc_id (after the last, the first). A null doc_id is the least id; of several rows of one
    doc_id the least text is put into the text before it, and the shortest is compared with it. Null texts are empty. Each row has a result, repeated
    rows too; an empty table gives no rows. Reads `doc_id` and `text` only, so other columns cannot clash.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (arrays), near_edited, near_next.
    """
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    needs = docs.groupBy("doc").agg(F.max(half).alias("need"))
    following = written(successors(needs.select("doc")).join(needs, "doc"), "successors")
    # Only the code points that the document before needs are sent on.
    wanted = following.select(F.col("next").alias("doc"), F.col("doc").alias("before"), "need")
    heads = docs.join(wanted, "doc").select(F.col("before").alias("doc"), F.expr("substring(text, 1, need)").alias("head"))
    heads = heads.groupBy("doc").agg(F.min("head").alias("head"))
    both = docs.join(heads, "doc").withColumn("half", half).withColumn(
        "edited", F.expr("concat(substring(text, 1, length(text) - half), substring(head, 1, half))")).withColumn(
        "number", 2 * F.monotonically_increasing_id())
    pair = F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text")))
    texts = both.select("doc", "number", F.inline(pair)).select(
        "doc", "number", "kind", "text", F.when(F.col("kind") == 0, F.length("text")).cast("long").alias("n_chars"),
        F.when(F.col("kind") == 1, F.sha2("text", 256)).alias("edited_sha256"))
    made = fingerprints(texts, ["doc", "number", "kind"], "text", k, permutations, ("n_chars", "edited_sha256"))
    own, edited = F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))), F.max(F.when(F.col("kind") == 1, F.col("fingerprint")))
    made = made.groupBy("doc", "number").agg(
        F.max("n_chars").alias("n_chars"), F.max("edited_sha256").alias("edited_sha256"), own.alias("fingerprint"), edited.alias("edited_fingerprint"))
    # Splitting the join of texts would send every k-mer through a shuffle; ids are distinct, so it has no hot key.
    spark, setting = documents.sparkSession, "spark.sql.adaptive.forceOptimizeSkewedJoin"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        made = written(made, "fingerprints")
    finally:
        spark.conf.set(setting, before)
    least = made.groupBy("doc").agg(F.min(F.struct("n_chars", "fingerprint")).alias("least"))
    nexts = least.select(F.col("doc").alias("next"), F.col("least.fingerprint").alias("next_fingerprint"))
    joined = made.join(following.select("doc", "next"), "doc").join(nexts, "next")
    return joined.select(
        F.nullif("doc", F.lit(NULL_ID)).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
