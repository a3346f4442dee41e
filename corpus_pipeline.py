"""From raw documents to packed training sequences: toxic texts, near copies and repeated passages go.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm import jaccard_groups, packing, repeats, toxicity
from attest.llm.common import BATCH_BYTES, written
from attest.session import configure as configure_library

TOXIC_SCORE = 0.5
NEAR_WORDS = 5
NEAR_PERCENT = 80
REPEATED_BYTES = 100
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 1

#: SQL has no tokenizer, no learned lexicon and no byte strings of this size; tests/llm compares with brute force.
ORACLE_SQL = None


def configure(spark: SparkSession) -> None:
    """The library's settings, and small Arrow batches: a stage's texts are read by its caller, beside what earlier stages left in the workers."""
    configure_library(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _closed(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns numbered in a struct `row`, so that no name can clash with a stage's own."""
    others = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("held"), *others).alias("row"))


def _opened(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of `docs` again."""
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC_SCORE by the lexicon learned from the labels of the corpus.

    Null and empty texts are clean. Repeated rows score alike and stay or go together; an empty table gives no rows.
    """
    configure(spark)
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(_closed(docs), lexicon)
    return _opened(scored.filter(F.col(toxicity.SCORE) < TOXIC_SCORE), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near copies.

    Rows of one doc_id are one document here and stay or go together; rows without doc_id stay. Null and empty
    texts are in no group; an empty table gives no rows.
    """
    configure(spark)
    joined = jaccard_groups.join_similar(docs, NEAR_WORDS, NEAR_PERCENT)
    kept = joined.filter("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = _closed(docs)
    named = rows.filter("doc_id is not null").join(kept, F.col("doc_id") == F.col("kept_id"), "left_semi")
    return _opened(named.unionByName(rows.filter("doc_id is null")), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes that an earlier one holds; those of which nothing is left go.

    Bytes of a character that is cut through go with it. n_chars, if there is one, counts what is left. Null and
    empty texts stay as they are; an empty table gives no rows.
    """
    configure(spark)
    rows = _closed(docs).withColumn("had_text", F.col("text").isNotNull())
    cut = repeats.remove_repeats(rows, REPEATED_BYTES, carry=("row", "had_text"))
    cut = cut.filter("n_bytes = 0 or octet_length(kept) > 0")
    cut = _opened(cut.select("doc_id", F.when(F.col("carried.had_text"), F.col("kept_text")).alias("text"), F.col("carried.row").alias("row")), docs)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast("long"))
    return cut.select(*[F.col(f"`{c}`").cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 ids.

    A null or empty text is its end id alone; repeated rows are packed each; an empty table gives no rows.
    """
    configure(spark)
    return packing.pack(docs, TOKENIZER, END_ID, keep_words=False).withColumn("length", F.expr("cast(octet_length(ids) div 4 as long)"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
