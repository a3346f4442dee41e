"""Registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm import byte_bpe, conversations, fill_middle, hyperplanes, jaccard_groups, order_minhash, packing, page_text, quality, repeats, token_files, toxicity, warc
from attest.session import configure

Plan = Callable[[SparkSession, str], DataFrame]

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Plan] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    def register(plan: Plan) -> Plan:
        QUERIES[plan.__name__] = plan
        if sql:
            SQL[plan.__name__] = sql
        return plan

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


@query()
def op1_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    encoded = byte_bpe.encode(table(spark, folder, "documents"), BYTE_RANKS, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, BYTE_RANKS).select(
        "doc_id", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query()
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(table(spark, folder, "documents"), BYTE_TOKENIZER, end_id=1)
    return pieces.select(
        "doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op9_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = token_files.write_token_files(table(spark, folder, "documents"), WORD_TOKENIZER, end_id=2)
    return token_files.read_token_files(files).select(
        "doc_id", "start", F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"))


@query()
def op3_page_text(spark: SparkSession, folder: str) -> DataFrame:
    return page_text.main_text(table(spark, folder, "pages"))


@query(f"""
WITH payloads AS (
  SELECT CAST(page_id AS BIGINT) AS page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
    sha1(encode(coalesce(html, ''))) AS payload_digest FROM pages),
origins AS (
  SELECT *, CASE WHEN payload_bytes >= {warc.LEAST_REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS origin FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN origin IS NULL OR page_id IS NOT DISTINCT FROM origin THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM origin THEN origin END AS refers_to
FROM origins
""")
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.read_archives(warc.normalise(warc.write_archives(table(spark, folder, "pages"))))


@query()
def op7_hyperplanes(spark: SparkSession, folder: str) -> DataFrame:
    return hyperplanes.link(table(spark, folder, "embeddings"), threshold=0.9)


@query()
def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents"), length=100).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_groups.join_similar(table(spark, folder, "documents"), words=3, percent=90)


HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"


@query()
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(documents, table(spark, folder, "labels").filter(f"not ({HELD_OUT})"))
    scored = toxicity.score(documents, lexicon)
    return scored.select(
        "doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"), F.col(toxicity.SCORE).alias("score"),
        F.expr(f"if({toxicity.SCORE} >= 0.5, 1, 0)").alias("predicted"))


@query()
def op2_order_minhash(spark: SparkSession, folder: str) -> DataFrame:
    compared = order_minhash.compare_edited(table(spark, folder, "documents"))
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", order_minhash.as_text(F.col("fingerprint")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


QUALITY_HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


@query()
def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = quality.learn(documents, table(spark, folder, "labels").filter(f"not ({QUALITY_HELD_OUT})"))
    return quality.score(documents, model).select(
        "doc_id", F.coalesce(F.expr(QUALITY_HELD_OUT), F.lit(False)).alias("held_out"), F.col(quality.SCORE).alias("score"),
        F.expr(f"if({quality.SCORE} >= 0.7, 1, 0)").alias("predicted"))


@query()
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.repair(conversations.damage(table(spark, folder, "conversations")))


@query("""
WITH given AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT *, CAST(len(parts) - CASE WHEN text = '' OR text LIKE '%' || chr(10) THEN 1 ELSE 0 END AS BIGINT) AS n,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM given),
cuts AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM lines),
pieces AS (
  SELECT *, CASE WHEN a = 0 THEN '' WHEN a = n THEN text ELSE array_to_string(parts[1:a], chr(10)) || chr(10) END AS prefix,
    CASE WHEN b = 0 THEN '' WHEN b = n THEN text ELSE array_to_string(parts[1:b], chr(10)) || chr(10) END AS head FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(head) - length(prefix) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || text[length(head) + 1:] || '<M>' || head[length(prefix) + 1:]
    ELSE '<S>' || text[length(head) + 1:] || '<P>' || prefix || '<M>' || head[length(prefix) + 1:] END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM pieces
""")
def op13_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.restore(fill_middle.rearrange(table(spark, folder, "documents"), seed=7)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))
