"""Toxicity, the pipeline, and the registered queries."""

import __spark_entry__ as entry_points
import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from attest.llm import common, packing, toxicity
from attest.llm.common import written
from attest.llm.queries import QUERIES
from attest.llm.tokenized import TextEncoder

OPERATORS = range(1, 14)


def test_every_operator_is_registered_once():
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(OPERATORS)
    assert set(names) == set(QUERIES) and entry_points.queries()["pipeline"] is corpus_pipeline.run


def test_folding():
    fold = toxicity._Fold()
    assert toxicity.folded_words("You ID10T! pаthetiс* l0$er, 2024 naïve st-upid", fold) == ["you", "idiot", "pathetic", "loser", "naive", "st", "upid"]


def test_signs_at_the_start_of_a_word():
    fold = toxicity._Fold()
    text = '$tupid "@sshole!" (!diot) $$hole @55 |oser! costs $100, $5. or !? $ ok@ "@"'
    assert toxicity.folded_words(text, fold) == ["stupid", "asshole", "idiot", "sshole", "ass", "loser", "costs", "or", "ok"]
    automaton = toxicity.Lexicon({" stup": 3.0, " ass": 3.0, " clown ": 3.0}, frozenset()).automaton()
    plain = toxicity.measures("you stupid", fold, automaton)
    assert plain[0] > 0
    for word in ("$tupid", "@ss", "@clown", "|clown|", "!clown!", "($tupid)"):
        assert toxicity.measures(f"you {word}", fold, automaton) == plain
    assert toxicity.measures("you @home $100", fold, automaton) == (0.0, 0.0)


def labelled(spark):
    filler = ["quiet river over stones", "the meeting starts at noon", "rain falls on green hills", "my sister plays chess", "bring the blue folder"]
    rows = []
    for i in range(200):
        toxic = i % 4 == 0
        text = f"{filler[i % 5]} {filler[(i // 5) % 5]}" + (f" {['idiot', 'clown', 'l0ser'][i % 3]}" if toxic else " a clown fish" if i % 25 == 1 else "")
        rows.append((i, text, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_learned_lexicon(spark, odd_documents):
    table = labelled(spark)
    lexicon = toxicity.learn(table.drop("toxic"), table.drop("text"), least_texts=3)
    scored = {r.doc_id: r for r in toxicity.score(table, lexicon).collect()}
    assert all((r.toxicity_score >= 0.5) == bool(r.toxic) for r in scored.values())
    assert any("clown fish" in phrase for phrase in lexicon.exceptions)
    odd = toxicity.score(odd_documents, lexicon).collect()
    assert len(odd) == odd_documents.count() and all(0 <= r.toxicity_score < 0.5 for r in odd)
    none = toxicity.learn(odd_documents, spark.createDataFrame([(1, None), (None, 1), (2, 7)], "doc_id long, toxic int"))
    assert not none.weights and toxicity.score(odd_documents.limit(0), none).count() == 0


def test_stages_keep_columns_and_take_effect(spark, odd_documents, tmp_path):
    folder = str(tmp_path)
    table = labelled(spark)
    shared = " ".join(f"passage{i}" for i in range(40))
    more = spark.createDataFrame([(2001, f"{' '.join(f'a{i}' for i in range(60))} {shared}"), (2002, f"{' '.join(f'b{i}' for i in range(60))} {shared}")], "doc_id long, text string")
    docs = table.select("doc_id", "text").unionByName(more).unionByName(odd_documents.filter("doc_id is null or doc_id > 9").withColumn(
        "doc_id", odd_documents.doc_id + 1000).drop("vertex", "key", "toxicity_score"), allowMissingColumns=True)
    docs.write.parquet(f"{folder}/documents.parquet")
    table.select("doc_id", "toxic").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    toxic = {r.doc_id for r in table.filter("toxic = 1").collect()}
    clean = corpus_pipeline.drop_toxic(spark, docs, folder)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - toxic
    single = corpus_pipeline.drop_near_copies(spark, clean, folder)
    texts = [r.text for r in single.collect()]
    assert single.columns == docs.columns and len(texts) == len(set(texts)) and None not in texts
    gone = {r.text for r in clean.collect()} - set(texts)
    assert [t[:11] for t in gone] == ["other start"]  # a near copy of "one two three"
    cut = corpus_pipeline.cut_repeats(spark, single, folder)
    assert cut.dtypes == docs.dtypes and all(r.n_chars == len(r.text) for r in cut.collect())
    both = {r.doc_id: r.text for r in cut.collect()}
    assert "passage20" in both[1010] and "passage20" not in both[2001] + both[2002] and "a59" in both[2001]
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.collect()} == set(both)


def test_stages_keep_columns_whose_names_clash(spark, tmp_path):
    names = ("toxicity_score", "kept_id", "had_text", "row", "carried", "a.b")
    table = labelled(spark)
    odd = spark.createDataFrame([(900, None), (901, ""), (None, None), (None, "no id"), (5, "a second row of one id")], "doc_id long, text string")
    docs = table.select("doc_id", "text").unionByName(odd)
    docs = docs.select("*", *[F.concat(F.lit(f"{n}:"), F.coalesce("doc_id", F.lit(-1))).alias(n) for n in names], F.length("text").cast("long").alias("n_chars"))
    table.select("doc_id", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, str(tmp_path)), name)
        assert kept.dtypes == docs.dtypes
        for r in kept.collect():
            assert [r[n] for n in names] == [f"{n}:{-1 if r.doc_id is None else r.doc_id}" for n in names]
    left = kept.collect()
    assert {r.doc_id for r in left} >= {900, 901, None} and any(r.text is None for r in left)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_stages_get_small_batches_and_leave_no_words_behind(spark, tmp_path):
    spark.range(4000).selectExpr("id as doc_id", "repeat(concat('some words ', id, ' '), 150) as text").repartition(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["doc_id"])

    def largest():
        return max(r.doc_id for r in docs.mapInArrow(sizes, "doc_id long").collect())

    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, 64 << 20)
        assert largest() > 2 * common.BATCH_BYTES
        with common.small_batches(spark):
            assert largest() <= 1.1 * common.BATCH_BYTES
        assert int(spark.conf.get(setting)) == 64 << 20
        kept = {r.doc_id: r.length for r in corpus_pipeline.pack_sequences(spark, docs.limit(50), str(tmp_path)).collect()}
        assert largest() <= 1.1 * common.BATCH_BYTES and len(kept) == 50
        plain = packing.pack(docs.limit(50), corpus_pipeline.TOKENIZER, corpus_pipeline.END_ID)
        assert kept == {r.doc_id: len(r.ids) // 4 for r in plain.collect()}
    finally:
        spark.conf.set(setting, before)


def test_encoded_words_are_kept_packed():
    encoder = TextEncoder(corpus_pipeline.TOKENIZER, 1, False)
    encoder(pa.array(["some words, some more words"]))
    assert encoder._merged and all(isinstance(ids, bytes) for ids in encoder._merged.values())
