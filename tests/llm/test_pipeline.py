import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.odd import clashing, no_docs, odd_docs, prose, words
from turnstile.llm import common
from turnstile.llm.queries import ORACLE, QUERIES

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        docs = common.store(stage(spark, docs, sf_dir), name)
        yield name, docs


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n.split("_")[0][2:]))] == [f"op{i}" for i in range(1, 11)]
    found = entry.queries()
    assert set(QUERIES) | {"pipeline"} <= set(found) and set(ORACLE) <= set(entry.oracle_sql())


def test_each_stage_takes_effect(spark, sf_dir):
    before = common.read_table(common.prepare(spark), sf_dir, "documents")
    seen = {}
    for name, docs in stages(spark, before, sf_dir):
        seen[name] = docs
        if name != "sentence_pieces":
            assert docs.columns == COLUMNS and docs.where("n_chars <> length(text)").count() == 0
    labels = common.read_table(spark, sf_dir, "labels")
    toxic = labels.where("toxic = 1 AND quality = 1").select("doc_id")
    assert seen["toxicity"].join(toxic, "doc_id").count() <= 0.4 * before.join(toxic, "doc_id").count()
    clean = labels.where("toxic = 0 AND quality = 1").select("doc_id")
    assert seen["toxicity"].join(clean, "doc_id").count() >= 0.9 * before.join(clean, "doc_id").count()
    assert seen["near_duplicates"].select("text").distinct().count() == seen["near_duplicates"].count() < seen["toxicity"].count()
    total = lambda df: sum(len(words(r.text)) for r in df.select("text").collect())
    assert seen["substring_dedup"].count() == seen["near_duplicates"].count()
    kept = total(seen["substring_dedup"])
    assert kept < total(seen["near_duplicates"])
    assert abs(total(seen["source_mix"]) - 1.5 * kept) <= 0.05 * kept
    last = seen["sentence_pieces"]
    assert last.count() == seen["source_mix"].count() and last.where("not lossless OR n_pieces = 0").count() == 0


def test_odd_rows_pass_every_stage(spark, sf_dir):
    docs = clashing(odd_docs(common.prepare(spark)), "score", "n_words", "size", "k", "_id", "ids", "taken")
    for name, out in stages(spark, docs, sf_dir):
        if name != "sentence_pieces":
            assert out.columns == docs.columns
            assert out.where(F.col("size") != "mine").count() == 0
        else:
            assert out.where("not lossless").count() == 0


def test_one_copy_of_a_repeated_row_reaches_the_last_stage(spark, sf_dir):
    rng = random.Random(9)
    a, b = (" ".join(prose(rng, 60, 10_000)) for _ in range(2))
    rows = [(10**9, a, "en", "a", len(a))] * 2 + [(10**9 + 1, a, "en", "a", len(a))] + [(None, b, "en", "a", len(b))] * 2
    docs = common.prepare(spark).createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    seen = dict(stages(spark, docs, sf_dir))
    assert sorted((r.doc_id or 0) for r in seen["near_duplicates"].collect()) == [0, 10**9]
    assert {r.text for r in seen["substring_dedup"].collect()} == {a, b}
    assert {r.doc_id for r in seen["sentence_pieces"].collect()} == {None, 10**9}


def test_substring_dedup_keeps_the_breaks_of_whole_texts(spark):
    text = "One line.\n\n\tAnother  line. "
    docs = spark.createDataFrame([(1, text, len(text))], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in corpus_pipeline.substring_dedup(spark, docs, "").collect()] == [(1, text, len(text))]


def test_empty_labels_keep_all_documents(spark, tmp_path):
    docs = odd_docs(common.prepare(spark))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count()


def test_no_rows(spark, sf_dir):
    for _, out in stages(spark, no_docs(common.prepare(spark)), sf_dir):
        assert out.count() == 0
