"""The text operators as named queries over the tables of one data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import common as C

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(C.prepare(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.read_table(spark, sf_dir, "documents")


@query
def op4_minhash_near_dedup(spark, sf_dir):
    from turnstile.llm import near_duplicates

    return near_duplicates.components(documents(spark, sf_dir))


@query
def op2_substring_dedup(spark, sf_dir):
    from turnstile.llm import repeats

    kept = repeats.remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE["op2_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), p AS (
  SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d
), wins AS (
  SELECT r, i, array_to_string(w[i:i + 34], ' ') AS win
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 33, 1))) AS i FROM d)
), again AS (
  SELECT win FROM wins GROUP BY win HAVING count(*) > 1
), hit AS (
  SELECT r, i FROM wins SEMI JOIN again USING (win)
), marked AS (
  SELECT p.r, p.i, p.word,
    coalesce(max(h.i) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
  FROM p LEFT JOIN hit h ON h.r = p.r AND h.i = p.i
), s AS (
  SELECT r, count(*) AS n, count(*) FILTER (gone) AS x, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM marked GROUP BY r
)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_words, coalesce(s.x, 0)::BIGINT AS n_removed,
  sha256(coalesce(s.kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (r)
"""


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op3_token_files(spark, sf_dir):
    from turnstile.llm import token_files

    docs = documents(spark, sf_dir)
    folder = token_files.new_folder(spark)
    shards = token_files.write_tokens(docs, folder, tokenizer_file("word_bpe_49k.json"))
    return token_files.read_digests(shards, folder, dict(docs.dtypes)["doc_id"])


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


@query
def op10_toxicity(spark, sf_dir):
    from turnstile.llm import toxicity

    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = C.read_table(spark, sf_dir, "labels").where(~held_out())
    model = toxicity.train(docs, labels)
    return toxicity.judge(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query
def op5_source_mix(spark, sf_dir):
    from turnstile.llm import mixing

    docs = documents(spark, sf_dir)
    rows = mixing.sized(docs).select("doc_id", "_source", "_key", "size")
    return mixing.mix(C.store(rows, "sizes")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_sentence_pieces(spark, sf_dir):
    from turnstile.llm import sentence_pieces

    model = tokenizer_file("piece_bpe_32k.model")
    docs = documents(spark, sf_dir).select("doc_id", F.col("text"))
    out = sentence_pieces.encode(docs, model, back=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        "score",
        F.col("nbest.score").alias("nbest_scores"),
        "ids_crc32",
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("lossless"),
    )


@query
def op8_order_minhash(spark, sf_dir):
    from turnstile.llm import order_minhash

    return order_minhash.edit_report(documents(spark, sf_dir))


@query
def op9_quality_divergence(spark, sf_dir):
    from turnstile.llm import divergence

    return divergence.judge(documents(spark, sf_dir))


@query
def op6_url_filter(spark, sf_dir):
    from turnstile.llm import url_filter

    pages = C.read_table(spark, sf_dir, "pages").select("page_id", "url")
    # The number in a path is the page's document; a bad or toxic document labels its URL.
    number = F.regexp_extract("url", r"^[^?#]*?://[^/?#]*/[a-z]+/([0-9]{1,18})", 1)
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    labels = C.read_table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    pages = pages.withColumn("_doc", F.when(number != "", number.cast("long")))
    pages = pages.join(labels, F.col("_doc") == F.col("doc_id"), "left").select("page_id", "url", "bad")
    return url_filter.judge(pages, label_col="bad")


@query
def op1_kneser_ney_quality(spark, sf_dir):
    from turnstile.llm import kneser_ney

    return kneser_ney.classify(documents(spark, sf_dir), C.read_table(spark, sf_dir, "labels"))


@query
def op11_token_alignment(spark, sf_dir):
    from turnstile.llm import token_alignment

    return token_alignment.align(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")).documents


@query
def op12_turn_repair(spark, sf_dir):
    from turnstile.llm import turn_repair

    turns = C.read_table(spark, sf_dir, "conversations")
    return turn_repair.report(turn_repair.damaged(turns), turns)


@query
def op13_language_id(spark, sf_dir):
    from turnstile.llm import language_id

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    docs = documents(spark, sf_dir)
    model = language_id.train(docs.where(~held).select("text", "lang"))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
