"""The corpus pipeline: documents through five operators of turnstile.llm, each stage written and reread.

Nulls: a NULL text is not toxic, near to nothing, repeats nothing and takes no part in the mix (no words).
Rows without an id are handled as their stage's operator says. An empty table gives an empty result; columns
besides those of documents pass through up to the last stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnstile.llm import mixing, near_duplicates, repeats, sentence_pieces, toxicity
from turnstile.llm.common import prepare, read_table, store
from turnstile.llm.queries import held_out, tokenizer_file


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted anew."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*columns)


def _carried(docs: DataFrame) -> DataFrame:
    """The text, and all other columns as one, whatever their names."""
    return docs.select("text", F.struct(*[c for c in docs.columns if c != "text"]).alias("_row"))


def _restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("_row")[c].alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels that are not held out."""
    prepare(spark)
    labels = read_table(spark, sf_dir, "labels").where(~held_out())
    judged = toxicity.judge(_carried(docs), toxicity.train(docs.select("doc_id", "text"), labels))
    return _restored(judged.where("predicted = 0"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, with the smallest id, stays; repeated rows are near copies."""
    prepare(spark)
    return near_duplicates.keep_one_row(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose the words that a repeated window of 35 words covers; the others stay as they are, no document goes."""
    prepare(spark)
    return _with_length(_restored(repeats.remove_repeats(_carried(docs), as_is=True), docs.columns), docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts hold the words that the mix takes; a document of which some are taken twice comes twice."""
    prepare(spark)
    return _with_length(mixing.mixed_documents(docs), docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    prepare(spark)
    model = tokenizer_file("piece_bpe_32k.model")
    out = sentence_pieces.encode(docs, model, back=True)
    lossless = F.col("decoded") == F.coalesce("text", F.lit(""))
    return out.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_pieces"), "score", "ids", "ids_crc32", lossless.alias("lossless"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", mix_sources),
    ("sentence_pieces", encode_pieces),
]

# SQL expresses neither the toxicity model nor the hashes that order the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
