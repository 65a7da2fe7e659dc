"""A corpus pipeline: language ID, line dedup, near-dedup, source mixing, encoding; each stage written and read again."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajekt.llm import language_id, line_dedup, minhash_dedup, mixing, sentencepiece_codec
from trajekt.llm.common import packed, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay, and get it as lang; letterless and undecided ones go.

    The dictionaries come from the documents that carry a language.
    """
    model = language_id.train(docs, F.lit(True))
    found = language_id.identify(docs.select(*COLUMNS), model, min_margin=0.002).where("lang_accepted")
    return packed(found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more that 5 documents hold stay in one of them; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS), min_chars=40, min_docs=5)
    return packed(out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (five words, similarity 0.8 or more) the document of the least id stays."""
    out = minhash_dedup.near_duplicates(docs, words=5, threshold=(80, 100))
    gone = written(out.where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "pipeline-gone")
    return packed(docs.select(*COLUMNS).join(gone, F.col("doc_id") == F.col("gone"), "left_anti"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to the weights 5, 2, 1 within 3 epochs: documents repeat, are cut at the end of the quota, or go."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS), weights=(5, 2, 1), max_epochs=3)
    return packed(mixing.repeated(mixed).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text, and whether they decode to it."""
    out = sentencepiece_codec.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return packed(out.select("doc_id", "lang", "source", F.size("piece_ids").alias("n_pieces"), "piece_ids", "round_trip"))


STAGES = [
    ("language_id", keep_identified),
    ("line_dedup", drop_common_lines),
    ("minhash_dedup", one_of_each_group),
    ("source_mix", mix),
    ("sentencepiece", encode),
]

# The last stage and the first have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each but the last written as Parquet in the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
