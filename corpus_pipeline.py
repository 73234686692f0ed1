"""A training corpus from the documents table: five stages, each on what the one before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, lines, mixing, simhash, toxicity
from tidemark.llm.rows import position
from tidemark.session import fresh_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labelled ones, doesn't reject."""
    scored = toxicity.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = scored.where(F.col("toxic_score") < 0.5)
    return kept.drop("toxic_score", "passages").toDF(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others repeat; n_chars follows the text."""
    cut = lines.apply_bitmaps(docs, lines.keep_bitmaps(docs))
    at_text, at_size = position(docs, "text"), position(docs, "n_chars")
    size = F.when(F.col("n_dropped") > 0, F.char_length(F.col(f"c{at_text}")).cast("long")).otherwise(F.col(f"c{at_size}"))
    columns = [size.alias(f"c{i}") if i == at_size else F.col(f"c{i}") for i in range(len(docs.columns))]
    return cut.select(*columns).toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest doc_id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, encoded and decoded again."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: The learned score and the encoding have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
