"""Corpus pipeline: quality rules, exact and near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read
again as the next one's documents.  Stages work on all rows that their predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import exact_dedup, ngram_join, packing, quality, secrets
from codeloom.session import stored

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Word shingles and least similarity in percent of near duplicates.
SHINGLE_WORDS, SIMILARITY = 5, 80


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio accept."""
    trusted = quality.trusted_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs.select(*COLUMNS), trusted).where("quality.kept").select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, white space aside: that of the smallest id."""
    return exact_dedup.keep_first(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of similarity connect: that of the smallest id."""
    return ngram_join.keep_first(docs.select(*COLUMNS), SIMILARITY, SHINGLE_WORDS)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; their secrets are masked in the text, whose length is counted anew."""
    masked = secrets.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids (little-endian 32-bit integers) and their places in sequences of 2048."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(docs, path, public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("secret_scan", remove_secrets),
    ("packing", pack),
]

#: Entropy windows, merges and packing have no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
