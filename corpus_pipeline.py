"""Documents to training tokens, stage by stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
as parquet and read again as the next stage's ``docs``.  All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from couponlab.llm import byte_bpe, quality, secret_scan, simhash, winnowing
from couponlab.llm.tables import fresh_path, settled, written  # noqa: F401
from couponlab.session import remove

VOCABULARY = "byte_bpe_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, does not reject."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window of words with a benchmark item."""
    return winnowing.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts and their lengths brought up to date."""
    masked = secret_scan.redacted(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed, with their number and whether they decode to the text."""
    made = byte_bpe.tokens(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return made.select("doc_id", "lang", "source", "n_tokens", "lossless", "ids")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", as_tokens),
]

# The classifier and the fingerprints cannot be told in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.  A stage's tables go when its result is written, that one when the next is."""
    docs, behind = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"stage-{name}")
        docs = settled(spark, f"stage-{name}", lambda: stage(spark, docs, sf_dir), path)
        if behind:
            remove(spark, behind)
        behind = path
    return STAGES[-1][1](spark, docs, sf_dir)
