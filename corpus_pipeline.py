"""Cleaning a corpus of documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewerk.llm import decontaminate, exact_dedup, jaccard_join, quality, sentencepiece_codec
from citewerk.llm.shared import fresh, id_bucket, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A document below this score goes.
QUALITY_THRESHOLD = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; it learns from the labels."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"), id_bucket(F.col("doc_id"), 5) != 0)
    (score,) = fresh(docs.columns, "score")
    scored = docs.withColumn(score, quality.score_column(docs, model))
    return scored.where(F.col(score) >= QUALITY_THRESHOLD).drop(score)


def no_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 over five-word shingles."""
    return jaccard_join.keep_one_each(docs, words=5, percent=80)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's text, checked by decoding them."""
    return sentencepiece_codec.encode_and_decode(docs, ["doc_id", "lang", "source"])


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("exact_dedup", no_exact_copies),
    ("near_dedup", no_near_copies),
    ("decontaminate", no_benchmark),
    ("encode", encoded),
]

#: A trained model decides in the first stage, so no SQL has run()'s rows; tests use brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result but the last is written as Parquet
    to shared storage and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
