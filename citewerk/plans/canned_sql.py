"""Ready-made questions over the three tables, and free SQL.

Free SQL sees every project; it is a tool for developers, not for project users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewerk.sources.tables import register_views


def run_sql(spark: SparkSession, tables_dir: str, text: str, **parameters: object) -> DataFrame:
    """Any Spark SQL over views `documents`, `segments` and `chunks`.

    Values go in as named parameters (`:name`), never into the text.
    """
    register_views(spark, tables_dir)
    return spark.sql(text, args=parameters or None)


def labelled_value(text: Column, label: str) -> Column:
    """Value of a `label: value` line, empty where the text has no such line."""
    return F.regexp_extract(text, f"{label}: ([^\\n]*)", 1)


def inventory(documents: DataFrame) -> DataFrame:
    return (
        documents.groupBy("project_id", "doc_type")
        .agg(F.count("*").alias("documents"))
        .orderBy(F.asc_nulls_last("project_id"), F.asc_nulls_last("doc_type"))
    )


def open_items(
    chunks: DataFrame, project_id: str, topic: str, signs: tuple[str, ...]
) -> DataFrame:
    """Chunks on a topic that carry a sign of being unsettled, newest first."""
    text = F.lower("text")
    unsettled = F.lit(False)
    for sign in signs:
        unsettled = unsettled | F.contains(text, F.lit(sign))
    return (
        chunks.where((F.col("project_id") == project_id) & F.contains(text, F.lit(topic)) & unsettled)
        .select("file_name", "locator", "document_date", F.substring("text", 1, 120).alias("excerpt"))
        .orderBy(F.desc_nulls_last("document_date"))
    )


def topic_over_time(chunks: DataFrame, project_id: str, term: str) -> DataFrame:
    return (
        chunks.where((F.col("project_id") == project_id) & F.contains("text", F.lit(term)))
        .select("document_date", "file_name", "locator", F.substring("text", 1, 160).alias("excerpt"))
        .orderBy(F.asc_nulls_first("document_date"))
    )


def responsibilities(chunks: DataFrame, project_id: str, doc_type: str = "protokoll") -> DataFrame:
    return (
        chunks.where((F.col("project_id") == project_id) & (F.col("doc_type") == doc_type))
        .select(
            "document_date",
            "locator",
            labelled_value(F.col("text"), "Thema").alias("topic"),
            labelled_value(F.col("text"), "Verantwortlich").alias("owner"),
        )
        .orderBy(F.asc_nulls_last("document_date"), F.asc_nulls_last("locator"))
    )


def without_owner(
    chunks: DataFrame,
    project_id: str,
    unclear: tuple[str, ...] = ("offen", "ungeklärt", "nicht benannt"),
) -> DataFrame:
    return (
        chunks.where(
            (F.col("project_id") == project_id)
            & labelled_value(F.col("text"), "Verantwortlich").isin(*unclear)
        )
        .select(
            "document_date",
            "file_name",
            "locator",
            labelled_value(F.col("text"), "Thema").alias("topic"),
        )
        .orderBy(F.asc_nulls_last("document_date"))
    )


def amounts(chunks: DataFrame, project_id: str) -> DataFrame:
    return (
        chunks.where((F.col("project_id") == project_id) & F.contains("text", F.lit("EUR")))
        .select(
            "file_name",
            "locator",
            F.regexp_extract("text", "([0-9][0-9.]*) EUR", 1).alias("amount"),
        )
        .distinct()
        .orderBy(F.asc_nulls_last("file_name"), F.asc_nulls_last("locator"))
    )


def leaked_terms(chunks: DataFrame, project_id: str, foreign: tuple[str, ...]) -> DataFrame:
    """Chunks of a project that name another project's terms; must be empty."""
    leaked = F.lit(False)
    for term in foreign:
        leaked = leaked | F.contains("text", F.lit(term))
    return chunks.where((F.col("project_id") == project_id) & leaked).select(
        "project_id", "file_name"
    )


def length_distribution(chunks: DataFrame) -> DataFrame:
    """Count, shortest, rounded median and longest chunk per kind of document.

    Lengths are counted before the median is taken, so its state is the set of distinct
    lengths, not the rows of a kind.
    """
    counted = (
        chunks.select("doc_type", F.length("text").cast("bigint").alias("n"))
        .groupBy("doc_type", "n")
        .agg(F.count("*").alias("rows"))
    )
    return (
        counted.groupBy("doc_type")
        .agg(
            F.sum("rows").alias("chunks"),
            F.min("n").alias("shortest"),
            F.round(F.percentile("n", F.lit(0.5), F.col("rows"))).alias("median"),
            F.max("n").alias("longest"),
        )
        .orderBy(F.asc_nulls_last("doc_type"))
    )


def document_versions(documents: DataFrame) -> DataFrame:
    """Paths with more than one version and when the last one came in."""
    return (
        documents.groupBy("source_path")
        .agg(F.count("*").alias("versions"), F.max("ingested_at").alias("latest"))
        .where(F.col("versions") > 1)
    )


def segments_in_context(
    segments: DataFrame, documents: DataFrame, project_id: str, term: str
) -> DataFrame:
    return (
        segments.where((F.col("project_id") == project_id) & F.contains("text", F.lit(term)))
        .join(documents.select("document_id", "file_name"), "document_id")
        .select("file_name", "locator", "heading", F.substring("text", 1, 200).alias("excerpt"))
    )
