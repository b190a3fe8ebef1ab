"""Segments to chunks: the unit that is embedded, searched and cited."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citewerk.functions.chunking import text_spans
from citewerk.functions.ids import derive_id
from citewerk.schemas import CHUNK_COLUMNS
from citewerk.settings import CHUNK_MAX_CHARS, CHUNK_OVERLAP_CHARS
from citewerk.sources.tables import settled

# Rows per block of the two-level running count.
BLOCK = 256


def explode_chunks(documents: DataFrame) -> DataFrame:
    """Rows of the chunks table from documents with `segments` and `spans`.

    The whole document is one row, so provenance is inherited and the document-wide
    index is the position in the exploded array: no join, no shuffle. The place of its
    segment is put into each span first, so that no row carries the segments along.
    """

    def placed(span: Column) -> Column:
        segment = F.get("segments", span["segment"])
        return F.struct(
            *[span[c].alias(c) for c in ("segment", "text", "char_start", "char_end")],
            *[segment[c].alias(c) for c in ("page_no", "locator", "heading")],
        )

    inherited = [
        "document_id", "project_id", "source_path", "file_name", "doc_type", "document_date",
    ]
    return (
        documents.select(*inherited, F.transform("spans", placed).alias("spans"))
        .select(*inherited, F.posexplode("spans").alias("index", "span"))
        .withColumn("segment_id", derive_id(F.col("document_id"), F.col("span.segment")))
        .withColumn("chunk_id", derive_id(F.col("segment_id"), F.col("index")))
        .select(*inherited, "index", "segment_id", "chunk_id", "span.*")
        .select(*CHUNK_COLUMNS)
    )


def running_offset(rows: DataFrame, key: str, position: str, amount: str) -> DataFrame:
    """Add `offset`: the sum of `amount` over all earlier positions of the same key.

    Positions are dense from 0. Rows are summed in blocks first, so even a key that
    holds a large share of all rows is split over many tasks: the wide rows are
    windowed per (key, block) and only block totals are windowed per key.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(position) / BLOCK))
    within = Window.partitionBy(key, "_block").orderBy(position)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        blocked.groupBy(key, "_block")
        .agg(F.sum(amount).alias("_total"))
        .select(key, "_block", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    )
    return (
        blocked.withColumn("_within", F.coalesce(F.sum(amount).over(before), F.lit(0)))
        .join(totals, [key, "_block"])
        .withColumn("offset", (F.col("_base") + F.col("_within")).cast("int"))
        .drop("_block", "_within", "_base")
    )


def rechunk(
    segments: DataFrame,
    documents: DataFrame,
    max_chars: int = CHUNK_MAX_CHARS,
    overlap: int = CHUNK_OVERLAP_CHARS,
) -> DataFrame:
    """Chunks from the stored segments, without opening the originals again."""
    cut = text_spans(F.col("text"), F.col("kind"), max_chars, overlap)
    spans = settled(segments.withColumn("_spans", cut).drop("text"))
    spans = spans.withColumn("_count", F.size("_spans"))
    provenance = documents.select(
        "document_id", "source_path", "file_name", "doc_type", "document_date"
    )
    return (
        running_offset(spans, "document_id", "index", "_count")
        .drop("index")
        .select("*", F.posexplode("_spans").alias("_position", "_span"))
        .withColumn("index", F.col("offset") + F.col("_position"))
        .withColumn("chunk_id", derive_id(F.col("segment_id"), F.col("index")))
        .withColumn("text", F.col("_span.text"))
        .withColumn("char_start", F.col("_span.char_start"))
        .withColumn("char_end", F.col("_span.char_end"))
        .join(provenance, "document_id")
        .select(*CHUNK_COLUMNS)
    )
