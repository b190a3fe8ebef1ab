"""Ingest (originals to tables) and indexing (chunks to the retrieval index)."""

from __future__ import annotations

from collections.abc import Collection, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.functions.chunking import SPAN_TYPE, with_spans
from citewerk.functions.compounds import Parts
from citewerk.functions.ids import require_project_id
from citewerk.functions.text import nfc
from citewerk.functions.vectors import Encoder
from citewerk.operators.chunks import explode_chunks
from citewerk.operators import splitter
from citewerk.operators.index import index_rows, open_index, pending_ids, splitter_path, upsert
from citewerk.operators.segments import SEGMENT_STRUCT, explode_segments, segments_of
from citewerk.schemas import CHUNK_COLUMNS, DOCUMENTS
from citewerk.settings import (
    CHUNK_MAX_CHARS,
    CHUNK_OVERLAP_CHARS,
    EMBEDDING_BATCH,
    EMBEDDING_DIM,
)
from citewerk.sources import storage
from citewerk.sources.files import (
    date_from_segments,
    describe,
    discover,
    document_date,
    project_of,
)
from citewerk.sources.office import unpack
from citewerk.sources.tables import append_table, read_table, restrict


# Documents on their way into the tables: one row per file.
STAGED = T.StructType(
    [
        *DOCUMENTS.fields,
        T.StructField("segments", T.ArrayType(SEGMENT_STRUCT)),
        T.StructField("spans", SPAN_TYPE),
    ]
)


@dataclass(frozen=True)
class IngestResult:
    """What a run did. `rejected` holds the paths of files outside a valid project
    folder; it stays a DataFrame because their number is not bounded."""

    documents: int
    skipped: int
    segments: int
    chunks: int
    rejected: DataFrame

    def rejected_paths(self) -> Iterator[str]:
        return (row.path for row in self.rejected.orderBy("path").toLocalIterator())


@dataclass(frozen=True)
class IndexResult:
    embedded: int
    skipped: int


def identified(files: DataFrame) -> DataFrame:
    """Accepted files with their identity; reads each original once to hash it."""
    accepted = files.where(project_of(F.col("relative")).isNotNull())
    return describe(accepted.withColumn("content_hash", F.sha2("content", 256)))


def extracted(
    files: DataFrame,
    ingested_at: datetime,
    max_chars: int = CHUNK_MAX_CHARS,
    overlap: int = CHUNK_OVERLAP_CHARS,
) -> DataFrame:
    """documents columns plus the `segments` and `spans` arrays, one row per file, no shuffle."""
    stamp = F.lit(ingested_at.isoformat(sep=" ")).cast(T.TimestampNTZType())
    segmented = unpack(files).withColumn("segments", segments_of(F.col("items"))).drop("items")
    dated = document_date(F.col("file_name"), date_from_segments(F.col("segments")))
    return (
        with_spans(segmented, max_chars, overlap)
        .withColumn("document_date", dated)
        .withColumn("ingested_at", stamp)
        .select(*STAGED.fieldNames())
    )


def write_documents(spark: SparkSession, staged: DataFrame, tables_dir: str) -> tuple[int, int, int]:
    """Append staged documents: chunks, then segments, then documents as the commit mark.

    A document counts as known only once its documents row exists, so a run that dies
    half-way is repeated. The marker of the open run tells the repetition to leave out
    rows that did get written, by their key.
    """
    marker = f"{tables_dir}/_open_run"
    resumed = storage.exists(spark, marker)
    if not resumed:
        storage.mark(spark, marker)

    def append(rows: DataFrame, name: str, key: str) -> None:
        if resumed:
            rows = restrict(rows, read_table(spark, tables_dir, name), key, "left_anti")
        append_table(rows, tables_dir, name)

    append(explode_chunks(staged), "chunks", "chunk_id")
    append(explode_segments(staged), "segments", "segment_id")
    append(staged, "documents", "document_id")
    storage.remove(spark, marker)
    counts = staged.agg(
        F.count("*"),
        F.coalesce(F.sum(F.size("segments")), F.lit(0)),
        F.coalesce(F.sum(F.size("spans")), F.lit(0)),
    ).first()
    return tuple(counts)


def ingest_files(
    spark: SparkSession,
    files: DataFrame,
    tables_dir: str,
    now: datetime | None = None,
    project_id: str | None = None,
    max_chars: int = CHUNK_MAX_CHARS,
    overlap: int = CHUNK_OVERLAP_CHARS,
) -> IngestResult:
    """Read the unknown ones of the given files (rows of `discover`) into the tables.

    Identities are compared as narrow rows, and the contents of the pending files alone are
    read again. Contents stay where they are read on a first load and wherever the pending
    paths fit a broadcast.
    """
    stamp = now or datetime.now(UTC).replace(tzinfo=None)
    rejected = files.where(project_of(F.col("relative")).isNull()).select(
        nfc(F.col("relative")).alias("path")
    )
    staging = storage.staging_path(spark, tables_dir)
    known = read_table(spark, tables_dir, "documents", project_id).select("document_id")
    identities = identified(files).select("path", "document_id")
    identities.join(known.withColumn("known", F.lit(True)), "document_id", "left").write.parquet(
        f"{staging}/identities"
    )
    identities = spark.read.parquet(f"{staging}/identities")
    pending = identities.where(F.col("known").isNull()).select("path")
    skipped = identities.where("known").count()

    # On a first load all files are pending and nothing is joined; later runs have few.
    todo = identified(restrict(files, pending, "path") if skipped else files)
    extracted(todo, stamp, max_chars, overlap).write.parquet(f"{staging}/documents")
    staged = spark.read.schema(STAGED).parquet(f"{staging}/documents")
    documents, segments, chunks = write_documents(spark, staged, tables_dir)
    storage.remove(spark, staging)
    return IngestResult(documents, skipped, segments, chunks, rejected)


def ingest(
    spark: SparkSession,
    *,
    raw_dir: str,
    tables_dir: str,
    project_id: str | None = None,
    now: datetime | None = None,
    max_chars: int = CHUNK_MAX_CHARS,
    overlap: int = CHUNK_OVERLAP_CHARS,
) -> IngestResult:
    """Read all unknown files below `raw_dir` into the three tables.

    A file whose identity (project, path, content) is known is skipped; changed content
    is a further version, the old one stays. Files outside a valid project folder are
    reported and do not stop the run.
    """
    if project_id is not None:
        require_project_id(project_id)
    files = discover(spark, raw_dir, project_id)
    return ingest_files(spark, files, tables_dir, now, project_id, max_chars, overlap)


def index_chunks(
    spark: SparkSession,
    *,
    tables_dir: str,
    index_path: str,
    encoder: Encoder,
    project_id: str | None = None,
    batch_size: int = EMBEDDING_BATCH,
    dim: int = EMBEDDING_DIM,
    lexicon: Parts | None = None,
    commits: int = 1,
    stops: Collection[str] | None = None,
    compare_texts: bool = False,
) -> IndexResult:
    """Embed the chunks that are not indexed yet (or whose text changed) and store them.

    The encoder is not called where nothing is pending. Ids are compared as narrow rows;
    chunk texts stay where they were read. A long run can be stored in several `commits`:
    if it is aborted, the next run goes on after the last one.

    Without a `lexicon` compounds are split by the model stored with the index; a first run learns
    it from all chunks.
    """
    chunks = read_table(spark, tables_dir, "chunks", project_id)
    index = open_index(spark, index_path)
    if project_id is not None:
        index = index.where(F.col("project_id") == project_id)
    total = chunks.count()
    staging = storage.staging_path(spark, index_path)
    pending_ids(chunks, index, compare_texts).write.parquet(f"{staging}/pending")
    pending = spark.read.parquet(f"{staging}/pending")
    waiting = pending.count()
    share = F.pmod(F.xxhash64("chunk_id", F.lit("commit")), F.lit(commits))
    if waiting and lexicon is None:
        lexicon = stored_splitter(spark, index_path, chunks)
    for number in range(commits if waiting else 0):
        due = restrict(chunks, pending.where(share == number), "chunk_id")
        own = due.select(*CHUNK_COLUMNS)
        upsert(spark, index_path, own, finish=lambda rows: index_rows(rows, encoder, lexicon, dim, batch_size, stops))
    storage.remove(spark, staging)
    return IndexResult(embedded=waiting, skipped=total - waiting)


def stored_splitter(spark: SparkSession, index_path: str, chunks: DataFrame | None = None) -> splitter.Splitter:
    """The splitter that belongs to an index, for building it and for asking it; where there is none
    yet, it is learnt from `chunks` and stored."""
    path = splitter_path(index_path)
    if chunks is not None and not storage.has_data(spark, path):
        said = F.concat_ws(" ", "heading", "text")
        splitter.save(splitter.learn(splitter.distinct_words(chunks, said)), path)
    return splitter.splitter(splitter.load(spark, path))
