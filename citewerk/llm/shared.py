"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lower-cases A-Z in UTF-8 bytes and leaves every other byte.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: What separates words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD = rb"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settle(rows: DataFrame) -> DataFrame:
    """Compute once and cut the lineage: rows are written to the shared checkpoint folder.

    The folder is the one that the session names in `spark.checkpoint.dir`. Only a session
    without one, such as a local test, gets a temporary folder of its own.
    """
    _shared_folder(rows.sparkSession)
    return rows.checkpoint()


def _shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("Name a folder that all machines share in spark.checkpoint.dir")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="citewerk-checkpoints-"))
            folder = context.getCheckpointDir()
    return folder


def written(rows: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """rows as Parquet in a new folder of the shared storage, read again.

    With `by`, files are apart for each value of that column, and a filter on it reads only its own.
    """
    path = f"{_shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (rows.write.partitionBy(by) if by else rows.write).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def fresh(taken: Iterable[str], *wanted: str) -> list[str]:
    """Column names that no column has yet, whatever its case."""
    used = {name.lower() for name in taken}
    names = []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        names.append(name)
    return names


def id_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a task makes of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def texts(column: pa.Array) -> list[str]:
    """Strings of an Arrow column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of an Arrow column, null as empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]
