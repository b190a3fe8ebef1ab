"""Exact deduplication: a two-pass Bloom filter keeps unique rows out of the shuffle.

Pass one puts the SHA-256 of every normalised text into a Bloom filter of two bit planes:
`seen`, and `again` for positions hit by more than one row. Planes of partitions merge
(again = again or (seen and seen)), so the filter is built in parallel. Pass two asks `again`
about each hash: a row with any position clear is the only one of its text and passes straight
through; the rest, repeated texts and a few false positives, are grouped exactly.

The filter has `bits_per_row` bits for each row up to `max_bits`. Beyond that bound more unique
rows join the shuffle, as narrow (hash, id) rows; the result is exact at every size.

Defined results: null text counts as empty, all empty texts are one group; of equal texts the
row with the largest id stays (a null id is smaller than any other); rows that share text and
id are separate rows of which one stays; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.llm.shared import LOWER_BYTES, fresh, pieces, raw_texts, settle

PROBES = 4
SEGMENT_BYTES = 1 << 15


def text_digest(text: bytes) -> bytes:
    return hashlib.sha256(text.translate(LOWER_BYTES)).digest()


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, sha) of every row, where sha is the digest of the text in lower case (A-Z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2048):
            sha = [text_digest(t) for t in raw_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sha, pa.binary())], names=["id", "sha"]
            )

    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("sha", T.BinaryType())]
    )
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return narrow.mapInArrow(run, schema)


def _positions(sha: list[bytes], bits: int) -> np.ndarray:
    words = np.frombuffer(b"".join(sha), dtype="<u8").reshape(-1, 4)[:, :PROBES]
    return words & np.uint64(bits - 1)


def _set_bits(plane: np.ndarray, positions: np.ndarray) -> None:
    np.bitwise_or.at(
        plane, (positions >> np.uint64(3)).astype(np.int64),
        np.uint8(1) << (positions & np.uint64(7)).astype(np.uint8),
    )


def _get_bits(plane: np.ndarray, positions: np.ndarray) -> np.ndarray:
    found = plane[(positions >> np.uint64(3)).astype(np.int64)]
    return (found >> (positions & np.uint64(7)).astype(np.uint8)) & 1 > 0


def filter_bits(rows: int, bits_per_row: int, max_bits: int) -> int:
    """A power of two, at least one segment."""
    wanted = max(SEGMENT_BYTES * 8, min(rows * bits_per_row, max_bits))
    return 1 << (wanted - 1).bit_length() if wanted < max_bits else max_bits


def repeated_filter(rows: DataFrame, bits: int, build_tasks: int) -> np.ndarray:
    """First pass: the plane of positions that more than one row of `sha` hits.

    Planes travel in compressed segments; the merged plane of bits / 8 bytes, whose size
    is bounded by a parameter, is what the driver gets.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(bits // 8, np.uint8)
        again = np.zeros(bits // 8, np.uint8)
        some = False
        for batch in batches:
            if not batch.num_rows:
                continue
            some = True
            where, hits = np.unique(
                _positions(batch.column(0).to_pylist(), bits), return_counts=True
            )
            _set_bits(again, where[(hits > 1) | _get_bits(seen, where)])
            _set_bits(seen, where)
        if not some:
            return
        for segment in range(bits // 8 // SEGMENT_BYTES):
            part = slice(segment * SEGMENT_BYTES, (segment + 1) * SEGMENT_BYTES)
            if seen[part].any():
                yield pa.RecordBatch.from_pydict(
                    {
                        "segment": pa.array([segment], pa.int32()),
                        "seen": pa.array([zlib.compress(seen[part].tobytes(), 1)], pa.binary()),
                        "again": pa.array([zlib.compress(again[part].tobytes(), 1)], pa.binary()),
                    }
                )

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        seen = np.zeros(SEGMENT_BYTES, np.uint8)
        again = np.zeros(SEGMENT_BYTES, np.uint8)
        for one, two in zip(group.seen, group.again):
            one = np.frombuffer(zlib.decompress(one), np.uint8)
            again |= np.frombuffer(zlib.decompress(two), np.uint8) | (seen & one)
            seen |= one
        return pd.DataFrame({"segment": group.segment[:1], "again": [again.tobytes()]})

    merged = (
        rows.select("sha")
        .coalesce(build_tasks)
        .mapInArrow(build, "segment int, seen binary, again binary")
        .groupBy("segment")
        .applyInPandas(merge, "segment int, again binary")
    )
    plane = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():
        start = row.segment * SEGMENT_BYTES
        plane[start : start + SEGMENT_BYTES] = np.frombuffer(row.again, np.uint8)
    return plane


class CopyFinder:
    """The groups of equal texts of one table.

    `groups` has a row for each text of the candidates: sha, keep_id, group_size.
    """

    def __init__(
        self,
        docs: DataFrame,
        id_col: str = "doc_id",
        text_col: str = "text",
        bits_per_row: int = 16,
        max_bits: int = 1 << 29,
        build_tasks: int = 1024,
    ):
        self.id_col, self.text_col = id_col, text_col
        self.rows = settle(digests(docs, id_col, text_col))
        self.bits = filter_bits(self.rows.count(), bits_per_row, max_bits)
        plane = repeated_filter(self.rows, self.bits, build_tasks)
        self.plane = docs.sparkSession.sparkContext.broadcast(plane)
        flagged = self.rows.withColumn("maybe", self.maybe_repeated(F.col("sha")))
        self.single = flagged.where(~F.col("maybe")).select("id", "sha")
        self.candidates = settle(
            flagged.where("maybe").groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n"))
        )
        self.groups = settle(
            self.candidates.groupBy("sha").agg(
                F.max("id").alias("keep_id"), F.sum("n").alias("group_size")
            )
        )

    def maybe_repeated(self, sha):
        plane, bits = self.plane, self.bits

        @F.pandas_udf("boolean")
        def ask(values: pd.Series) -> pd.Series:
            if not len(values):
                return pd.Series([], dtype=bool)
            return pd.Series(_get_bits(plane.value, _positions(list(values), bits)).all(axis=1))

        return ask(sha)

    def decisions(self) -> DataFrame:
        """id, keep_id, group_size, kept, sha of every row."""
        one = F.lit(1).cast("long")
        alone = self.single.select(
            "id", F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), "sha"
        )
        grouped = (
            self.candidates.join(self.groups, "sha")
            .withColumn("copy", F.explode(F.sequence(one, F.col("n"))))
            .select(
                "id", "keep_id", "group_size",
                (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
                "sha",
            )
        )
        return alone.unionByName(grouped)

    def kept_rows(self, docs: DataFrame) -> DataFrame:
        """The rows that stay, with all their columns; unique rows pass without a shuffle."""
        sha, keep, row = fresh(docs.columns, "sha", "keep_id", "row")

        @F.pandas_udf("binary")
        def digest(values: pd.Series) -> pd.Series:
            return pd.Series([text_digest((t or "").encode()) for t in values], dtype=object)

        marked = docs.withColumn(sha, digest(F.col(f"`{self.text_col}`")))
        maybe = self.maybe_repeated(F.col(sha))
        keepers = self.groups.select(F.col("sha").alias(row), F.col("keep_id").alias(keep))
        same = (F.col(sha) == F.col(row)) & F.col(f"`{self.id_col}`").eqNullSafe(F.col(keep))
        first = (
            marked.where(maybe).join(keepers, same, "left_semi").dropDuplicates([sha])
        )
        return marked.where(~maybe).unionByName(first).drop(sha)


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of docs: id, keep_id, group_size, kept, text_sha256."""
    found = CopyFinder(docs, id_col, text_col, **options).decisions()
    return found.select(
        F.col("id").alias(id_col), "keep_id", "group_size", "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the copies, all columns kept."""
    return CopyFinder(docs, id_col, text_col, **options).kept_rows(docs)
