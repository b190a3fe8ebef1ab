"""A membership filter of bounded size, built in parallel and asked beside a scan."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewerk.llm.words import mix

SEGMENT_BYTES = 1 << 15
PROBES = 4


def _positions(keys: np.ndarray, bits: int) -> np.ndarray:
    first = mix(keys.astype(np.int64).view(np.uint64))
    second = mix(first) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return (first[:, None] + steps[None, :] * second[:, None]) & np.uint64(bits - 1)


def _slots(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    masks = np.uint8(1) << (positions & np.uint64(7)).astype(np.uint8)
    return (positions >> np.uint64(3)).astype(np.int64), masks


class MemberFilter:
    """Which rows may be among `keys` (a column of longs): no false negatives.

    16 bits a key up to `max_bits`; beyond, more rows pass, which only costs time.
    """

    def __init__(self, keys: DataFrame, max_bits: int = 1 << 29, build_tasks: int = 1024):
        column = keys.columns[0]
        wanted = min(max_bits, max(SEGMENT_BYTES * 8, 16 * keys.count()))
        self.bits = bits = 1 << (wanted - 1).bit_length()

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            plane = np.zeros(bits // 8, np.uint8)
            for batch in batches:
                if batch.num_rows:
                    where, masks = _slots(_positions(batch.column(0).to_numpy(False), bits).ravel())
                    np.bitwise_or.at(plane, where, masks)
            for k in range(len(plane) // SEGMENT_BYTES):
                part = plane[k * SEGMENT_BYTES : (k + 1) * SEGMENT_BYTES]
                if part.any():
                    body = zlib.compress(part.tobytes(), 1)
                    yield pa.RecordBatch.from_pydict(
                        {"segment": pa.array([k], pa.int32()), "body": pa.array([body], pa.binary())}
                    )

        def merge(group: pd.DataFrame) -> pd.DataFrame:
            plane = np.zeros(SEGMENT_BYTES, np.uint8)
            for body in group.body:
                plane |= np.frombuffer(zlib.decompress(body), np.uint8)
            return pd.DataFrame({"segment": group.segment[:1], "body": [plane.tobytes()]})

        parts = (
            keys.select(F.col(column).cast("long").alias("key"))
            .where("key is not null")
            .coalesce(build_tasks)
            .mapInArrow(build, "segment int, body binary")
            .groupBy("segment")
            .applyInPandas(merge, "segment int, body binary")
        )
        plane = np.zeros(bits // 8, np.uint8)
        for row in parts.collect():
            start = row.segment * SEGMENT_BYTES
            plane[start : start + SEGMENT_BYTES] = np.frombuffer(row.body, np.uint8)
        self.plane = keys.sparkSession.sparkContext.broadcast(plane)

    def asker(self):
        """A function for tasks: which of an array of keys the filter holds."""
        plane, bits = self.plane, self.bits

        def ask(keys: np.ndarray) -> np.ndarray:
            where, masks = _slots(_positions(keys, bits))
            return ((plane.value[where] & masks) > 0).all(axis=1)

        return ask

    def may_hold(self, key: Column) -> Column:
        ask = self.asker()

        @F.pandas_udf("boolean")
        def held(values: pd.Series) -> pd.Series:
            return pd.Series(ask(values.to_numpy(np.int64)))

        return held(key.cast("long"))


def drop_ids(rows: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """rows whose id is not in ids (one column); only rows that the filter holds are shuffled."""
    hashed = ids.select(F.xxhash64(ids.columns[0]).alias("key"))
    maybe = MemberFilter(hashed).may_hold(F.xxhash64(f"`{id_col}`"))
    gone = ids.select(F.col(ids.columns[0]).alias("_gone"))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col("_gone"))
    checked = rows.where(maybe).join(gone, same, "left_anti")
    return rows.where(~maybe).unionByName(checked)
