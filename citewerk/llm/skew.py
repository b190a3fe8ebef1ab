"""Joins with a side of unique keys where a few keys may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citewerk.llm.shared import fresh

#: A key is hot above this share of all rows, so there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 1000


def join_counted(rows: DataFrame, side: DataFrame, key: str, counts: str, total: int) -> DataFrame:
    """rows left-joined with `side` (one row a key), whose column `counts` has the rows of each key.

    The hot keys, fewer than 1 / HOT_SHARE, are broadcast; what is shuffled has no key above that
    share. Null keys find nothing. `counts` is not returned.
    """
    columns = [c for c in side.columns if c not in (key, counts)]
    found, flag = fresh([*rows.columns, *side.columns], "found", "flag")
    limit = total * HOT_SHARE
    own = side.withColumn(found, F.struct(*columns)).select(key, counts, found)
    hot = own.where(F.col(counts) > limit).drop(counts).withColumn(flag, F.lit(True))
    seen = rows.join(F.broadcast(hot), key, "left")
    near = seen.where(F.col(flag)).drop(flag)
    far = seen.where(F.col(flag).isNull()).drop(flag, found)
    far = far.join(own.where(F.col(counts) <= limit).drop(counts), key, "left")
    return near.unionByName(far).select(*rows.columns, *[F.col(f"{found}.{c}").alias(c) for c in columns])
