"""Cutting scored rows to ranked lists, shared by all ways of search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Weight of one matching position in a cover-density rank (default class).
POSITION_WEIGHT = 0.1
MERGE_PARTS = 64
CANDIDATES = "question_no int, chunk_id string, text_score double, text_rank int"


def ranked(rows: DataFrame, score: str, rank: str, k: int) -> DataFrame:
    """The k best rows per question with their 1-based rank.

    Catalyst turns each filter on a row number into a window group limit that cuts every
    map-side partition to k rows per group before the shuffle. A question is cut in
    `MERGE_PARTS` parts first: the lists of very many scan partitions would otherwise meet
    in one task.
    """
    best = [F.desc_nulls_last(score), F.asc("chunk_id")]
    part = F.pmod(F.spark_partition_id(), F.lit(MERGE_PARTS))
    within = Window.partitionBy("question_no", "_part").orderBy(*best)
    overall = Window.partitionBy("question_no").orderBy(*best)
    return (
        rows.withColumn("_part", part)
        .withColumn("_place", F.row_number().over(within))
        .where(F.col("_place") <= k)
        .drop("_part", "_place")
        .withColumn(rank, F.row_number().over(overall))
        .where(F.col(rank) <= k)
    )
