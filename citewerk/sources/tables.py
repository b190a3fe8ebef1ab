"""The three stored tables: scans with a fixed schema, appends, SQL views."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.functions.ids import require_project_id
from citewerk.schemas import TABLES
from citewerk.settings import BROADCAST_BYTES
from citewerk.sources import storage


def read_table(
    spark: SparkSession,
    tables_dir: str,
    name: str,
    project_id: str | None = None,
    schema: T.StructType | None = None,
) -> DataFrame:
    """One stored table, or an empty one of the same schema where it is absent.

    Tables are partitioned by project, so `project_id` prunes to one folder.
    """
    if project_id is not None:
        require_project_id(project_id)
    schema = schema or TABLES[name]
    path = f"{tables_dir}/{name}"
    if storage.has_data(spark, path):
        table = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    else:
        table = spark.createDataFrame([], schema)
    return table if project_id is None else table.where(F.col("project_id") == project_id)


def append_table(rows: DataFrame, tables_dir: str, name: str) -> None:
    """A true append; existing files are not touched.

    `rebalance` lets AQE split a project that holds a large share of all rows over
    several write tasks and files, and merge small ones.
    """
    columns = TABLES[name].fieldNames()
    (
        rows.select(*columns)
        .hint("rebalance", "project_id")
        .write.mode("append")
        .partitionBy("project_id")
        .parquet(f"{tables_dir}/{name}")
    )


def register_views(
    spark: SparkSession, tables_dir: str, names: Iterable[str] = tuple(TABLES)
) -> None:
    for name in names:
        read_table(spark, tables_dir, name).createOrReplaceTempView(name)


def is_small(ids: DataFrame, bound: int = BROADCAST_BYTES) -> bool:
    """Whether a narrow id set is proven, by the bytes of its values, to fit a broadcast."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 8 for c in ids.columns), F.lit(0))
    return (ids.agg(F.sum(size)).first()[0] or 0) <= bound


def restrict(wide: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi- or anti-join wide rows with a narrow id set.

    A small id set is broadcast so the wide rows stay where they are; a large one
    goes through a shuffled join.
    """
    ids = ids.select(key)
    return wide.join(F.broadcast(ids) if is_small(ids) else ids, key, how)


def settled(rows: DataFrame) -> DataFrame:
    """Rows that two branches of a plan read: computed and written once to the checkpoint
    folder of the session. A session without one, such as a local test, gets its own."""
    spark = rows.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        context = spark.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="citewerk-checkpoints-"))
    return rows.checkpoint()


def append_new(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Existing rows plus those rows of the batch whose key is not known yet."""
    return existing.unionByName(batch.join(existing.select(key), key, "left_anti"))


def first_per_key(rows: DataFrame, key: str, order: Iterable[str]) -> DataFrame:
    """One row per key, the first by `order`; partial aggregation, no window per key."""
    order = list(order)
    rest = [c for c in rows.columns if c not in (key, *order)]
    best = rows.groupBy(key).agg(F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row"))
    return best.select(key, *[F.col("_row")[c].alias(c) for c in (*order, *rest)]).select(
        *rows.columns
    )


def missing_columns(existing: Iterable[str], required: Iterable[str]) -> list[str]:
    return sorted(set(required) - set(existing))
