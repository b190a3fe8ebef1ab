"""Incremental ingest as a stream: new files trigger the batch transform.

The file source remembers paths; whether a file is new is still decided by its
content id, exactly as in the batch run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citewerk.plans.pipeline import ingest_files
from citewerk.sources import storage
from citewerk.sources.files import FILE_SCHEMA, suffix_glob


def ingest_stream(
    spark: SparkSession, *, raw_dir: str, tables_dir: str, checkpoint_dir: str
) -> StreamingQuery:
    """Process everything that is there and stop; call again (or loop) for more."""
    prefix = storage.qualified(spark, raw_dir).rstrip("/") + "/"
    files = (
        spark.readStream.format("binaryFile")
        .schema(FILE_SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", suffix_glob())
        .load(raw_dir)
        .withColumn("relative", F.substring(F.col("path"), len(prefix) + 1, 1 << 30))
    )

    def one_batch(batch: DataFrame, _: int) -> None:
        ingest_files(batch.sparkSession, batch, tables_dir)

    return (
        files.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint_dir)
        .trigger(availableNow=True)
        .start()
    )
