"""Shared-storage helpers over the Hadoop file system API."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

#: Codec of the tables of an index: lists of places and lexemes take about half the room of the default.
COMPRESSION = "zstd"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def qualified(spark: SparkSession, path: str) -> str:
    """The path as file sources report it, with its scheme."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString()


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a table directory holds at least one data file or partition."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return False
    return any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(p))


def mark(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.create(p, True).close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small driver-side file, UTF-8."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def staging_path(spark: SparkSession, fallback_dir: str) -> str:
    """A fresh folder for an intermediate table, on storage every executor sees.

    The cluster's checkpoint folder if the session names one, else a hidden folder
    next to the tables themselves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{fallback_dir}/_staging"
    return f"{base}/citewerk-{uuid.uuid4().hex}"
