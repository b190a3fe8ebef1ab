"""Original files: discovery and everything their path says about them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citewerk.functions.ids import derive_id, is_project_id, require_project_id
from citewerk.functions.text import nfc
from citewerk.schemas import DOC_TYPE_BY_FOLDER, FILE_SUFFIXES, MEDIA_TYPE_BY_SUFFIX
from citewerk.sources import storage

# Dates in file names and reporting dates in texts.
NAME_DATE_PATTERN = r"(20\d{2})-(\d{2})(?:-(\d{2}))?"
CONTENT_DATE_PATTERN = r"(?U)\bStand:?\s+(\d{1,2}\.\d{1,2}\.20\d{2})\b"

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def suffix_glob() -> str:
    """Glob for the supported suffixes in any letter case."""
    anycase = ["".join(f"[{c}{c.upper()}]" for c in s[1:]) for s in FILE_SUFFIXES]
    return "*.{" + ",".join(anycase) + "}"


def discover(spark: SparkSession, raw_dir: str, project_id: str | None = None) -> DataFrame:
    """Supported files below `raw_dir` (or one project's folder), never modified.

    Adds `relative`, the path below `raw_dir`. `content` is read only if selected.
    A missing folder is an empty result; other file kinds are ignored.
    """
    if project_id is not None:
        require_project_id(project_id)
    root = f"{raw_dir}/{project_id}" if project_id else raw_dir
    if not storage.exists(spark, root):
        files = spark.createDataFrame([], FILE_SCHEMA)
    else:
        files = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", suffix_glob())
            .load(root)
        )
    prefix = storage.qualified(spark, raw_dir).rstrip("/") + "/"
    return files.withColumn("relative", F.substring(F.col("path"), len(prefix) + 1, 1 << 30))


def project_of(relative: Column) -> Column:
    """Project folder of a path, NULL where the file lies in none or in an invalid one."""
    parts = F.split(relative, "/")
    return F.when((F.size(parts) >= 2) & is_project_id(parts[0]), parts[0])


def file_name_of(relative: Column) -> Column:
    return F.element_at(F.split(relative, "/"), -1)


def suffix_of(file_name: Column) -> Column:
    return F.lower(F.regexp_extract(file_name, r"(\.[^.]+)\z", 1))


def doc_type_of(relative: Column) -> Column:
    """Kind of document from the first known folder between project and file."""
    kinds = F.create_map(*[F.lit(x) for pair in DOC_TYPE_BY_FOLDER.items() for x in pair])
    parts = F.split(relative, "/")
    folders = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    known = F.filter(F.transform(folders, lambda f: kinds[F.lower(f)]), lambda k: k.isNotNull())
    return F.coalesce(F.get(known, 0), F.lit("unbekannt"))


def media_type_of(file_name: Column) -> Column:
    kinds = F.create_map(*[F.lit(x) for pair in MEDIA_TYPE_BY_SUFFIX.items() for x in pair])
    return F.coalesce(kinds[suffix_of(file_name)], F.lit("application/octet-stream"))


def date_from_name(file_name: Column) -> Column:
    """First `yyyy-MM[-dd]` of a name; the first of the month where no day is given.

    An impossible date gives NULL instead of failing the whole run.
    """
    year, month, day = (F.regexp_extract(file_name, NAME_DATE_PATTERN, i) for i in (1, 2, 3))
    text = F.concat_ws("-", year, month, F.when(day == "", "01").otherwise(day))
    return F.try_to_date(text, "yyyy-MM-dd")


def name_has_day(file_name: Column) -> Column:
    return F.regexp_extract(file_name, NAME_DATE_PATTERN, 3) != ""


def date_from_text(text: Column) -> Column:
    """Reporting date of one text, NULL if there is none or it does not exist."""
    found = F.regexp_extract(text, CONTENT_DATE_PATTERN, 1)
    # The plain substring test spares most texts the regular expression.
    return F.when(F.contains(text, F.lit("Stand")), F.try_to_date(found, "d.M.yyyy"))


def date_from_segments(segments: Column) -> Column:
    """First valid reporting date over the segments of a document, in order."""
    dates = F.transform(segments, lambda s: date_from_text(s["text"]))
    return F.get(F.filter(dates, lambda d: d.isNotNull()), 0)


def document_date(file_name: Column, content_date: Column) -> Column:
    """A full date in the name wins, then the content's date, then the name's month."""
    named = date_from_name(file_name)
    return F.when(name_has_day(file_name), named).otherwise(F.coalesce(content_date, named))


def describe(files: DataFrame) -> DataFrame:
    """Identity and path metadata of accepted files (those with a project).

    Needs `relative`, `length` and `content_hash`; drops nothing, keeps other columns.
    """
    return (
        files.withColumn("project_id", project_of(F.col("relative")))
        .withColumn("source_path", nfc(F.col("relative")))
        .withColumn("file_name", file_name_of(F.col("source_path")))
        .withColumn("doc_type", doc_type_of(F.col("relative")))
        .withColumn("media_type", media_type_of(F.col("file_name")))
        .withColumn("file_size", F.col("length").cast("bigint"))
        .withColumn(
            "document_id",
            derive_id(F.col("project_id"), F.col("source_path"), F.col("content_hash")),
        )
    )
