"""Fixed table schemas and domain values.

The schemas are declared, never inferred, so an all-NULL column keeps its type
and an absent table reads as an empty one of the same shape.
"""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DateType()

DOCUMENTS = _struct(
    ("document_id", _S, False),
    ("content_hash", _S, False),
    ("project_id", _S, False),
    ("source_path", _S, False),
    ("file_name", _S, False),
    ("doc_type", _S, False),
    ("media_type", _S, False),
    ("file_size", _L, False),
    ("document_date", _D, True),
    ("ingested_at", T.TimestampNTZType(), False),
)

SEGMENTS = _struct(
    ("segment_id", _S, False),
    ("document_id", _S, False),
    ("project_id", _S, False),
    ("index", _I, False),
    ("kind", _S, False),
    ("page_no", _I, True),
    ("locator", _S, False),
    ("heading", _S, True),
    ("text", _S, False),
)

CHUNKS = _struct(
    ("chunk_id", _S, False),
    ("segment_id", _S, False),
    ("document_id", _S, False),
    ("project_id", _S, False),
    ("index", _I, False),
    ("text", _S, False),
    ("char_start", _I, False),
    ("char_end", _I, False),
    ("source_path", _S, False),
    ("file_name", _S, False),
    ("doc_type", _S, False),
    ("document_date", _D, True),
    ("page_no", _I, True),
    ("locator", _S, False),
    ("heading", _S, True),
)

CHUNK_COLUMNS = tuple(CHUNKS.fieldNames())

# The retrieval index: a chunk plus what only searching needs. `lexemes` keeps
# repetitions because the text rank counts matching positions.
INDEX = T.StructType(
    [
        *CHUNKS.fields,
        T.StructField("compound_terms", _S, False),
        T.StructField("embedding", T.ArrayType(T.FloatType(), False), True),
        T.StructField("lexemes", T.ArrayType(_S, False), False),
        T.StructField("places", T.ArrayType(T.IntegerType(), False), False),
        T.StructField("text_hash", _S, False),
    ]
)

TABLES = {"documents": DOCUMENTS, "segments": SEGMENTS, "chunks": CHUNKS}

EVIDENCE = _struct(("chunk_id", _S, True), ("excerpt", _S, True))
FACT = T.StructType(
    [
        T.StructField("statement", _S),
        T.StructField("evidence", T.ArrayType(EVIDENCE)),
    ]
)
RISK_TEXT_FIELDS = (
    "title",
    "category",
    "description",
    "project_area",
    "impact",
    "probability",
    "severity",
    "owner",
    "measure",
    "status",
)
RISK = T.StructType(
    [
        *[T.StructField(name, _S) for name in RISK_TEXT_FIELDS],
        T.StructField("facts", T.ArrayType(FACT)),
        T.StructField("conclusions", T.ArrayType(_S)),
        T.StructField("uncertainties", T.ArrayType(_S)),
    ]
)
ANALYSIS = T.StructType([T.StructField("risks", T.ArrayType(RISK))])
RUN_STATS = _struct(
    ("provided_chunks", _I, True),
    ("requests", _I, True),
    ("retries", _I, True),
    ("input_tokens", _I, True),
    ("output_tokens", _I, True),
    ("seconds", T.DoubleType(), True),
)
REPORT = T.StructType(
    [
        T.StructField("project_id", _S),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("model_name", _S),
        T.StructField("stats", RUN_STATS),
        T.StructField("risks", T.ArrayType(RISK)),
        T.StructField("sources", T.MapType(_S, CHUNKS)),
    ]
)

# They must equal the established data contract.
PROJECT_ID_PATTERN = "[A-Z]{2,10}-[0-9]{1,6}"
FILE_SUFFIXES = (".pdf", ".docx", ".xlsx")
DOC_TYPES = ("protokoll", "statusbericht", "terminplan", "genehmigung", "unbekannt")
DOC_TYPE_BY_FOLDER = {
    "protokolle": "protokoll",
    "statusberichte": "statusbericht",
    "terminplan": "terminplan",
    "terminplaene": "terminplan",
    "genehmigungen": "genehmigung",
}
MEDIA_TYPE_BY_SUFFIX = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
}
SEGMENT_KINDS = ("seite", "abschnitt", "tabellenzeile")
UNSPLITTABLE_KIND = "tabellenzeile"
RISK_CATEGORIES = (
    "termin",
    "kosten",
    "genehmigung",
    "planung",
    "qualität",
    "vertrag",
    "ressourcen",
    "lieferanten",
    "schnittstellen",
)
LEVELS = ("niedrig", "mittel", "hoch")
RISK_STATUSES = ("offen", "eingetreten", "in_bearbeitung")
