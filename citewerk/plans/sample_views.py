"""The domain's tables, derived from general-purpose tables row by row.

The expressions are written in SQL that Spark and other engines read alike, so a check
in another engine starts from the same rows. All views keep every row of their table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Column name -> expression, per view.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    # Office files as a crawler would find them: some outside a valid project folder.
    "files": (
        "documents",
        {
            "doc_id": "doc_id",
            "relative": (
                "CASE WHEN source = 'src9' THEN '' WHEN source = 'src19' THEN 'entwurf/' "
                "ELSE 'SRC-' || substr(source, 4) || '/' END || "
                "CASE lang WHEN 'de' THEN 'Protokolle/' WHEN 'fr' THEN 'ablage/statusberichte/' "
                "WHEN 'es' THEN 'TERMINPLAENE/genehmigungen/' ELSE '' END || "
                "CASE doc_id % 4 WHEN 0 THEN 'beho\u0308rden_2026-' || "
                "lpad(CAST(doc_id % 14 AS STRING), 2, '0') || '-' || "
                "lpad(CAST(doc_id % 33 AS STRING), 2, '0') WHEN 1 THEN 'bericht_2026-09' "
                "WHEN 2 THEN 'BA-2026-0587' ELSE 'ohne_datum' END || '_' || "
                "CAST(doc_id AS STRING) || "
                "CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.DOCX' ELSE '.xlsx' END"
            ),
            "length": "n_chars",
            "text": "text",
        },
    ),
    # One chunk per document text, a second project with the same kind of content.
    "corpus": (
        "documents",
        {
            "chunk_id": "lpad(CAST(doc_id AS STRING), 12, '0')",
            "document_id": "CAST(doc_id AS STRING)",
            "project_id": "CASE WHEN source = 'src7' THEN 'DOC-2' ELSE 'DOC-1' END",
            "tenant": "'SRC-' || substr(source, 4)",
            "doc_type": "lang",
            "document_date": (
                "CASE WHEN doc_id % 7 = 0 THEN NULL "
                "ELSE DATE '2026-01-01' + CAST(doc_id % 365 AS INT) END"
            ),
            "file_name": "'datei_' || CAST(doc_id % 97 AS STRING) || '.pdf'",
            "locator": "'S. ' || CAST(doc_id AS STRING)",
            "heading": "CASE WHEN doc_id % 3 = 0 THEN upper(source) ELSE NULL END",
            "position": "doc_id % 10",
            "text": "text",
            "doc_id": "doc_id",
        },
    ),
    # Minutes: every turn of a conversation is a row of an agenda table.
    "minutes": (
        "conversations",
        {
            "document_id": "CAST(conv_id AS STRING)",
            "turn": "CAST(turn AS INT)",
            "project_id": "CASE WHEN conv_id % 9 = 8 THEN 'DOC-2' ELSE 'DOC-1' END",
            "doc_type": "CASE WHEN role = 'system' THEN 'statusbericht' ELSE 'protokoll' END",
            "document_date": (
                "CASE WHEN conv_id % 5 = 0 THEN NULL "
                "ELSE DATE '2026-03-01' + CAST(conv_id % 200 AS INT) END"
            ),
            "role": "role",
            "text": "text",
            "owner": (
                "CASE turn % 5 WHEN 0 THEN 'offen' WHEN 1 THEN 'ungeklärt' WHEN 2 THEN '' "
                "WHEN 3 THEN 'nicht benannt' ELSE role END"
            ),
        },
    ),
    # Claims of change orders with an amount in the text.
    "claims": (
        "events",
        {
            "project_id": "CASE WHEN event_type = 'error' THEN 'DOC-2' ELSE 'DOC-1' END",
            "file_name": "'nachtrag_' || event_type || '.pdf'",
            "locator": "'S. ' || CAST(user_id AS STRING)",
            "text": (
                "'Nachtrag N-' || CAST(event_id % 90 AS STRING) || ': ' || "
                "CAST(CAST(round(value * 10) AS BIGINT) AS STRING) || "
                "CASE WHEN event_id % 4 = 0 THEN '.000 EUR netto' WHEN event_id % 4 = 1 "
                "THEN ' EUR und 5 EUR' ELSE ' Stunden' END"
            ),
            "source_path": "event_type || '/' || CAST(user_id AS STRING)",
            "ingested_at": "ts",
        },
    ),
}


def view_sql(name: str) -> str:
    """The view as a SELECT for another SQL engine."""
    table, columns = VIEWS[name]
    shown = ", ".join(f"{expression} AS {column}" for column, expression in columns.items())
    return f"SELECT {shown} FROM {table}"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return table(spark, folder, source).selectExpr(
        *[f"{expression} AS {column}" for column, expression in columns.items()]
    )
