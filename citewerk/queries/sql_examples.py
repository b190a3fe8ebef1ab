"""The ready-made SQL questions, over derived corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewerk.operators.segments import labelled_cells, row_locator
from citewerk.plans import canned_sql
from citewerk.plans.sample_views import view
from citewerk.queries.registry import query

AGENDA = ("TOP", "Thema", "Sachstand", "Verantwortlich")


def agenda_rows(spark, folder):
    """Minutes as chunks of an agenda table."""
    rows = view(spark, folder, "minutes")
    header = F.array(*[F.lit(h) for h in AGENDA])
    cells = F.array(F.col("turn").cast("string"), "role", "text", "owner")
    return rows.select(
        "document_id",
        "project_id",
        "doc_type",
        "document_date",
        F.concat(F.lit("protokoll_"), "document_id").alias("file_name"),
        F.lit("Tagesordnungspunkte").alias("heading"),
        row_locator(header, cells, F.col("turn"), F.lit("Tabelle 1")).alias("locator"),
        labelled_cells(header, cells).alias("text"),
    )


AGENDA_SQL = """
    agenda AS (
        SELECT document_id, project_id, doc_type, document_date,
               'protokoll_' || document_id AS file_name,
               'Tagesordnungspunkte' AS heading,
               'TOP ' || CAST(turn AS VARCHAR) AS locator,
               'TOP: ' || CAST(turn AS VARCHAR) || chr(10) || 'Thema: ' || role
               || CASE WHEN text <> '' THEN chr(10) || 'Sachstand: ' || text ELSE '' END
               || CASE WHEN owner <> '' THEN chr(10) || 'Verantwortlich: ' || owner ELSE '' END
               AS text
        FROM minutes
    )"""


def _field(label: str) -> str:
    """What the first line of a text with this label says, empty without one."""
    wanted = f"list_filter(string_split(text, chr(10)), lambda line: starts_with(line, '{label}: '))[1]"
    return f"coalesce(substr({wanted}, {len(label) + 3}), '')"


FIELDS_SQL = f"""
    {AGENDA_SQL}, fields AS (
        SELECT agenda.*, {_field("Thema")} AS topic, {_field("Verantwortlich")} AS owner FROM agenda
    ), searched AS (SELECT * FROM fields WHERE project_id = 'DOC-1')"""


@query("SELECT tenant AS project_id, doc_type, count(*) AS documents FROM corpus GROUP BY 1, 2", "corpus")
def inventory_by_project(spark, folder):
    corpus = view(spark, folder, "corpus")
    return canned_sql.inventory(corpus.select(F.col("tenant").alias("project_id"), "doc_type"))


@query(
    """
    SELECT file_name, locator, document_date, substr(text, 1, 120) AS excerpt FROM corpus
    WHERE project_id = 'DOC-1' AND lower(text) LIKE '%keit%'
      AND (lower(text) LIKE '%nicht%' OR lower(text) LIKE '%ohne%' OR lower(text) LIKE '%über%')
    """,
    "corpus",
)
def open_items(spark, folder):
    corpus = view(spark, folder, "corpus")
    return canned_sql.open_items(corpus, "DOC-1", "keit", ("nicht", "ohne", "über"))


@query(
    """
    SELECT document_date, file_name, locator, substr(text, 1, 160) AS excerpt FROM corpus
    WHERE project_id = 'DOC-1' AND text LIKE '%Ver%'
    """,
    "corpus",
)
def topic_over_time(spark, folder):
    return canned_sql.topic_over_time(view(spark, folder, "corpus"), "DOC-1", "Ver")


@query(
    f"""
    WITH {FIELDS_SQL}, minutes_only AS (SELECT * FROM searched WHERE doc_type = 'protokoll')
    SELECT topic, owner, locator, document_date FROM minutes_only
    """,
    "minutes",
)
def responsibilities(spark, folder):
    return canned_sql.responsibilities(agenda_rows(spark, folder), "DOC-1")


@query(
    f"""
    WITH {FIELDS_SQL}, nobody(said) AS (VALUES ('nicht benannt'), ('offen'), ('ungeklärt'))
    SELECT s.topic, s.locator, s.file_name, s.document_date FROM searched s SEMI JOIN nobody ON s.owner = said
    """,
    "minutes",
)
def without_owner(spark, folder):
    return canned_sql.without_owner(agenda_rows(spark, folder), "DOC-1")


@query(
    """
    WITH priced AS (SELECT file_name, locator, text FROM claims WHERE project_id = 'DOC-1' AND contains(text, 'EUR')),
    said AS (
        SELECT file_name, locator, coalesce(regexp_extract_all(text, '([0-9][0-9.]*) EUR', 1)[1], '') AS amount
        FROM priced
    )
    SELECT file_name, locator, amount FROM said GROUP BY ALL
    """,
    "claims",
)
def amounts(spark, folder):
    return canned_sql.amounts(view(spark, folder, "claims"), "DOC-1")


@query(
    """
    SELECT project_id, file_name FROM corpus
    WHERE project_id = 'DOC-1' AND (text LIKE '%example.com%' OR text LIKE '%Licen%')
    """,
    "corpus",
)
def leaked_terms(spark, folder):
    return canned_sql.leaked_terms(
        view(spark, folder, "corpus"), "DOC-1", ("example.com", "Licen")
    )


@query(
    """
    WITH sizes AS (SELECT doc_type, list_sort(list(length(text))) AS sorted FROM corpus GROUP BY doc_type)
    SELECT doc_type, len(sorted) AS chunks, sorted[1] AS shortest, sorted[len(sorted)] AS longest,
           round((sorted[(len(sorted) + 1) // 2] + sorted[len(sorted) // 2 + 1]) / 2) AS median
    FROM sizes
    """,
    "corpus",
)
def length_distribution(spark, folder):
    return canned_sql.length_distribution(view(spark, folder, "corpus"))


@query(
    """
    WITH placed AS (
        SELECT source_path, ingested_at, count(*) OVER path AS versions,
               row_number() OVER (path ORDER BY ingested_at DESC) AS place
        FROM claims WINDOW path AS (PARTITION BY source_path)
    )
    SELECT source_path, versions, ingested_at AS latest FROM placed WHERE place = 1 AND versions >= 2
    """,
    "claims",
)
def document_versions(spark, folder):
    return canned_sql.document_versions(view(spark, folder, "claims"))


@query(
    f"""
    WITH {AGENDA_SQL},
    papers AS (SELECT DISTINCT document_id, file_name FROM agenda)
    SELECT d.file_name, s.locator, s.heading, substr(s.text, 1, 200) AS excerpt
    FROM agenda s JOIN papers d USING (document_id)
    WHERE s.project_id = 'DOC-1' AND s.text LIKE '%ung%'
    """,
    "minutes",
)
def segments_in_context(spark, folder):
    segments = agenda_rows(spark, folder)
    papers = segments.select("document_id", "file_name").distinct()
    return canned_sql.segments_in_context(segments.drop("file_name"), papers, "DOC-1", "ung")


@query(
    f"""
    WITH {AGENDA_SQL}
    SELECT document_id, locator, text FROM agenda
    """,
    "minutes",
)
def table_row_segments(spark, folder):
    return agenda_rows(spark, folder).select("document_id", "locator", "text")


@query(
    "SELECT lang AS language, count(*) AS texts, sum(n_chars) AS characters FROM documents GROUP BY 1"
)
def free_sql(spark, folder):
    spark.read.parquet(f"{folder}/documents.parquet").createOrReplaceTempView("citewerk_documents")
    return spark.sql(
        "SELECT lang AS language, count(*) AS texts, sum(n_chars) AS characters "
        "FROM citewerk_documents WHERE n_chars >= :least GROUP BY 1",
        args={"least": 0},
    )
