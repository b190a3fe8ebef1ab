"""Identity, path metadata, dates, incremental sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewerk.functions.ids import derive_id, is_project_id
from citewerk.functions.text import (
    citation,
    match_form,
    nfc,
    slug,
    source_line,
    table_cell,
    thousands,
)
from citewerk.operators.evidence import source_blocks
from citewerk.operators.index import merge_rows, pending_ids, stale_ids, text_hash
from citewerk.operators.segments import heading_by_font_size
from citewerk.plans.sample_views import table, view
from citewerk.queries.registry import query
from citewerk.sources.files import (
    date_from_name,
    date_from_segments,
    describe,
    document_date,
    file_name_of,
    project_of,
)
from citewerk.sources.tables import append_new, first_per_key

ACCEPTED_SQL = "regexp_full_match(split_part(relative, '/', 1), '[A-Z]{2,10}-[0-9]{1,6}')"
ID_SQL = "substr(sha256({}), 1, 32)"
NAME_DATE_SQL = """
    CASE WHEN regexp_extract({n}, '(20\\d{{2}})-(\\d{{2}})(?:-(\\d{{2}}))?', 1) = '' THEN NULL ELSE
    CAST(try_strptime(
        regexp_extract({n}, '(20\\d{{2}})-(\\d{{2}})(?:-(\\d{{2}}))?', 1) || '-' ||
        regexp_extract({n}, '(20\\d{{2}})-(\\d{{2}})(?:-(\\d{{2}}))?', 2) || '-' ||
        CASE WHEN regexp_extract({n}, '(20\\d{{2}})-(\\d{{2}})(?:-(\\d{{2}}))?', 3) = '' THEN '01'
        ELSE regexp_extract({n}, '(20\\d{{2}})-(\\d{{2}})(?:-(\\d{{2}}))?', 3) END,
        '%Y-%m-%d') AS DATE) END"""


@query(
    f"""
    WITH named AS (
        SELECT *, sha256(text) AS content_hash, nfc_normalize(relative) AS source_path,
               split_part(relative, '/', 1) AS project_id, length AS file_size,
               string_split(relative, '/') AS parts
        FROM files WHERE {ACCEPTED_SQL} AND relative LIKE '%/%'
    ), typed AS (
        SELECT *, parts[-1] AS raw_name, lower(regexp_extract(parts[-1], '(\\.[^.]+)$', 1)) AS suffix,
               list_filter(list_transform(parts[2:-2], lambda f: CASE lower(f)
                   WHEN 'protokolle' THEN 'protokoll' WHEN 'statusberichte' THEN 'statusbericht'
                   WHEN 'terminplan' THEN 'terminplan' WHEN 'terminplaene' THEN 'terminplan'
                   WHEN 'genehmigungen' THEN 'genehmigung' END), lambda k: k IS NOT NULL) AS kinds
        FROM named
    )
    SELECT {ID_SQL.format("project_id || chr(31) || source_path || chr(31) || content_hash")}
               AS document_id,
           content_hash, project_id, source_path, nfc_normalize(raw_name) AS file_name,
           coalesce(kinds[1], 'unbekannt') AS doc_type,
           CASE suffix WHEN '.pdf' THEN 'application/pdf'
               WHEN '.docx' THEN
                   'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
               WHEN '.xlsx' THEN
                   'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet'
               ELSE 'application/octet-stream' END AS media_type,
           file_size
    FROM typed
    """,
    "files",
)
def file_metadata(spark, folder):
    files = view(spark, folder, "files").withColumn("content_hash", F.sha2("text", 256))
    accepted = files.where(project_of(F.col("relative")).isNotNull())
    return describe(accepted).select(
        "document_id",
        "content_hash",
        "project_id",
        "source_path",
        "file_name",
        "doc_type",
        "media_type",
        "file_size",
    )


@query(
    f"""
    SELECT nfc_normalize(relative) AS path FROM files
    WHERE NOT (relative LIKE '%/%' AND {ACCEPTED_SQL})
    """,
    "files",
)
def rejected_files(spark, folder):
    files = view(spark, folder, "files")
    return files.where(project_of(F.col("relative")).isNull()).select(
        nfc(F.col("relative")).alias("path")
    )


CANDIDATE = (
    "CASE c_custkey % 5 WHEN 0 THEN upper(substr(c_mktsegment, 1, 3)) || '-' || "
    "CAST(c_custkey AS STRING) WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment || '-1' "
    "WHEN 3 THEN 'BAU-' || CAST(c_custkey * 977 AS STRING) "
    "ELSE 'BAU-' || CAST(c_custkey AS STRING) || '/..' END"
)


@query(
    f"""
    SELECT c_custkey AS id, {CANDIDATE} AS candidate,
           regexp_full_match({CANDIDATE}, '[A-Z]{{2,10}}-[0-9]{{1,6}}') AS valid
    FROM customer
    """
)
def project_id_validation(spark, folder):
    return (
        table(spark, folder, "customer")
        .selectExpr("c_custkey AS id", f"{CANDIDATE} AS candidate")
        .withColumn("valid", is_project_id(F.col("candidate")))
    )


@query(
    f"""
    WITH named AS (SELECT doc_id, parts[-1] AS file_name FROM
        (SELECT doc_id, string_split(relative, '/') AS parts FROM files))
    SELECT doc_id, file_name, {NAME_DATE_SQL.format(n="file_name")} AS name_date FROM named
    """,
    "files",
)
def dates_from_names(spark, folder):
    return view(spark, folder, "files").select(
        "doc_id",
        file_name_of(F.col("relative")).alias("file_name"),
        date_from_name(file_name_of(F.col("relative"))).alias("name_date"),
    )


# Segment texts of one document: the text and two lines that may carry a reporting date.
FIRST_LINE = (
    "CASE doc_id % 5 WHEN 0 THEN 'Kopf · Stand 31.02.2026' WHEN 1 THEN 'Sachstand 12.09.2026' "
    "WHEN 2 THEN 'Stand: 1.9.2026, Bauamt' WHEN 3 THEN 'Standsicherheit 15.09.2026' ELSE text END"
)
LAST_LINE = (
    "CASE doc_id % 2 WHEN 0 THEN 'Stand ' || CAST(1 + doc_id % 28 AS STRING) || '.0' || "
    "CAST(1 + doc_id % 9 AS STRING) || '.2026' ELSE 'ohne Datum' END"
)
STAND_SQL = (
    "CAST(try_strptime(nullif(regexp_extract({t}, "
    "'\\bStand:?\\s+(\\d{{1,2}}\\.\\d{{1,2}}\\.20\\d{{2}})\\b', 1), ''), '%d.%m.%Y') AS DATE)"
)


@query(
    f"""
    WITH named AS (
        SELECT doc_id, parts[-1] AS file_name, {FIRST_LINE} AS a, text AS b, {LAST_LINE} AS c
        FROM (SELECT doc_id, text, string_split(relative, '/') AS parts FROM files)
    ), dated AS (
        SELECT *, coalesce({STAND_SQL.format(t="a")}, {STAND_SQL.format(t="b")},
                           {STAND_SQL.format(t="c")}) AS content_date,
               {NAME_DATE_SQL.format(n="file_name")} AS name_date
        FROM named
    )
    SELECT doc_id, content_date,
           CASE WHEN regexp_matches(
                   regexp_extract(file_name, '20\\d{{2}}-\\d{{2}}(?:-\\d{{2}})?'), '-\\d\\d-')
               THEN name_date ELSE coalesce(content_date, name_date) END AS document_date
    FROM dated
    """,
    "files",
)
def document_dates(spark, folder):
    files = view(spark, folder, "files").selectExpr(
        "doc_id", "relative", f"{FIRST_LINE} AS a", "text AS b", f"{LAST_LINE} AS c"
    )
    segments = F.array(*[F.struct(F.col(c).alias("text")) for c in ("a", "b", "c")])
    found = date_from_segments(segments)
    return files.select(
        "doc_id",
        found.alias("content_date"),
        document_date(file_name_of(F.col("relative")), found).alias("document_date"),
    )


@query(
    f"""
    SELECT doc_id, {ID_SQL.format("document_id || chr(31) || CAST(position AS VARCHAR)")}
               AS segment_id,
           {ID_SQL.format("project_id || chr(31) || file_name || chr(31) || sha256(text)")}
               AS document_id
    FROM corpus
    """,
    "corpus",
)
def derived_ids(spark, folder):
    return view(spark, folder, "corpus").select(
        "doc_id",
        derive_id(F.col("document_id"), F.col("position")).alias("segment_id"),
        derive_id(F.col("project_id"), F.col("file_name"), F.sha2("text", 256)).alias("document_id"),
    )


CITATION_SQL = (
    "concat_ws(' · ', project_id, file_name, locator, strftime(document_date, '%d.%m.%Y'))"
)


@query(
    f"""
    SELECT chunk_id, {CITATION_SQL} AS citation,
           {CITATION_SQL} || ' · Version ' || substr(sha256(document_id), 1, 8) AS source_line
    FROM corpus
    """,
    "corpus",
)
def citations(spark, folder):
    shown = citation(*[F.col(c) for c in ("project_id", "file_name", "locator", "document_date")])
    return view(spark, folder, "corpus").select(
        "chunk_id",
        shown.alias("citation"),
        source_line(shown, F.sha2("document_id", 256)).alias("source_line"),
    )


@query(
    """
    SELECT chunk_id, '<quelle id="' || chunk_id || '" datei="' || file_name || '" art="'
           || doc_type || '" stelle="' || locator || '" datum="'
           || coalesce(strftime(document_date, '%Y-%m-%d'), 'unbekannt') || '">' || chr(10)
           || CASE WHEN heading <> '' THEN 'Überschrift: ' || heading || chr(10) ELSE '' END
           || text || chr(10) || '</quelle>' AS block
    FROM corpus
    """,
    "corpus",
)
def source_elements(spark, folder):
    return source_blocks(view(spark, folder, "corpus"))


@query(
    """
    SELECT chunk_id, sha256('passage: ' || CASE WHEN heading <> '' THEN heading || chr(10)
           ELSE '' END || text) AS text_hash
    FROM corpus
    """,
    "corpus",
)
def passage_fingerprints(spark, folder):
    return view(spark, folder, "corpus").select(
        "chunk_id", text_hash(F.col("heading"), F.col("text")).alias("text_hash")
    )


@query(
    """
    SELECT page_id, trim(regexp_replace(url, '[^A-Za-z0-9._-]+', '-', 'g'), '-') AS slug,
           replace(html, '|', '\\|') AS cell,
           replace(format('{:,}', page_id * 12345 + length(html)), ',', '.') AS thousands,
           trim(regexp_replace(replace(lower(html), '–', '-'), '\\s+', ' ', 'g')) AS match_form
    FROM pages
    """
)
def report_formatting(spark, folder):
    pages = table(spark, folder, "pages")
    number = F.col("page_id") * 12345 + F.length("html")
    return pages.select(
        "page_id",
        slug(F.col("url")).alias("slug"),
        table_cell(F.col("html")).alias("cell"),
        thousands(number).alias("thousands"),
        match_form(F.col("html")).alias("match_form"),
    )


# Lines of a page with a font size that depends on their length.
@query(
    """
    WITH lines AS (
        SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)),
            lambda t: {'size': CAST(8 + length(t) % 7 AS DOUBLE), 'text': t}),
            lambda x: trim(x.text) <> '') AS lines FROM documents
    ), sized AS (
        SELECT doc_id, lines, list_max(list_transform(lines, lambda x: x.size)) AS largest FROM lines
    ), ranked AS (
        SELECT doc_id, largest,
               trim(list_filter(lines, lambda x: x.size = largest)[1].text) AS first_text,
               list_max(list_transform(list_filter(lines, lambda x: x.size < largest),
                                       lambda x: x.size)) AS smaller
        FROM sized
    )
    SELECT doc_id, CASE WHEN largest >= smaller * 1.15 AND length(first_text) <= 80
                        THEN first_text END AS heading
    FROM ranked
    """
)
def headings_by_font_size(spark, folder):
    lines = F.transform(
        F.split("text", "\n"),
        lambda t: F.struct(
            (8 + F.length(t) % 7).cast("double").alias("size"), t.alias("text")
        ),
    )
    return table(spark, folder, "documents").select(
        "doc_id", heading_by_font_size(lines).alias("heading")
    )


# ---------------------------------------------------------------- incremental sets

# The state of an earlier run: the texts labelled as good were stored, some in an older form.
STORED_SQL = """
    stored AS (
        SELECT c.chunk_id, CASE WHEN l.toxic = 1 THEN c.text || ' (alt)' ELSE c.text END AS text, c.heading
        FROM corpus c JOIN labels l ON c.doc_id = l.doc_id WHERE l.quality = 1
    )"""


def stored_chunks(spark, folder):
    labels = table(spark, folder, "labels").where("quality = 1").select("doc_id", "toxic")
    return (
        view(spark, folder, "corpus")
        .join(labels, "doc_id")
        .select(
            "chunk_id",
            F.when(F.col("toxic") == 1, F.concat("text", F.lit(" (alt)")))
            .otherwise(F.col("text"))
            .alias("text"),
            "heading",
        )
    )


@query(
    f"""
    WITH {STORED_SQL}
    SELECT chunk_id FROM corpus c
    WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.chunk_id = c.chunk_id AND s.text = c.text)
    """,
    "corpus",
)
def pending_chunks(spark, folder):
    index = stored_chunks(spark, folder).select(
        "chunk_id", text_hash(F.col("heading"), F.col("text")).alias("text_hash")
    )
    return pending_ids(view(spark, folder, "corpus"), index, compare_texts=True)


@query(
    f"""
    WITH {STORED_SQL}
    SELECT chunk_id FROM corpus c WHERE NOT EXISTS
        (SELECT 1 FROM stored s WHERE s.chunk_id = c.chunk_id AND length(s.text) = length(c.text))
    """,
    "corpus",
)
def pending_chunks_by_span(spark, folder):
    span = [F.lit(0).alias("char_start"), F.length("text").alias("char_end")]
    index = stored_chunks(spark, folder).select("chunk_id", *span)
    return pending_ids(view(spark, folder, "corpus").select("chunk_id", *span), index)


@query(
    f"""
    WITH {STORED_SQL}
    SELECT count(*) FILTER (WHERE known) AS skipped, count(*) FILTER (WHERE NOT known) AS pending
    FROM (SELECT c.chunk_id IN (SELECT chunk_id FROM stored) AS known FROM corpus c)
    """,
    "corpus",
)
def ingest_counters(spark, folder):
    known = stored_chunks(spark, folder).select("chunk_id", F.lit(True).alias("known"))
    return (
        view(spark, folder, "corpus")
        .select("chunk_id")
        .join(known, "chunk_id", "left")
        .agg(
            F.count_if(F.col("known").isNotNull()).alias("skipped"),
            F.count_if(F.col("known").isNull()).alias("pending"),
        )
    )


@query(
    f"""
    WITH {STORED_SQL}
    SELECT chunk_id, text FROM stored
    UNION ALL
    SELECT chunk_id, text FROM corpus WHERE chunk_id NOT IN (SELECT chunk_id FROM stored)
    """,
    "corpus",
)
def append_unknown(spark, folder):
    return append_new(
        stored_chunks(spark, folder).select("chunk_id", "text"),
        view(spark, folder, "corpus").select("chunk_id", "text"),
        "chunk_id",
    )


@query(
    f"""
    WITH {STORED_SQL},
    batch AS (SELECT chunk_id, text || ' (neu)' AS text FROM corpus WHERE doc_type = 'de')
    SELECT chunk_id, text FROM batch
    UNION ALL
    SELECT chunk_id, text FROM stored WHERE chunk_id NOT IN (SELECT chunk_id FROM batch)
    """,
    "corpus",
)
def upsert_merge(spark, folder):
    batch = view(spark, folder, "corpus").where("doc_type = 'de'").select(
        "chunk_id", F.concat("text", F.lit(" (neu)")).alias("text")
    )
    return merge_rows(stored_chunks(spark, folder).select("chunk_id", "text"), batch, "chunk_id")


@query(
    f"""
    WITH {STORED_SQL}
    SELECT chunk_id FROM stored WHERE chunk_id NOT IN
        (SELECT chunk_id FROM corpus WHERE document_date IS NOT NULL)
    """,
    "corpus",
)
def stale_index_rows(spark, folder):
    kept = view(spark, folder, "corpus").where(F.col("document_date").isNotNull())
    return stale_ids(stored_chunks(spark, folder), kept)


@query(
    """
    SELECT file_name, chunk_id, project_id, doc_type FROM (
        SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY chunk_id) AS place FROM corpus)
    WHERE place = 1
    """,
    "corpus",
)
def first_version_per_file(spark, folder):
    rows = view(spark, folder, "corpus").select("file_name", "chunk_id", "project_id", "doc_type")
    return first_per_key(rows, "file_name", ["chunk_id"])
