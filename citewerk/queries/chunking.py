"""Cut points, spans and chunk tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewerk.functions.chunking import boundary_positions, text_spans
from citewerk.functions.ids import derive_id
from citewerk.operators.chunks import rechunk
from citewerk.plans import canned_sql
from citewerk.plans.sample_views import table, view
from citewerk.queries.registry import query

CUT = "[.!?:;](?:\\n+|\\s+)|\\n+"

# Small limits, so that even short texts are cut several times.
SMALL, SMALL_OVERLAP = 200, 40


def bounds_sql(source: str) -> str:
    """CTE `bounds`: all cut points of each text of `source` (id, text)."""
    return f"""
    cuts AS (
        SELECT id, unnest(regexp_extract_all(text, '{CUT}')) AS separator,
               unnest(regexp_split_to_array(text, '{CUT}')[:-2]) AS piece,
               generate_subscripts(regexp_extract_all(text, '{CUT}'), 1) AS place
        FROM {source}
    ), bounds AS (
        SELECT id, place, CAST(sum(length(piece) + length(separator))
               OVER (PARTITION BY id ORDER BY place) AS INTEGER) AS boundary
        FROM cuts
    )"""


def spans_sql(source: str, max_chars: int, overlap: int) -> str:
    """CTE `spans` (id, char_start, char_end, piece) over `source` (id, text, whole)."""
    return f"""
    {bounds_sql(source)},
    texts AS (
        SELECT s.id, s.text, s.whole, length(s.text) AS n,
               coalesce(b.list, []) AS cuts
        FROM {source} s LEFT JOIN
             (SELECT id, list(boundary ORDER BY boundary) AS list FROM bounds GROUP BY id) b
             ON s.id = b.id
    ), walk AS (
        SELECT id, 0 AS s, CASE WHEN whole OR n <= {max_chars} THEN n ELSE coalesce(
                   list_max(list_filter(cuts, lambda b: b > 0 AND b <= {max_chars})), {max_chars})
               END AS e
        FROM texts
        UNION ALL
        SELECT id, s, CASE WHEN s + {max_chars} >= n THEN n ELSE coalesce(
                   list_max(list_filter(cuts, lambda b: b > s AND b <= s + {max_chars})),
                   s + {max_chars}) END AS e
        FROM (
            SELECT w.id, t.text, t.n, t.cuts, coalesce(
                       list_max(list_filter(t.cuts, lambda b: b > w.s
                           AND b <= greatest(w.e - {overlap}, w.s + 1))),
                       least(w.e, greatest(w.e - {overlap}, w.s + 1) + length(regexp_extract(
                           substr(t.text, greatest(w.e - {overlap}, w.s + 1)), '^\\S*')))) AS s
            FROM walk w JOIN texts t ON w.id = t.id
            WHERE NOT t.whole AND w.s + {max_chars} < t.n
        )
    ), spans AS (
        SELECT id, CASE WHEN keep THEN s WHEN blank THEN e ELSE s + lead END AS char_start,
               CASE WHEN keep OR blank THEN e ELSE e - trail END AS char_end
        FROM (SELECT w.id, w.s, w.e, t.whole OR t.n <= {max_chars} AS keep,
                     regexp_full_match(substr(t.text, w.s + 1, w.e - w.s), '\\s*') AS blank,
                     length(regexp_extract(substr(t.text, w.s + 1, w.e - w.s), '^\\s*')) AS lead,
                     length(regexp_extract(substr(t.text, w.s + 1, w.e - w.s), '\\s*$')) AS trail
              FROM walk w JOIN texts t ON w.id = t.id)
    )"""


@query(
    f"""
    WITH source AS (SELECT doc_id AS id, text FROM documents), {bounds_sql("source")}
    SELECT id AS doc_id, boundary FROM bounds
    """
)
def cut_points(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    cuts = documents.select("doc_id", F.explode_outer(boundary_positions("text")).alias("boundary"))
    return cuts.where(F.col("boundary").isNotNull())


@query(
    f"""
    WITH RECURSIVE source AS (SELECT doc_id AS id, text, false AS whole FROM documents),
    {spans_sql("source", 1200, 150)}
    SELECT id AS doc_id, char_start, char_end,
           sha256(substr(d.text, char_start + 1, char_end - char_start)) AS text_hash
    FROM spans JOIN documents d ON d.doc_id = id
    """
)
def chunk_spans(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return documents.select("doc_id", F.inline_outer(text_spans(F.col("text")))).select(
        "doc_id", "char_start", "char_end", F.sha2("text", 256).alias("text_hash")
    )


@query(
    f"""
    WITH RECURSIVE source AS (
        SELECT doc_id AS id, text, lang = 'es' AS whole FROM documents),
    {spans_sql("source", SMALL, SMALL_OVERLAP)}
    SELECT d.lang AS doc_type, count(*) AS chunks, min(char_end - char_start) AS shortest,
           round(median(char_end - char_start)) AS median, max(char_end - char_start) AS longest
    FROM spans JOIN documents d ON d.doc_id = id GROUP BY 1
    """
)
def chunk_length_distribution(spark, folder):
    documents = table(spark, folder, "documents").select("lang", "text")
    kind = F.when(F.col("lang") == "es", "tabellenzeile").otherwise("seite")
    spans = text_spans(F.col("text"), kind, SMALL, SMALL_OVERLAP)
    chunks = documents.select(F.col("lang").alias("doc_type"), F.explode_outer(spans).alias("s"))
    return canned_sql.length_distribution(chunks.select("doc_type", "s.text"))


@query(
    f"""
    WITH RECURSIVE source AS (
        SELECT document_id || '/' || CAST(turn AS VARCHAR) AS id, text,
               doc_type = 'statusbericht' AS whole, document_id, turn
        FROM minutes),
    {spans_sql("source", SMALL, SMALL_OVERLAP)},
    numbered AS (
        SELECT s.document_id, s.turn, p.char_start, p.char_end, s.text,
               row_number() OVER (PARTITION BY s.document_id ORDER BY s.turn, p.char_start,
                                  p.char_end) - 1 AS place
        FROM spans p JOIN source s ON s.id = p.id
    ), keyed AS (
        SELECT *, substr(sha256(document_id || chr(31) || CAST(turn AS VARCHAR)), 1, 32)
               AS segment_id FROM numbered
    )
    SELECT substr(sha256(segment_id || chr(31) || CAST(place AS VARCHAR)), 1, 32) AS chunk_id,
           segment_id, document_id, CAST(place AS INTEGER) AS "index", char_start, char_end,
           substr(text, char_start + 1, char_end - char_start) AS text,
           'protokoll_' || document_id AS file_name
    FROM keyed
    """,
    "minutes",
)
def chunk_table(spark, folder):
    minutes = view(spark, folder, "minutes")
    segments = minutes.select(
        derive_id(F.col("document_id"), F.col("turn")).alias("segment_id"),
        "document_id",
        "project_id",
        F.col("turn").alias("index"),
        F.when(F.col("doc_type") == "statusbericht", "tabellenzeile")
        .otherwise("abschnitt")
        .alias("kind"),
        F.lit(None).cast("int").alias("page_no"),
        F.concat(F.lit("Abschnitt "), F.col("turn")).alias("locator"),
        F.lit(None).cast("string").alias("heading"),
        "text",
    )
    papers = minutes.select("document_id").distinct().select(
        "document_id",
        F.concat(F.lit("p/"), "document_id").alias("source_path"),
        F.concat(F.lit("protokoll_"), "document_id").alias("file_name"),
        F.lit("protokoll").alias("doc_type"),
        F.lit(None).cast("date").alias("document_date"),
    )
    return rechunk(segments, papers, SMALL, SMALL_OVERLAP).select(
        "chunk_id",
        "segment_id",
        "document_id",
        "index",
        "char_start",
        "char_end",
        "text",
        "file_name",
    )
