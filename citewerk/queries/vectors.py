"""Vector lists, fusion, hybrid search, evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewerk.functions.compounds import Lexicon
from citewerk.functions.tokens import question_lexemes
from citewerk.functions.vectors import cosine_similarity
from citewerk.operators.evidence import collect_evidence
from citewerk.operators.index import index_rows
from citewerk.operators.retrieval import (
    hybrid_hits,
    reciprocal_rank_fusion,
    search,
    vector_candidates,
)
from citewerk.plans.sample_views import table, view
from citewerk.queries.fixtures import PARTS, QUESTIONS, SEARCHED, STOPS, corpus_chunks, stored_index
from citewerk.queries.fulltext import WORDS_SQL, compounds_sql, lexemes_sql
from citewerk.queries.registry import query
from citewerk.schemas import CHUNK_COLUMNS

DIM = 64


def vector_index(spark, folder):
    return table(spark, folder, "embeddings").select(
        F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("chunk_id"),
        F.lit(SEARCHED).alias("project_id"),
        "embedding",
    )


QUESTION_LABELS = tuple(range(10))


def question_vectors(spark, folder, labels=QUESTION_LABELS) -> list[list[float]]:
    """One question vector per asked label: its first vector."""
    firsts = (
        table(spark, folder, "embeddings")
        .where(F.col("label").isin(*labels))
        .groupBy("label")
        .agg(F.min_by("embedding", "vec_id").alias("embedding"))
    )
    return [list(r.embedding) for r in firsts.orderBy("label").collect()]


class LabelEncoder:
    """Stands in for a model: the n-th question gets the vector of the n-th label."""

    def __init__(self, vectors: list[list[float]]):
        self.by_text = {"query: " + q: v for q, v in zip(QUESTIONS, vectors)}

    def encode(self, texts):
        return [self.by_text[t] for t in texts]


ASKED_SQL = """
    asked AS (
        SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS question_no, q
        FROM (SELECT label, CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS q
              FROM embeddings GROUP BY label)
    )"""

NEAREST_SQL = f"""
    {ASKED_SQL},
    near AS (
        SELECT question_no, lpad(CAST(vec_id AS VARCHAR), 12, '0') AS chunk_id,
               round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 12) AS similarity
        FROM embeddings CROSS JOIN asked
    ), near_ranked AS (
        SELECT *, row_number() OVER (PARTITION BY question_no ORDER BY similarity DESC, chunk_id)
                  AS vector_rank FROM near
    )"""


@query(
    """
    WITH first AS (SELECT CAST(arg_min(embedding, vec_id) AS DOUBLE[]) AS q FROM embeddings)
    SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 6) AS similarity
    FROM embeddings, first
    """
)
def cosine_scores(spark, folder):
    embeddings = table(spark, folder, "embeddings")
    first = embeddings.agg(F.min_by("embedding", "vec_id")).first()[0]
    return embeddings.select(
        "vec_id", F.round(cosine_similarity(F.col("embedding"), first), 6).alias("similarity")
    )


@query(
    f"""
    WITH {NEAREST_SQL}
    SELECT chunk_id, round(similarity, 6) AS similarity, vector_rank FROM near_ranked
    WHERE question_no = 0 AND vector_rank <= 30
    """
)
def vector_top_k(spark, folder):
    index = vector_index(spark, folder)
    near = vector_candidates(index, SEARCHED, question_vectors(spark, folder)[:1], 30)
    return near.select("chunk_id", F.round("similarity", 6).alias("similarity"), "vector_rank")


@query(
    f"""
    WITH {NEAREST_SQL}
    SELECT question_no, chunk_id, round(similarity, 6) AS similarity, vector_rank FROM near_ranked
    WHERE vector_rank <= 30
    """
)
def vector_top_k_batch(spark, folder):
    index = vector_index(spark, folder)
    near = vector_candidates(index, SEARCHED, question_vectors(spark, folder), 30)
    return near.select(
        "question_no", "chunk_id", F.round("similarity", 6).alias("similarity"), "vector_rank"
    )


@query(
    """
    WITH rankings AS (
        SELECT source || '/' || lang AS item, 1 + n_chars % 50 AS rank FROM documents
        UNION ALL SELECT source || '/' || lang, 1 + doc_id % 97 FROM documents
        UNION ALL SELECT source || '/xx', 1 + doc_id % 13 FROM documents
    )
    SELECT item, round(sum(1.0 / (60 + rank)), 9) AS score FROM rankings GROUP BY 1
    """
)
def rank_fusion(spark, folder):
    documents = table(spark, folder, "documents")
    item = F.concat("source", F.lit("/"), "lang")
    rankings = (
        documents.select(item.alias("item"), (1 + F.col("n_chars") % 50).alias("rank"))
        .union(documents.select(item, 1 + F.col("doc_id") % 97))
        .union(documents.select(F.concat("source", F.lit("/xx")), 1 + F.col("doc_id") % 13))
    )
    fused = reciprocal_rank_fusion(rankings)
    return fused.select("item", F.round("score", 9).alias("score"))


# ---------------------------------------------------------------- hybrid

INDEX_TEXT_SQL = f"""
    {WORDS_SQL}, {compounds_sql("word_rows")},
    firsts AS (
        SELECT w.chunk_id, p.part, min((w.place, p.path)) AS seen
        FROM word_rows w JOIN parts p ON w.word = p.word GROUP BY 1, 2
    ), terms AS (
        SELECT chunk_id, string_agg(part, ' ' ORDER BY seen) AS terms FROM firsts GROUP BY 1
    ), source AS (
        SELECT c.chunk_id AS id, c.project_id,
               coalesce(c.heading, '') || ' ' || c.text || ' ' || coalesce(t.terms, '') AS text
        FROM corpus c LEFT JOIN terms t ON c.chunk_id = t.chunk_id
    ), {lexemes_sql("source")}"""


class TextShape:
    """An encoder whose vectors can be told from the text: length, letters e, blanks."""

    def encode(self, texts):
        return [[float(len(t)), float(t.count("e")), float(t.count(" "))] for t in texts]


PASSAGE_SQL = (
    "'passage: ' || CASE WHEN c.heading <> '' THEN c.heading || chr(10) ELSE '' END || c.text"
)


@query(
    f"""
    WITH RECURSIVE {INDEX_TEXT_SQL},
    prints AS (
        SELECT id, count(*) AS positions, sha256(string_agg(lexeme, ' ' ORDER BY place)) AS print
        FROM lexed GROUP BY 1
    ), passages AS (SELECT c.chunk_id, {PASSAGE_SQL} AS passage FROM corpus c)
    SELECT p.chunk_id, coalesce(t.terms, '') AS compound_terms, sha256(p.passage) AS text_hash,
           coalesce(x.positions, 0) AS positions, coalesce(x.print, sha256('')) AS lexeme_hash,
           CAST(length(p.passage) AS DOUBLE) AS length,
           CAST(length(p.passage) - length(replace(p.passage, 'e', '')) AS DOUBLE) AS letters_e,
           CAST(length(p.passage) - length(replace(p.passage, ' ', '')) AS DOUBLE) AS blanks
    FROM passages p LEFT JOIN terms t ON p.chunk_id = t.chunk_id LEFT JOIN prints x ON x.id = p.chunk_id
    """,
    "corpus",
)
def index_build(spark, folder):
    chunks = corpus_chunks(view(spark, folder, "corpus"))
    built = index_rows(chunks, TextShape(), Lexicon(PARTS), 3, stops=STOPS)
    return built.select(
        "chunk_id",
        "compound_terms",
        "text_hash",
        F.size("lexemes").cast("bigint").alias("positions"),
        F.sha2(F.array_join("lexemes", " "), 256).alias("lexeme_hash"),
        *[
            F.get("embedding", i).cast("double").alias(name)
            for i, name in enumerate(("length", "letters_e", "blanks"))
        ],
    )


def asked_words() -> list[list[str]]:
    return [question_lexemes(q, Lexicon(PARTS), STOPS) for q in QUESTIONS]


FUSED_SQL = f"""
    {INDEX_TEXT_SQL}, {ASKED_SQL},
    wanted(question_no, lexeme) AS (VALUES {
        ", ".join(f"({n}, '{w}')" for n, words in enumerate(asked_words()) for w in words)
    }),
    text_ranked AS (
        SELECT *, row_number() OVER (PARTITION BY question_no ORDER BY positions DESC, chunk_id)
                  AS text_rank
        FROM (SELECT w.question_no, x.id AS chunk_id, count(*) AS positions
              FROM lexed x JOIN wanted w ON x.lexeme = w.lexeme JOIN source s ON s.id = x.id
              WHERE s.project_id = '{SEARCHED}' GROUP BY 1, 2)
    ), near_ranked AS (
        SELECT *, row_number() OVER (PARTITION BY question_no ORDER BY similarity DESC, chunk_id)
                  AS vector_rank
        FROM (SELECT a.question_no, c.chunk_id,
                     round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), a.q), 12)
                     AS similarity
              FROM corpus c JOIN embeddings e ON c.doc_id = e.vec_id CROSS JOIN asked a
              WHERE c.project_id = '{SEARCHED}' AND a.question_no < {len(QUESTIONS)})
    ), fused AS (
        SELECT coalesce(v.question_no, t.question_no) AS question_no,
               coalesce(v.chunk_id, t.chunk_id) AS chunk_id, v.vector_rank, t.text_rank,
               coalesce(1.0 / (60 + v.vector_rank), 0.0)
               + coalesce(1.0 / (60 + t.text_rank), 0.0) AS score
        FROM (SELECT * FROM near_ranked WHERE vector_rank <= 30) v
        FULL JOIN (SELECT * FROM text_ranked WHERE text_rank <= 30) t
          ON v.question_no = t.question_no AND v.chunk_id = t.chunk_id
    ), hits AS (
        SELECT *, row_number() OVER (PARTITION BY question_no ORDER BY score DESC,
                  vector_rank NULLS LAST, text_rank NULLS LAST) AS hit_rank FROM fused
    )"""


def encoder(spark, folder):
    return LabelEncoder(question_vectors(spark, folder)[: len(QUESTIONS)])


@query(
    f"""
    WITH RECURSIVE {FUSED_SQL}
    SELECT question_no, chunk_id, round(score, 9) AS score, vector_rank, text_rank, hit_rank
    FROM hits WHERE hit_rank <= 16
    """,
    "corpus",
)
def hybrid_hits_batch(spark, folder):
    stored = stored_index(spark, folder, PARTS)
    hits = hybrid_hits(
        stored.rows,
        SEARCHED,
        QUESTIONS,
        encoder(spark, folder),
        16,
        dim=DIM,
        lexicon=Lexicon(PARTS),
        stops=STOPS,
        inverted=stored.inverted,
    )
    return hits.withColumn("score", F.round("score", 9)).select(
        "question_no", "chunk_id", "score", "vector_rank", "text_rank", "hit_rank"
    )


@query(
    f"""
    WITH RECURSIVE {FUSED_SQL}
    SELECT h.chunk_id, c.project_id, c.file_name, c.locator, c.document_date, c.text,
           round(h.score, 9) AS score, h.vector_rank, h.text_rank
    FROM hits h JOIN corpus c ON h.chunk_id = c.chunk_id
    WHERE question_no = 0 AND hit_rank <= 10
    """,
    "corpus",
)
def hybrid_search(spark, folder):
    stored = stored_index(spark, folder, PARTS)
    hits = search(
        stored.rows,
        project_id=SEARCHED,
        question=QUESTIONS[0],
        encoder=encoder(spark, folder),
        dim=DIM,
        lexicon=Lexicon(PARTS),
        stops=STOPS,
        inverted=stored.inverted,
    )
    return hits.select(
        "chunk_id",
        "project_id",
        "file_name",
        "locator",
        "document_date",
        "text",
        F.round("score", 9).alias("score"),
        "vector_rank",
        "text_rank",
    )


@query(
    f"""
    WITH RECURSIVE {FUSED_SQL}
    SELECT chunk_id, document_date, file_name, CAST(position AS INTEGER) AS "index", locator, text
    FROM corpus WHERE chunk_id IN (SELECT chunk_id FROM hits WHERE hit_rank <= 16)
    """,
    "corpus",
)
def evidence_collection(spark, folder):
    stored = stored_index(spark, folder, PARTS)
    found = collect_evidence(
        stored.rows,
        project_id=SEARCHED,
        encoder=encoder(spark, folder),
        questions=QUESTIONS,
        dim=DIM,
        lexicon=Lexicon(PARTS),
        stops=STOPS,
        inverted=stored.inverted,
    )
    assert tuple(found.columns) == CHUNK_COLUMNS
    return found.select("chunk_id", "document_date", "file_name", "index", "locator", "text")
