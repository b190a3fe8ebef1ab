"""Tokens, stems, compounds and full-text lists."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from citewerk.functions import german
from citewerk.functions.compounds import Lexicon, compound_parts, word_parts
from citewerk.functions.tokens import lexemes, question_lexemes, tokens
from citewerk.operators.postings import all_words, any_word, bm25
from citewerk.operators.retrieval import latest_only, matches_all, postings, text_candidates
from citewerk.plans.sample_views import table, view
from citewerk.queries.fixtures import PARTS, QUESTIONS, SEARCHED, STOPS, stored_index
from citewerk.queries.registry import query

TOKENS_SQL = r"""
    list_reduce(list_concat([['']], list_transform(
        regexp_extract_all(lower({t}),
            '\p{{L}}[\p{{L}}\p{{N}}]*(?:-\p{{L}}[\p{{L}}\p{{N}}]*)*|\p{{Nd}}+\p{{L}}[\p{{L}}\p{{N}}]*|[-+]?\p{{Nd}}+(?:\.\p{{Nd}}+)*'),
        lambda w: CASE WHEN w LIKE '_%-%' AND NOT regexp_matches(w, '^[-+\p{{Nd}}]')
                       THEN list_concat([w], string_split(w, '-')) ELSE [w] END)),
        lambda a, b: list_concat(a, b))[2:]"""

V = "aeiouyäöü"


def stems_sql(source: str) -> str:
    """CTE `stems` (word, stem) over `source` (word): the Snowball rules, step by step."""
    return rf"""
    marked AS (
        SELECT word, replace(replace(regexp_replace(replace(word, 'ß', 'ss'),
               '([{V}])([uy])([{V}])', '\1#\2\3', 'g'), '#u', 'U'), '#y', 'Y') AS w
        FROM {source}
    ), first_region AS (
        SELECT *, length(regexp_extract(w, '^[^{V}]*[{V}]+[^{V}]')) AS p1 FROM marked
    ), regions AS (
        SELECT *, CASE WHEN p1 = 0 OR length(w) < 3 THEN 999 ELSE greatest(p1, 3) END AS r1,
               CASE WHEN p1 = 0 OR length(w) < 3 THEN 999
                    WHEN regexp_matches(substr(w, p1 + 1), '^[^{V}]*[{V}]+[^{V}]')
                    THEN p1 + length(regexp_extract(substr(w, p1 + 1), '^[^{V}]*[{V}]+[^{V}]'))
                    ELSE 999 END AS r2
        FROM first_region
    ), cut1 AS (
        SELECT *, regexp_extract(w, '(em|ern|er|e|en|es|s)$') AS s1 FROM regions
    ), done1 AS (
        SELECT word, r1, r2, CASE WHEN s1 = '' OR length(w) - length(s1) < r1 THEN w
               WHEN s1 = 's' AND NOT regexp_matches(w, '[bdfghklmnrt]s$') THEN w
               WHEN s1 IN ('e', 'en', 'es') AND regexp_matches(w, 'niss' || s1 || '$')
               THEN left(w, length(w) - length(s1) - 1)
               ELSE left(w, length(w) - length(s1)) END AS w
        FROM cut1
    ), cut2 AS (
        SELECT *, regexp_extract(w, '(en|er|est|st)$') AS s2 FROM done1
    ), done2 AS (
        SELECT word, r1, r2, CASE WHEN s2 = '' OR length(w) - length(s2) < r1 THEN w
               WHEN s2 = 'st' AND NOT regexp_matches(w, '...[bdfghklmnt]st$') THEN w
               ELSE left(w, length(w) - length(s2)) END AS w
        FROM cut2
    ), cut3 AS (
        SELECT *, regexp_extract(w, '(end|ung|ig|ik|isch|lich|heit|keit)$') AS s3 FROM done2
    ), done3 AS (
        SELECT word, r1, r2, w AS before, left(w, length(w) - length(s3)) AS rest, CASE
               WHEN s3 = '' OR length(w) - length(s3) < r2 THEN 'none'
               WHEN s3 IN ('ig', 'ik', 'isch') AND regexp_matches(w, 'e' || s3 || '$') THEN 'none'
               WHEN s3 IN ('ig', 'ik', 'isch') THEN 'plain' ELSE s3 END AS rule
        FROM cut3
    ), done4 AS (
        SELECT word, CASE
               WHEN rule = 'none' THEN before
               WHEN rule IN ('end', 'ung') AND regexp_matches(rest, '([^e]|^)ig$')
                    AND length(rest) - 2 >= r2 THEN left(rest, length(rest) - 2)
               WHEN rule IN ('lich', 'heit') AND regexp_matches(rest, '(er|en)$')
                    AND length(rest) - 2 >= r1 THEN left(rest, length(rest) - 2)
               WHEN rule = 'keit' AND regexp_matches(rest, 'lich$')
                    THEN CASE WHEN length(rest) - 4 >= r2 THEN left(rest, length(rest) - 4)
                         ELSE rest END
               WHEN rule = 'keit' AND regexp_matches(rest, 'ig$') AND length(rest) - 2 >= r2
                    THEN left(rest, length(rest) - 2)
               ELSE rest END AS w
        FROM done3
    ), stems AS (
        SELECT word, CASE WHEN regexp_matches(word, '\p{{Nd}}') THEN word
               ELSE translate(w, 'UYäöü', 'uyaou') END AS stem FROM done4
    )"""


def lexemes_sql(source: str) -> str:
    """CTE `lexed` (id, place, lexeme) over `source` (id, text); stop words left out."""
    stops = ", ".join(f"'{s}'" for s in STOPS)
    return f"""
    token_lists AS (SELECT id, {TOKENS_SQL.format(t="text")} AS list FROM {source}),
    token_rows AS (
        SELECT id, unnest(list) AS word, generate_subscripts(list, 1) AS place FROM token_lists
    ), vocabulary AS (SELECT DISTINCT word FROM token_rows),
    {stems_sql("vocabulary")},
    lexed AS (
        SELECT r.id, r.place, s.stem AS lexeme
        FROM token_rows r JOIN stems s ON r.word = s.word WHERE r.word NOT IN ({stops})
    )"""


SOURCE_SQL = (
    "source AS (SELECT chunk_id AS id, project_id, coalesce(heading, '') || ' ' || text AS text "
    "FROM corpus)"
)


def lexed_corpus(spark, folder):
    corpus = view(spark, folder, "corpus").select("chunk_id", "project_id", "heading", "text")
    searched = F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.col("text"))
    return corpus.select("chunk_id", "project_id", lexemes(searched, STOPS).alias("lexemes"))


def asked() -> list[list[str]]:
    return [question_lexemes(q, stops=STOPS) for q in QUESTIONS]


@query(
    f"""
    WITH token_lists AS (SELECT doc_id, {TOKENS_SQL.format(t="text")} AS list FROM documents)
    SELECT doc_id, len(list) AS tokens, sha256(array_to_string(list, ' ')) AS fingerprint
    FROM token_lists
    """
)
def token_lists(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return documents.select("doc_id", tokens("text").alias("list")).select(
        "doc_id",
        F.size("list").alias("tokens"),
        F.sha2(F.array_join("list", " "), 256).alias("fingerprint"),
    )


@query(
    f"""
    WITH token_lists AS (SELECT {TOKENS_SQL.format(t="text")} AS list FROM documents),
    vocabulary AS (SELECT DISTINCT unnest(list) AS word FROM token_lists),
    {stems_sql("vocabulary")}
    SELECT word, stem FROM stems
    """
)
def word_stems(spark, folder):
    documents = table(spark, folder, "documents").select("text")
    words = documents.select(F.explode_outer(tokens("text")).alias("word")).distinct()
    words = words.where(F.col("word").isNotNull())
    digits = F.col("word").rlike(r"\p{Nd}")
    return words.select(
        "word",
        F.when(digits, F.col("word")).otherwise(german.stem_words("word")).alias("stem"),
    )


@query(
    f"""
    WITH {SOURCE_SQL}, {lexemes_sql("source")}
    SELECT s.id AS chunk_id, count(lexeme) AS positions,
           sha256(coalesce(string_agg(lexeme, ' ' ORDER BY place), '')) AS fingerprint
    FROM source s LEFT JOIN lexed x ON s.id = x.id GROUP BY 1
    """,
    "corpus",
)
def text_vectors(spark, folder):
    return lexed_corpus(spark, folder).select(
        "chunk_id",
        F.size("lexemes").cast("bigint").alias("positions"),
        F.sha2(F.array_join("lexemes", " "), 256).alias("fingerprint"),
    )


def words_sql(questions: list[list[str]]) -> str:
    return ", ".join(f"({n}, '{w}')" for n, words in enumerate(questions) for w in words)


def question_rows_sql() -> str:
    return words_sql(asked())


RANKED_SQL = f"""
    WITH {SOURCE_SQL}, {lexemes_sql("source")},
    wanted(question_no, lexeme) AS (VALUES {question_rows_sql()}),
    scored AS (
        SELECT w.question_no, x.id AS chunk_id, count(*) AS positions
        FROM lexed x JOIN wanted w ON x.lexeme = w.lexeme JOIN source s ON s.id = x.id
        WHERE s.project_id = '{SEARCHED}' GROUP BY 1, 2
    ), ranked AS (
        SELECT question_no, chunk_id, round(positions * 0.1, 6) AS text_score,
               row_number() OVER (PARTITION BY question_no ORDER BY positions DESC, chunk_id)
                   AS text_rank
        FROM scored
    )
    SELECT question_no, chunk_id, text_score, text_rank FROM ranked WHERE text_rank <= 30
    """


@query(RANKED_SQL, "corpus")
def fulltext_top_k(spark, folder):
    found = text_candidates(lexed_corpus(spark, folder), SEARCHED, asked(), 30)
    return found.select("question_no", "chunk_id", F.round("text_score", 6).alias("text_score"), "text_rank")


@query(RANKED_SQL, "corpus")
def fulltext_top_k_from_postings(spark, folder):
    """The same lists from stored blocks, of which only those that may hold a best chunk are read."""
    found = any_word(stored_index(spark, folder, None).inverted, SEARCHED, asked(), 30)
    return found.select("question_no", "chunk_id", F.round("text_score", 6).alias("text_score"), "text_rank")


# Questions of several words, joined by AND.
PHRASES = ("the nation", "erung und über", "and inghere the", "der in")


def phrases() -> list[list[str]]:
    return [question_lexemes(q, stops=STOPS) for q in PHRASES]


@query(
    f"""
    WITH {SOURCE_SQL}, {lexemes_sql("source")},
    wanted(question_no, lexeme) AS (VALUES {words_sql(phrases())}),
    needed AS (SELECT question_no, count(*) AS words FROM wanted GROUP BY 1),
    said AS (
        SELECT w.question_no, x.id, x.place, x.lexeme,
               row_number() OVER (PARTITION BY w.question_no, x.id ORDER BY x.place) AS nth
        FROM lexed x JOIN wanted w USING (lexeme) JOIN source s ON s.id = x.id
        WHERE s.project_id = '{SEARCHED}'
    ), last AS (
        SELECT e.question_no, e.id, e.place AS q, e.nth, w.lexeme,
               (SELECT max(b.place) FROM said b WHERE b.question_no = e.question_no AND b.id = e.id
                AND b.lexeme = w.lexeme AND b.place <= e.place) AS p
        FROM said e JOIN wanted w ON e.question_no = w.question_no
    ), ends AS (
        SELECT question_no, id, q, nth, min(p) AS p
        FROM last JOIN needed USING (question_no) WHERE p IS NOT NULL
        GROUP BY question_no, id, q, nth, words HAVING count(*) = words
    ), covers AS (
        SELECT question_no, id, p, min(q) AS q, min(nth) AS nth FROM ends GROUP BY 1, 2, 3
    ), scored AS (
        SELECT c.question_no, c.id AS chunk_id,
               round(sum(0.1 / (1 + c.q - c.p - (c.nth - s.nth))), 6) AS text_score
        FROM covers c JOIN said s ON s.question_no = c.question_no AND s.id = c.id AND s.place = c.p
        GROUP BY 1, 2
    )
    SELECT question_no, chunk_id, text_score FROM scored
    """,
    "corpus",
)
def cover_density_ranks(spark, folder):
    """Every chunk that holds all words of a question, by cover density from stored places."""
    found = all_words(stored_index(spark, folder, None).inverted, SEARCHED, phrases(), 1 << 30)
    return found.select("question_no", "chunk_id", F.round("text_score", 6).alias("text_score"))


@query(
    f"""
    WITH {SOURCE_SQL}, {lexemes_sql("source")},
    wanted(question_no, lexeme) AS (VALUES {question_rows_sql()}),
    own AS (SELECT id, lexeme FROM lexed JOIN source USING (id) WHERE project_id = '{SEARCHED}'),
    whole AS (
        SELECT (SELECT count(*) FROM source WHERE project_id = '{SEARCHED}') AS chunks, count(*) AS total FROM own
    ), size AS (SELECT id, count(*) AS size FROM own GROUP BY 1),
    df AS (SELECT lexeme, count(DISTINCT id) AS n FROM own GROUP BY 1),
    tf AS (SELECT id, lexeme, count(*) AS c FROM own GROUP BY 1, 2),
    scored AS (
        SELECT question_no, id AS chunk_id, sum(
            ln(1 + (chunks - n + 0.5) / (n + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * size * chunks / total))
        ) AS text_score
        FROM tf JOIN wanted USING (lexeme) JOIN df USING (lexeme) JOIN size USING (id), whole GROUP BY 1, 2
    ), ranked AS (
        SELECT question_no, chunk_id, round(text_score, 6) AS text_score, row_number() OVER (
            PARTITION BY question_no ORDER BY round(text_score, 9) DESC, chunk_id) AS text_rank
        FROM scored
    )
    SELECT * FROM ranked WHERE text_rank <= 30
    """,
    "corpus",
)
def bm25_top_k(spark, folder):
    found = bm25(stored_index(spark, folder, None).inverted, SEARCHED, asked(), 30)
    return found.select("question_no", "chunk_id", F.round("text_score", 6).alias("text_score"), "text_rank")


@query(
    f"""
    WITH {SOURCE_SQL}, {lexemes_sql("source")}
    SELECT s.project_id, x.lexeme, x.id AS chunk_id, CAST(count(*) AS INTEGER) AS positions
    FROM lexed x JOIN source s ON s.id = x.id GROUP BY 1, 2, 3
    """,
    "corpus",
)
def inverted_index(spark, folder):
    return postings(lexed_corpus(spark, folder))


@query(
    f"""
    WITH {SOURCE_SQL}, {lexemes_sql("source")}
    SELECT id AS chunk_id FROM lexed
    WHERE lexeme IN ({", ".join(f"'{w}'" for w in question_lexemes("erung über", stops=STOPS))})
    GROUP BY 1 HAVING count(DISTINCT lexeme) = {len(question_lexemes("erung über", stops=STOPS))}
    """,
    "corpus",
)
def fulltext_all_words(spark, folder):
    wanted = question_lexemes("erung über", stops=STOPS)
    return lexed_corpus(spark, folder).where(matches_all(F.col("lexemes"), wanted)).select("chunk_id")


# Versions: every third document is an earlier state of the one before it.
VERSIONED_SQL = """
    papers AS (
        SELECT document_id, chunk_id, project_id, 'path/' || CAST(doc_id - doc_id % 3 AS VARCHAR) AS source_path,
               TIMESTAMP '2026-01-01' - INTERVAL 1 DAY * (doc_id % 3 // 2) AS ingested_at
        FROM corpus
    ), newest AS (
        SELECT max((ingested_at, document_id))[2] AS document_id FROM papers GROUP BY project_id, source_path
    )"""


@query(
    f"""
    WITH {SOURCE_SQL}, {lexemes_sql("source")}, {VERSIONED_SQL},
    wanted(question_no, lexeme) AS (VALUES {question_rows_sql()}),
    scored AS (
        SELECT w.question_no, x.id AS chunk_id, count(*) AS positions
        FROM lexed x JOIN wanted w USING (lexeme) JOIN papers p ON p.chunk_id = x.id
        WHERE p.project_id = '{SEARCHED}' AND p.document_id IN (SELECT document_id FROM newest) GROUP BY 1, 2
    )
    SELECT question_no, chunk_id, round(CAST(positions AS DOUBLE) * 0.1, 6) AS text_score, text_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY question_no ORDER BY positions DESC, chunk_id) AS text_rank
          FROM scored) WHERE text_rank <= 30
    """,
    "corpus",
)
def latest_versions_top_k(spark, folder):
    """Full text over last versions only, resolved before the lists are cut."""
    number = F.col("doc_id")
    days = F.floor(number % 3 / 2).cast("int")
    papers = view(spark, folder, "corpus").select(
        "document_id", "project_id",
        F.concat(F.lit("path/"), (number - number % 3).cast("string")).alias("source_path"),
        (F.date_sub(F.lit("2026-01-01").cast("date"), days)).cast("timestamp").alias("ingested_at"),
    )
    stored = stored_index(spark, folder, None)
    only = latest_only(stored.rows, papers).select("chunk_id")
    found = any_word(replace(stored.inverted, only=only), SEARCHED, asked(), 30)
    return found.select("question_no", "chunk_id", F.round("text_score", 6).alias("text_score"), "text_rank")


# ---------------------------------------------------------------- compounds

LEXICON_SQL = "lexicon(part) AS (VALUES " + ", ".join(f"('{p}')" for p in PARTS) + ")"


def compounds_sql(words: str) -> str:
    """CTE `parts` (word, path, part): pre-order of the recursive cuts of `words` (word).

    A path gets '1' for a left and '2' for a right side, so its order is reading order.
    """
    return f"""
    {LEXICON_SQL},
    cut_all AS (
        SELECT u.unit, i AS cut, left(u.unit, i) AS l, substr(u.unit, i + 1) AS r
        FROM (SELECT DISTINCT word AS unit FROM {words} UNION SELECT part FROM lexicon
              UNION SELECT part || 's' FROM lexicon) u,
             range(3, greatest(length(u.unit) - 2, 3)) t(i)
        WHERE length(u.unit) >= 7
    ), cut_known AS (
        SELECT unit, cut, l, r FROM cut_all WHERE r IN (SELECT part FROM lexicon)
          AND (l IN (SELECT part FROM lexicon) OR l IN (SELECT part || 's' FROM lexicon))
    ), sides AS (
        SELECT unit, level, side, part FROM (
            SELECT unit, 0 AS level, arg_max(l, cut) AS a, arg_max(r, cut) AS b
            FROM cut_known GROUP BY unit
            UNION ALL
            SELECT unit, 1, arg_max(l, cut), arg_max(r, cut) FROM cut_known
            WHERE length(l) >= 4 AND length(r) >= 4 GROUP BY unit
        ), LATERAL (VALUES ('1', a), ('2', b)) x(side, part)
    ), parts AS (
        SELECT w.word, s.side AS path, s.part FROM (SELECT DISTINCT word FROM {words}) w
        JOIN sides s ON s.unit = w.word AND s.level = 0
        UNION ALL
        SELECT p.word, p.path || s.side, s.part FROM parts p
        JOIN sides s ON s.unit = p.part AND s.level = 1
    )"""


WORDS_SQL = (
    "word_rows AS (SELECT chunk_id, unnest(list) AS word, generate_subscripts(list, 1) AS place "
    "FROM (SELECT chunk_id, regexp_extract_all(lower(coalesce(heading, '') || ' ' || text), "
    "'\\p{L}+') AS list FROM corpus))"
)


@query(
    f"""
    WITH RECURSIVE {WORDS_SQL}, {compounds_sql("word_rows")}
    SELECT word, string_agg(part, ' ' ORDER BY path) AS parts FROM parts GROUP BY word
    """,
    "corpus",
)
def compound_splits(spark, folder):
    corpus = view(spark, folder, "corpus")
    searched = F.lower(F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.col("text")))
    words = corpus.select(
        F.explode(F.regexp_extract_all(searched, F.lit(r"\p{L}+"), F.lit(0))).alias("word")
    ).distinct()
    split = words.select("word", word_parts(F.col("word"), Lexicon(PARTS)).alias("parts"))
    return split.where(F.size("parts") > 0).withColumn("parts", F.array_join("parts", " "))


@query(
    f"""
    WITH RECURSIVE {WORDS_SQL}, {compounds_sql("word_rows")},
    firsts AS (
        SELECT w.chunk_id, p.part, min((w.place, p.path)) AS seen
        FROM word_rows w JOIN parts p ON w.word = p.word GROUP BY 1, 2
    )
    SELECT c.chunk_id, coalesce(string_agg(f.part, ' ' ORDER BY f.seen), '') AS compound_terms
    FROM corpus c LEFT JOIN firsts f ON c.chunk_id = f.chunk_id GROUP BY 1
    """,
    "corpus",
)
def compound_terms(spark, folder):
    corpus = view(spark, folder, "corpus").select("chunk_id", "heading", "text")
    searched = F.concat(F.coalesce("heading", F.lit("")), F.lit(" "), F.col("text"))
    return corpus.select(
        "chunk_id", compound_parts(searched, Lexicon(PARTS)).alias("compound_terms")
    )
