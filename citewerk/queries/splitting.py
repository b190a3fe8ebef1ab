"""The statistical splitter: its model, and the parts of all words of the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from citewerk.functions.compounds import compound_parts
from citewerk.operators import splitter
from citewerk.plans.sample_views import table
from citewerk.queries.registry import query

WORDS_SQL = f"""
    said AS (
        SELECT doc_id, unnest(list) AS word, generate_subscripts(list, 1) AS place
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '\\p{{L}}+') AS list FROM documents)
    ), words AS (
        SELECT DISTINCT word FROM said WHERE length(word) BETWEEN {splitter.SHORTEST} AND {splitter.LONGEST_WORD}
    )"""

MODEL_SQL = f"""
    {WORDS_SQL}, runs AS (
        SELECT word, substr(word, a + 1, k) AS run, a = 0 AS first, a + k = length(word) AS last
        FROM words, range(0, {splitter.LONGEST_WORD}) t(a), range({splitter.SHORTEST}, {splitter.LONGEST} + 1) u(k)
        WHERE a + k <= length(word)
    ), model AS (
        SELECT run, count(*) FILTER (first AND NOT last) AS begins, count(*) FILTER (last AND NOT first) AS ends,
               count(*) FILTER (NOT first AND NOT last) AS inside
        FROM runs GROUP BY run
        HAVING count(*) FILTER (NOT (first AND last)) >= {splitter.LEAST_WORDS}
    )"""

SPLITS_SQL = f"""
    {MODEL_SQL}, shares AS (
        SELECT run, begins / (begins + ends + inside) AS b, ends / (begins + ends + inside) AS e,
               inside / (begins + ends + inside) AS i
        FROM model
    ), splits AS (
        SELECT word, '' AS path, word AS unit FROM words
        UNION ALL
        SELECT word, path || side, CASE side WHEN '1' THEN left(unit, cut) ELSE substr(unit, cut + 1) END
        FROM (
            SELECT word, path, unit, max((score, cut)) AS best, best[1] AS score, best[2] AS cut
            FROM (
                SELECT word, path, unit, cut,
                       max(CASE WHEN a = cut THEN b ELSE -1.0 END)
                       - min(CASE WHEN a < cut AND a + k > cut THEN i ELSE 1.0 END)
                       + max(CASE WHEN a + k = cut OR a + k = cut - 1 AND substr(unit, cut, 1) = 's'
                                  THEN e ELSE -1.0 END) AS score
                FROM splits, range(0, {splitter.LONGEST_WORD}) t(a),
                     range({splitter.SHORTEST}, {splitter.LONGEST} + 1) u(k),
                     range(3, {splitter.LONGEST_WORD} - 2) v(cut), shares
                WHERE length(unit) >= 7 AND a + k <= length(unit) AND cut <= length(unit) - 3
                  AND run = substr(unit, a + 1, k) AND cut BETWEEN a AND a + k + 1
                GROUP BY word, path, unit, cut
            ) GROUP BY word, path, unit
        ), (VALUES ('1'), ('2')) s(side)
        WHERE score >= {splitter.LEAST_SCORE}
          AND least(cut, length(unit) - cut) >= CASE WHEN path = '' THEN 3 ELSE 4 END
    )"""


@query(f"WITH {MODEL_SQL} SELECT run, begins, ends, inside FROM model")
def splitter_model(spark, folder):
    return splitter.learn(splitter.distinct_words(table(spark, folder, "documents"), F.col("text")))


@query(
    f"""
    WITH RECURSIVE {SPLITS_SQL}
    SELECT word, string_agg(unit, ' ' ORDER BY path) AS parts FROM splits WHERE path <> '' GROUP BY word
    """
)
def statistical_splits(spark, folder):
    words = splitter.settled(splitter.distinct_words(table(spark, folder, "documents"), F.col("text")))
    model = splitter.settled(splitter.learn(words))
    return splitter.split_words(words, model).select("word", F.array_join("parts", " ").alias("parts"))


@query(
    f"""
    WITH RECURSIVE {SPLITS_SQL}, firsts AS (
        SELECT doc_id, unit, min((place, path)) AS seen
        FROM said JOIN splits USING (word) WHERE path <> '' GROUP BY 1, 2
    )
    SELECT d.doc_id, coalesce(string_agg(f.unit, ' ' ORDER BY f.seen), '') AS compound_terms
    FROM documents d LEFT JOIN firsts f ON d.doc_id = f.doc_id GROUP BY 1
    """
)
def statistical_terms(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    model = splitter.settled(splitter.learn(splitter.distinct_words(documents, F.col("text"))))
    held = splitter.splitter(model)
    return documents.select("doc_id", compound_parts(F.col("text"), held).alias("compound_terms"))
