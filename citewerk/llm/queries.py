"""Queries of the training-data operators over whole tables, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewerk.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    hard_negatives,
    html_extract,
    jaccard_join,
    lexical_rank,
    lm_score,
    quality,
    secret_scan,
    sentencepiece_codec,
    simhash,
    url_filter,
)
from citewerk.llm.shared import UPPER, id_bucket, settle, table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Lower-cases A-Z only, as the operators do.
SQL_LOWER = "translate({}, '" + UPPER + "', '" + UPPER.lower() + "')"


def query(sql: str | None = None):
    """Register a query under its function name."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


@query(
    f"""
    WITH normal AS (
        SELECT doc_id, {SQL_LOWER.format("coalesce(text, '')")} AS body FROM documents
    ), best AS (
        SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM normal GROUP BY body
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
    FROM normal JOIN best USING (body)
    """
)
def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the copy that stays."""
    return exact_dedup.find_copies(table(spark, folder, "documents"))


_SQL_CONTROL = " + ".join(
    f"(length({{0}}) - length(replace({{0}}, '{mark}', ''))) // {len(mark)}"
    for mark in chat_format.CONTROL
)
_SQL_ESCAPED = (
    "(length({0}) + length({0}) - length(replace({0}, chr(92), '')) + " + _SQL_CONTROL + ")"
)


@query(
    f"""
    WITH rows AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
        FROM conversations
        UNION ALL
        SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
        UNION ALL
        SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    )
    SELECT
        conv_id,
        count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text))
            AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, ''
                          ORDER BY turn, role, text)) AS loss_sha256,
        CAST(sum({_SQL_ESCAPED.format("role")} + {_SQL_ESCAPED.format("text")}
                 + {len(chat_format.TURN) + len(chat_format.END) + 2}) AS BIGINT) AS formatted_chars
    FROM rows
    GROUP BY conv_id
    """
)
def op8_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one of control strings, formatted and read back."""
    rows = table(spark, folder, "conversations").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text"
    )
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema)
    trees = chat_format.chains(rows.unionByName(more))
    formatted = chat_format.format_trees(trees)
    return chat_format.read_back(formatted, "tree_id", in_order=True).withColumnRenamed("tree_id", "conv_id")


@query()
def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document, learnt from the labels that are not held out."""
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"), id_bucket(F.col("doc_id"), 5) != 0)
    scored = docs.select("doc_id", quality.score_column(docs, model).alias("score"))
    return scored.select(
        "doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


@query()
def op1_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and whether they decode to its text."""
    return sentencepiece_codec.encode_and_decode(table(spark, folder, "documents"), ["doc_id"])


@query()
def op2_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Every page with its host, path, rule and verdict."""
    return url_filter.filter_urls(table(spark, folder, "pages"), ["page_id"])


@query()
def op4_html_extract(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, folder, "pages"), ["page_id", "url"])


@query()
def op9_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Log-probability of every document, from those that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = lm_score.score_texts(docs, id_bucket(F.col("doc_id"), 7) != 2)
    return scored.select(
        "doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score",
    )


@query()
def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the benchmark items that leak into it."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return decontaminate.find_leaks(docs, table(spark, folder, "benchmark"), ["doc_id"])


@query()
def op7_ngram_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its component of near copies (3-word shingles, 90 %)."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return jaccard_join.similar_groups(docs, words=3, percent=90)


@query()
def op5_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Every key-like run of every document, with the forest's score and verdict.

    The labelled findings to train from are values assigned to key-like names against plain
    numbers and words.
    """
    docs = table(spark, folder, "documents")
    language = secret_scan.learn_language(docs, "text")
    label = secret_scan.assigned_label(F.col("before"), F.col("candidate"))
    found = settle(secret_scan.described(secret_scan.candidates(docs, ["doc_id"]), ["doc_id"], language, label))
    scored = found.select(
        "doc_id", "start", "end", "candidate_sha256",
        secret_scan.judge_described(found, secret_scan.fit_described(found)).alias("score"),
    )
    return scored.withColumn("is_secret", F.col("score") >= 0.5)


@query()
def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its fingerprint and its component of near copies (4 bits of 64)."""
    return simhash.near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))


_SQL_TERMS = (
    "regexp_extract_all(" + SQL_LOWER.format("coalesce(text, '')")
    + r", '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)


@query(
    f"""
    WITH split AS (
        SELECT doc_id, {_SQL_TERMS} AS terms FROM documents
    ), docs AS (
        SELECT doc_id, terms, len(terms) AS n FROM split WHERE len(terms) > 0
    ), whole AS (
        SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM docs
    ), asked AS (
        SELECT DISTINCT item_id, unnest({_SQL_TERMS}) AS term FROM benchmark
    ), said AS (
        SELECT doc_id, n, unnest(terms) AS term FROM docs
    ), tf AS (
        SELECT doc_id, n, term, count(*) AS tf
        FROM said WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term
    ), df AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM tf, whole GROUP BY term, docs
    ), scores AS (
        SELECT item_id, doc_id,
               CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total)))) AS BIGINT)
                   AS score
        FROM tf JOIN df USING (term) JOIN asked USING (term), whole
        GROUP BY item_id, doc_id
    ), ranks AS (
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
        FROM scores WHERE score > 0
    )
    SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranks WHERE rank <= 10
    """
)
def op12_lexical_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best documents of each benchmark item by damped term weights."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return lexical_rank.best_documents(docs, table(spark, folder, "benchmark"))


@query(
    """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
        FROM embeddings
        WHERE label IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT a.vec_id AS anchor_id, v.vec_id AS vec_id, a.label = v.label AS same,
               CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score
        FROM v AS a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0
    ), positives AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
    )
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM (
        SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
               row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
        FROM positives AS p JOIN scored AS s
          ON p.anchor_id = s.anchor_id AND NOT same
         AND 80 * positive_score <= 100 * score AND score <= positive_score
    )
    WHERE rank <= 5
    """
)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Up to five hard negatives for each of the five positives of every anchor."""
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=turned)
