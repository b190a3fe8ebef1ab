"""Project-scoped hybrid retrieval: vectors and German full text, fused by rank.

Every function takes the project as a mandatory argument and checks it before
reading. Candidate lists carry ids and ranks only; the chunk columns are fetched
for the few surviving ids, so the scans read one wide column each.

Ties are broken by chunk_id, which makes every list deterministic.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.functions.compounds import NO_PARTS, Parts
from citewerk.functions.ids import require_project_id
from citewerk.functions.tokens import lexeme_counts, question_lexemes
from citewerk.functions.vectors import Encoder, as_matrix, cosine_table, embed_query
from citewerk.operators.postings import SCORERS, Inverted, any_word
from citewerk.operators.ranking import CANDIDATES, POSITION_WEIGHT, ranked
from citewerk.schemas import CHUNK_COLUMNS
from citewerk.sources.tables import restrict
from citewerk.settings import (
    CANDIDATES_PER_METHOD,
    EMBEDDING_DIM,
    RRF_K,
    SEARCH_LIMIT,
)

# Similarities closer than this are equal; below it, only summation order differs.
SIMILARITY_DIGITS = 12
# Found ids, proven by questions x limit to be at most so many, are broadcast.
BROADCAST_HITS = 10_000
# Parts of the index within a project.
SHARDS = 16


def shard_of(chunk_id: Column) -> Column:
    return F.pmod(F.xxhash64(chunk_id), F.lit(SHARDS)).cast("int")


def in_project(index: DataFrame, project_id: str) -> DataFrame:
    return index.where(F.col("project_id") == require_project_id(project_id))


def latest_versions(documents: DataFrame) -> DataFrame:
    """document_id of the last version of each path of a project: the one taken in last, of equal
    times the one with the greatest id. A narrow aggregate with partial maxima."""
    return (
        documents.groupBy("project_id", "source_path")
        .agg(F.max(F.struct("ingested_at", "document_id")).alias("last"))
        .select(F.col("last.document_id").alias("document_id"))
    )


def latest_only(index: DataFrame, documents: DataFrame) -> DataFrame:
    """Index rows of last versions, for searches that leave superseded versions out.

    Candidates are cut to k after this, so k rows of last versions are found wherever there are so many.
    """
    return restrict(index, latest_versions(documents), "document_id")


# ---------------------------------------------------------------- top-k


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, ties by id; exact, whatever the number of ties."""
    if len(scores) > k:
        threshold = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= threshold)
    else:
        near = np.arange(len(scores))
    order = np.lexsort((ids[near], -scores[near]))
    return near[order[:k]]


Scores = Callable[[pa.RecordBatch], np.ndarray]


def _partition_top_k(score: Scores, questions: int, k: int, name: str):
    """mapInArrow body: the k best rows of each partition for every question.

    `score` gives rows x questions for a batch whose first column is the id; NaN means no
    hit. One pass over the rows serves all questions, and a partition hands on at most
    k rows per question, so what is shuffled does not grow with the rows it read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [(np.empty(0, object), np.empty(0)) for _ in range(questions)]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = np.asarray(batch.column(0).to_pylist(), dtype=object)
            table = score(batch)
            for number, (old_ids, old_scores) in enumerate(kept):
                hits = np.flatnonzero(~np.isnan(table[:, number]))
                all_ids = np.concatenate([old_ids, ids[hits]])
                scores = np.concatenate([old_scores, table[hits, number]])
                top = _best(all_ids, scores, k)
                kept[number] = (all_ids[top], scores[top])
        for number, (ids, scores) in enumerate(kept):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([number] * len(ids), pa.int32()),
                        pa.array(ids.tolist(), pa.string()),
                        pa.array(scores, pa.float64(), mask=np.isneginf(scores)),
                    ],
                    names=["question_no", "chunk_id", name],
                )

    return run


def _cosine_scores(vectors: Sequence[Sequence[float]]) -> Scores:
    targets = np.asarray(vectors, dtype=np.float64)

    def score(batch: pa.RecordBatch) -> np.ndarray:
        found = cosine_table(as_matrix(batch.column(1), targets.shape[1]), targets)
        found = np.round(found, SIMILARITY_DIGITS)
        found[np.isnan(found)] = -np.inf  # a zero vector is a candidate, but the last
        return found

    return score


def _lexeme_scores(questions: Sequence[Sequence[str]]) -> Scores:
    words = sorted({w for asked in questions for w in asked})
    wanted = pa.array(words, pa.string())
    asks = np.array([[w in set(asked) for asked in questions] for w in words], dtype=np.float64)

    def score(batch: pa.RecordBatch) -> np.ndarray:
        lists = batch.column(1)
        lengths = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
        rows = np.repeat(np.arange(batch.num_rows), lengths)
        word = pc.index_in(lists.flatten(), value_set=wanted)
        hit = word.is_valid().to_numpy(zero_copy_only=False)
        word = word.drop_null().to_numpy(zero_copy_only=False)
        positions = [
            np.bincount(rows[hit], weights=asks[word, number], minlength=batch.num_rows)
            for number in range(len(questions))
        ]
        table = np.stack(positions, axis=1)
        return np.where(table > 0, table * POSITION_WEIGHT, np.nan)

    return score


def _candidate_type(score: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField("question_no", T.IntegerType()),
            T.StructField("chunk_id", T.StringType()),
            T.StructField(score, T.DoubleType()),
        ]
    )


def vector_candidates(
    index: DataFrame, project_id: str, vectors: Sequence[Sequence[float]], k: int
) -> DataFrame:
    """question_no, chunk_id, similarity, vector_rank: exact nearest neighbours."""
    rows = (
        in_project(index, project_id)
        .where(F.col("embedding").isNotNull())
        .select(F.col("chunk_id").cast("string"), "embedding")
    )
    schema = _candidate_type("similarity")
    if not vectors:
        return index.sparkSession.createDataFrame([], schema).withColumn("vector_rank", F.lit(0))
    scores = _cosine_scores([list(v) for v in vectors])
    near = rows.mapInArrow(_partition_top_k(scores, len(vectors), k, "similarity"), schema)
    return ranked(near, "similarity", "vector_rank", k)


def text_candidates(
    index: DataFrame, project_id: str, questions: Sequence[Sequence[str]], k: int
) -> DataFrame:
    """question_no, chunk_id, text_score, text_rank: lexemes joined by OR.

    `questions` holds the lexemes of each question. Under OR every matching position
    covers itself, so the cover-density rank is a constant times their number. A
    question of stop words only matches nothing.
    """
    asked = [list(words) for words in questions]
    if not any(asked):
        return index.sparkSession.createDataFrame([], CANDIDATES)
    # No filter on the lexemes: where they come from a UDF, it would run a second time.
    rows = in_project(index, project_id).select(F.col("chunk_id").cast("string"), "lexemes")
    best = _partition_top_k(_lexeme_scores(asked), len(asked), k, "text_score")
    found = rows.mapInArrow(best, _candidate_type("text_score"))
    return ranked(found, "text_score", "text_rank", k)


def matches_all(lexemes: Column, wanted: Sequence[str]) -> Column:
    """AND form of the text query: every lexeme must occur."""
    return reduce(
        lambda a, b: a & b, (F.array_contains(lexemes, w) for w in wanted), F.lit(bool(wanted))
    )


# ---------------------------------------------------------------- postings of rows at hand


def postings(index: DataFrame) -> DataFrame:
    """project_id, lexeme, chunk_id, positions: one row per distinct lexeme of a chunk.

    A chunk is one row, so its lexemes are counted where it lies, without a shuffle.
    """
    place = [c for c in ("project_id", "shard") if c in index.columns]
    counted = index.select(*place, "chunk_id", lexeme_counts("lexemes").alias("entries"))
    # Outer, because for the inner form Catalyst adds a filter that runs the UDF again.
    entries = counted.select(*place, "chunk_id", F.inline_outer("entries"))
    return entries.where(F.col("lexeme").isNotNull()).select(
        *place, "lexeme", "chunk_id", "positions"
    )


# ---------------------------------------------------------------- fusion


def rank_points(rank: Column, k: int = RRF_K) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def reciprocal_rank_fusion(rankings: DataFrame, k: int = RRF_K) -> DataFrame:
    """Fuse any number of ranked lists: rows (item, rank) -> (item, score).

    Rows of all lists in one DataFrame; an item scores 1 / (k + rank) per list.
    """
    return rankings.groupBy("item").agg(F.sum(rank_points(F.col("rank"), k)).alias("score"))


def fuse(by_vector: DataFrame, by_text: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """question_no, chunk_id, score, vector_rank, text_rank of the best fused hits.

    Equal scores keep the order of the lists: vector list first, then text only.
    """
    v = by_vector.select("question_no", "chunk_id", "vector_rank")
    t = by_text.select("question_no", "chunk_id", "text_rank")
    points = F.coalesce(rank_points(F.col("vector_rank"), k), F.lit(0.0)) + F.coalesce(
        rank_points(F.col("text_rank"), k), F.lit(0.0)
    )
    order = Window.partitionBy("question_no").orderBy(
        F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("text_rank")
    )
    return (
        v.join(t, ["question_no", "chunk_id"], "full")
        .withColumn("score", points)
        .withColumn("hit_rank", F.row_number().over(order))
        .where(F.col("hit_rank") <= limit)
    )


def fetch_chunks(index: DataFrame, project_id: str, ids: DataFrame, at_most: int) -> DataFrame:
    """Chunk columns of found ids. `at_most` is their proven number: questions x limit.

    One join, lazy like every other plan. A stored index is partitioned by shard, and the
    shard of an id is part of the key, so Spark prunes the scan for the wide text columns
    to the shards that the ids lie in.
    """
    chunks = in_project(index, project_id)
    sharded = "shard" in index.columns
    keyed = ids.withColumn("shard", shard_of(F.col("chunk_id"))) if sharded else ids
    columns = [*CHUNK_COLUMNS, "shard"] if sharded else list(CHUNK_COLUMNS)
    side = F.broadcast(keyed) if at_most <= BROADCAST_HITS else keyed
    found = chunks.select(*columns).join(side, ["chunk_id", "shard"] if sharded else "chunk_id")
    return found.drop("shard")


# ---------------------------------------------------------------- public searches


def vector_search(
    index: DataFrame, *, project_id: str, query_embedding: Sequence[float], limit: int
) -> DataFrame:
    """Nearest chunks of one project with their cosine similarity, best first."""
    require_project_id(project_id)
    near = vector_candidates(index, project_id, [query_embedding], limit).drop("question_no")
    return (
        fetch_chunks(index, project_id, near, limit)
        .orderBy("vector_rank")
        .select(*CHUNK_COLUMNS, "similarity")
    )


def text_search(
    index: DataFrame,
    *,
    project_id: str,
    question: str,
    limit: int,
    lexicon: Parts = NO_PARTS,
    stops: Collection[str] | None = None,
    inverted: Inverted | None = None,
    scorer: str = "any",
) -> DataFrame:
    """Chunks of one project by full text, best first.

    Scorers: `any` (words joined by OR), and over the stored postings `all` (joined by AND, by
    cover density) and `bm25`.
    """
    require_project_id(project_id)
    words = question_lexemes(question, lexicon, stops)
    if inverted is not None:
        found = SCORERS[scorer](inverted, project_id, [words], limit)
    elif scorer == "any":
        found = text_candidates(index, project_id, [words], limit)
    else:
        raise ValueError(f"Scorer {scorer} needs the stored postings")
    return (
        fetch_chunks(index, project_id, found.drop("question_no"), limit)
        .orderBy("text_rank")
        .select(*CHUNK_COLUMNS, F.col("text_score").alias("rank"))
    )


def hybrid_hits(
    index: DataFrame,
    project_id: str,
    questions: Sequence[str],
    encoder: Encoder,
    limit: int,
    candidates: int = CANDIDATES_PER_METHOD,
    dim: int = EMBEDDING_DIM,
    lexicon: Parts = NO_PARTS,
    stops: Collection[str] | None = None,
    inverted: Inverted | None = None,
) -> DataFrame:
    """Fused hits of several questions in one plan: one vector scan, one text scan.

    With `inverted`, the stored postings, the text list reads only blocks that matter.
    """
    require_project_id(project_id)
    vectors = [embed_query(q, encoder, dim) for q in questions]
    words = [question_lexemes(q, lexicon, stops) for q in questions]
    if inverted is None:
        by_text = text_candidates(index, project_id, words, candidates)
    else:
        by_text = any_word(inverted, project_id, words, candidates)
    return fuse(vector_candidates(index, project_id, vectors, candidates), by_text, limit)


def search(
    index: DataFrame,
    *,
    project_id: str,
    question: str,
    encoder: Encoder,
    limit: int = SEARCH_LIMIT,
    candidates: int = CANDIDATES_PER_METHOD,
    dim: int = EMBEDDING_DIM,
    lexicon: Parts = NO_PARTS,
    stops: Collection[str] | None = None,
    inverted: Inverted | None = None,
) -> DataFrame:
    """Hybrid search in one project: chunk columns, score, vector_rank, text_rank."""
    hits = hybrid_hits(
        index, project_id, [question], encoder, limit, candidates, dim, lexicon, stops, inverted
    )
    return (
        fetch_chunks(index, project_id, hits.drop("question_no"), limit)
        .orderBy("hit_rank")
        .select(*CHUNK_COLUMNS, "score", "vector_rank", "text_rank")
    )
