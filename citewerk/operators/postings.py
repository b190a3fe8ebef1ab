"""The inverted index in blocks: stored beside the retrieval index, read by every text search.

A row holds entries of one lexeme in one bucket of chunks: their ids, the sequence number of
the chunk rows they belong to, chunk sizes and places, and in front of them the greatest number of
places. Rows of the empty lexeme count the chunks and the lexemes of a shard; replaced and removed
chunks are counted with minus one, so document frequency and mean length are sums. A write only
appends, and makes blocks inside the tasks that read the stored rows, without a shuffle.

A search reads the narrow columns of the lexemes asked for first. The greatest counts of a bucket
add up to a bound of its scores, and some chunk reaches each of them, so the k-th best of these is a
lower bound of the k-th score: entries are read of the buckets that may reach it, and of no others.
Entries of chunks that were replaced since may hold such a count; with r of those the (k + r)-th
best is taken. Ties are kept, so the list is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.functions.ids import require_project_id
from citewerk.operators.ranking import CANDIDATES, POSITION_WEIGHT, ranked
from citewerk.sources import storage
from citewerk.sources.tables import is_small, restrict

#: Buckets of a project; a multiple of the shards, so that each lies within one shard.
BUCKETS = 256
#: Blocks are made of so many lexemes at a time, or of one chunk.
BLOCK_TOKENS = 1 << 21
#: Buckets that survive, one row for each question, are broadcast up to so many rows.
BROADCAST_BUCKETS = 1 << 18
# Usual constants of BM25.
BM25_K1, BM25_B = 1.2, 0.75

BLOCKS = T.StructType(
    [
        T.StructField("project_id", T.StringType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("lexeme", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
        T.StructField("n", T.LongType()),
        T.StructField("total", T.LongType()),
        T.StructField("most", T.IntegerType()),
        T.StructField("chunk_ids", T.ArrayType(T.StringType())),
        T.StructField("seqs", T.ArrayType(T.LongType())),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("places", T.ArrayType(T.ArrayType(T.IntegerType()))),
    ]
)


@dataclass(frozen=True)
class Inverted:
    """Stored blocks, and what was replaced or removed since: chunk_id, before (null: nothing).

    With `only` (chunk_id), entries of other chunks do not count, as in a search of last versions.
    """

    blocks: DataFrame
    gone: DataFrame | None = None
    only: DataFrame | None = None


def bucket_of(chunk_id: Column) -> Column:
    return F.pmod(F.xxhash64(chunk_id), F.lit(BUCKETS)).cast("int")


def blocks(index: DataFrame) -> DataFrame:
    """Rows of BLOCKS for index rows (project_id, shard, chunk_id, seq, lexemes, places).

    Blocks are made where the rows lie, of `BLOCK_TOKENS` lexemes at a time: a lexeme and a bucket may
    have several. Nothing is shuffled, so rows that lie by shard give few and large blocks.
    """
    return index.select(
        "project_id", "shard", bucket_of(F.col("chunk_id")).alias("bucket"), "chunk_id", "seq", "lexemes", "places"
    ).mapInArrow(_inverted, BLOCKS)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body of `blocks`."""
    held: list[pa.RecordBatch] = []
    tokens = 0
    for batch in batches:
        lengths = pc.fill_null(pc.list_value_length(batch.column("lexemes")), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            read = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, read + BLOCK_TOKENS - tokens, side="right")))
            held.append(batch.slice(at, stop - at))
            tokens += int(ends[stop - 1]) - read
            at = stop
            if tokens >= BLOCK_TOKENS or at < batch.num_rows:
                yield _blocks_of(held)
                held, tokens = [], 0
    if held:
        yield _blocks_of(held)


def _blocks_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The blocks of some index rows, by project, shard, lexeme and bucket, and the counts of each shard."""
    rows = pa.Table.from_batches(held).sort_by([(c, "ascending") for c in ("project_id", "shard", "bucket", "chunk_id", "seq")])
    rows = rows.combine_chunks()
    project, shard, bucket, chunk, seq, words, places = (rows.column(c).combine_chunks() for c in rows.column_names)
    sizes, placed = (pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in (words, places))
    if not np.array_equal(sizes, placed):
        raise ValueError("Every lexeme of a chunk needs one place")
    known = words.flatten().dictionary_encode()
    order = pc.array_sort_indices(known.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))

    def changes(*columns: np.ndarray) -> np.ndarray:
        """Where a run of equal values begins."""
        new = np.zeros(len(columns[0]), bool)
        new[:1] = True
        for column in columns:
            new[1:] |= column[1:] != column[:-1]
        return new

    buckets, shards = bucket.to_numpy(zero_copy_only=False), shard.to_numpy(zero_copy_only=False)
    names = project.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    lies = np.cumsum(changes(names, shards)) - 1  # number of the project and shard of a row
    row = np.repeat(np.arange(len(sizes)), sizes)
    word = rank[known.indices.to_numpy(zero_copy_only=False)] if len(row) else np.empty(0, np.int64)
    # rows are in order of buckets and ids, places of a row in order: a stable sort keeps both
    sort = np.argsort((lies[row] * max(1, len(order)) + word) * len(sizes) + row, kind="stable")
    row, word = row[sort], word[sort]
    entries = np.flatnonzero(changes(lies[row], word, row))
    entry_row, entry_word = row[entries], word[entries]
    counts = np.diff(np.append(entries, len(row)))
    starts = np.flatnonzero(changes(lies[entry_row], entry_word, buckets[entry_row]))
    first = entry_row[starts]
    whole = np.flatnonzero(changes(lies))  # one row more for each shard

    def lists(values: pa.Array) -> pa.Array:
        ends = np.concatenate([starts, np.full(len(whole) + 1, len(entries))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    at = pa.array(np.concatenate([first, whole]))
    zeros = np.zeros(len(whole), np.int64)
    texts = pc.take(pc.take(known.dictionary, pa.array(order)), pa.array(entry_word[starts]))
    own = pc.take(places.flatten(), pa.array(sort))
    own = pa.ListArray.from_arrays(pa.array(np.append(entries, len(row)), pa.int32()), own)
    columns = {
        "project_id": pc.take(project, at),
        "shard": pc.take(shard, at),
        "lexeme": pa.concat_arrays([texts, pa.array([""] * len(whole), texts.type)]),
        "bucket": np.concatenate([buckets[first], zeros - 1]),
        "n": np.concatenate([np.diff(np.append(starts, len(entries))), np.diff(np.append(whole, len(sizes)))]),
        "total": np.concatenate([np.zeros(len(starts), np.int64), np.add.reduceat(sizes.astype(np.int64), whole)]),
        "most": np.concatenate([np.maximum.reduceat(counts, starts) if len(starts) else counts, zeros]),
        "chunk_ids": lists(pc.take(chunk, pa.array(entry_row))),
        "seqs": lists(pc.take(seq, pa.array(entry_row))),
        "sizes": lists(pa.array(sizes[entry_row], pa.int32())),
        "places": lists(own),
    }
    types = {"shard": pa.int32(), "bucket": pa.int32(), "n": pa.int64(), "total": pa.int64(), "most": pa.int32()}
    return pa.RecordBatch.from_pydict(
        {c: pa.array(v, types[c]) if isinstance(v, np.ndarray) else v for c, v in columns.items()}
    )


def _counted_out(index: DataFrame) -> DataFrame:
    """Minus the chunks that hold a lexeme, and minus the chunks and lexemes of a shard."""
    places = index.select("project_id", "shard", F.explode(F.array_distinct("lexemes")).alias("lexeme"), F.lit(0).alias("size"))
    whole = index.select("project_id", "shard", F.lit("").alias("lexeme"), F.size("lexemes").alias("size"))
    return (
        places.unionByName(whole)
        .groupBy("project_id", "shard", "lexeme")
        .agg((-F.count("*")).alias("n"), (-F.sum("size")).alias("total"))
        .select(
            "project_id", "shard", "lexeme", F.lit(-1).alias("bucket"), "n", "total", F.lit(0).alias("most"),
            *[F.array().cast(BLOCKS[c].dataType).alias(c) for c in ("chunk_ids", "seqs", "sizes", "places")],
        )
    )


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """Files are ordered by lexeme, so that row groups of other lexemes are skipped."""
    (
        rows.select(*BLOCKS.fieldNames())
        .sortWithinPartitions("project_id", "shard", "lexeme", "bucket")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", storage.COMPRESSION)
        .partitionBy("project_id", "shard")
        .parquet(path)
    )


def append(index: DataFrame, path: str) -> None:
    """Store the entries of new index rows, which lie by project and shard as a stored index does."""
    _write(blocks(index), path, "append")


def count_out(index: DataFrame, path: str) -> None:
    """Take index rows that are about to be replaced or removed out of the statistics."""
    _write(_counted_out(index).hint("rebalance", "project_id", "shard"), path, "append")


def replace(index: DataFrame, path: str) -> None:
    """Write the shards that `index` has rows of anew, and no others."""
    _write(blocks(index).hint("rebalance", "project_id", "shard"), path, "overwrite")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    if not storage.has_data(spark, path):
        return spark.createDataFrame([], BLOCKS)
    return spark.read.schema(BLOCKS).parquet(path).select(*BLOCKS.fieldNames())


# ---------------------------------------------------------------- search


def _asked(inverted: Inverted, project_id: str, questions: Sequence[Sequence[str]]) -> tuple[DataFrame, Column]:
    """Blocks of the lexemes asked for, and the questions that ask for a block's lexeme."""
    askers: dict[str, list[int]] = {}
    for number, words in enumerate(questions):
        for word in dict.fromkeys(words):
            askers.setdefault(word, []).append(number)
    rows = inverted.blocks.where(F.col("project_id") == require_project_id(project_id))
    by_word = F.create_map(
        *[c for w, ns in askers.items() for c in (F.lit(w), F.array(*[F.lit(n) for n in ns]))]
    )
    return rows.where(F.col("lexeme").isin(list(askers))), F.explode(by_word[F.col("lexeme")]).alias("question_no")


def _live(entries: DataFrame, inverted: Inverted) -> DataFrame:
    if inverted.only is not None:
        entries = restrict(entries, inverted.only, "chunk_id")
    if inverted.gone is None:
        return entries
    gone = inverted.gone.select(F.col("chunk_id").alias("_gone"), "before")
    side = F.broadcast(gone) if is_small(gone) else gone
    dead = (F.col("chunk_id") == F.col("_gone")) & (F.col("seq") < F.col("before"))
    return entries.join(side, dead, "left_anti")


def _entries(rows: DataFrame) -> DataFrame:
    """question_no, lexeme, chunk_id, seq, size, places: one row for each entry."""
    zipped = F.arrays_zip("chunk_ids", "seqs", "sizes", "places")
    names = F.col("item")
    return rows.select("question_no", "lexeme", F.explode(zipped).alias("item")).select(
        "question_no", "lexeme", names["chunk_ids"].alias("chunk_id"), names["seqs"].alias("seq"),
        names["sizes"].alias("size"), names["places"].alias("places"),
    )


def reachable(rows: DataFrame, questions: Column, k: int, replaced: int = 0) -> DataFrame:
    """(question_no, bucket) of the buckets that may hold one of the k best sums of counts."""
    counts = rows.select("lexeme", "bucket", "most").where(F.col("most") > 0)
    counts = counts.groupBy("lexeme", "bucket").agg(F.max("most").alias("most"))
    bounds = (
        counts.select("bucket", "most", questions)
        .groupBy("question_no", "bucket")
        .agg(F.sum("most").alias("bound"), F.max("most").alias("reached"))
    )
    nth = k + replaced
    # one array for each question, of at most BUCKETS numbers
    floors = bounds.groupBy("question_no").agg(F.sort_array(F.collect_list("reached"), asc=False).alias("all"))
    least = F.coalesce(F.try_element_at("all", F.lit(nth)), F.lit(0))
    return (
        bounds.join(F.broadcast(floors.select("question_no", least.alias("least"))), "question_no")
        .where(F.col("bound") >= F.col("least"))
        .select("question_no", "bucket")
    )


def any_word(inverted: Inverted, project_id: str, questions: Sequence[Sequence[str]], k: int) -> DataFrame:
    """question_no, chunk_id, text_score, text_rank: words joined by OR, exact."""
    if not any(questions):
        return inverted.blocks.sparkSession.createDataFrame([], CANDIDATES)
    rows, askers = _asked(inverted, project_id, questions)
    replaced = inverted.gone.count() if inverted.gone is not None else 0
    if inverted.only is not None:
        replaced = 1 << 20  # any count may be that of a chunk that is left out: no bucket is ruled out
    wanted = reachable(rows, askers, k, replaced)
    if len(questions) * BUCKETS <= BROADCAST_BUCKETS:
        wanted = F.broadcast(wanted)
    kept = rows.select("lexeme", "bucket", "chunk_ids", "seqs", "sizes", "places", askers).join(
        wanted, ["question_no", "bucket"], "left_semi"
    )
    scored = (
        _live(_entries(kept), inverted)
        .groupBy("question_no", "chunk_id")
        .agg((F.sum(F.size("places")) * F.lit(POSITION_WEIGHT)).alias("text_score"))
    )
    return ranked(scored, "text_score", "text_rank", k)


@F.arrow_udf(T.DoubleType())
def cover_density(places: pa.Array) -> pa.Array:
    """Rank of a text by its covers: the places of each word asked for -> the sum over all shortest
    stretches that hold every word, of the weight of a place over one plus the other places in them."""
    return pa.array([_covers(lists) for lists in places.to_pylist()], pa.float64())


def _covers(lists: list[list[int]]) -> float:
    order = sorted((place, word) for word, own in enumerate(lists) for place in own)
    last, at, score = {}, 0, 0.0
    for end, (place, word) in enumerate(order):
        last[word] = end
        if len(last) < len(lists):
            continue
        start = min(last.values())
        # the stretch is shortest if no earlier one begins at the same place
        if start >= at:
            noise = place - order[start][0] - (end - start)
            score += POSITION_WEIGHT / (1 + noise)
            at = start + 1
    return score


def all_words(inverted: Inverted, project_id: str, questions: Sequence[Sequence[str]], k: int) -> DataFrame:
    """question_no, chunk_id, text_score, text_rank: words joined by AND, by cover density."""
    if not any(questions):
        return inverted.blocks.sparkSession.createDataFrame([], CANDIDATES)
    rows, askers = _asked(inverted, project_id, questions)
    wanted = F.array(*[F.lit(len(dict.fromkeys(words))) for words in questions])
    # entries of a chunk meet only where its bucket holds every word
    buckets = rows.where(F.col("most") > 0).select("lexeme", "bucket", askers).distinct().groupBy("question_no", "bucket")
    full = buckets.agg(F.count("*").alias("words")).where(F.col("words") == wanted[F.col("question_no")])
    if len(questions) * BUCKETS <= BROADCAST_BUCKETS:
        full = F.broadcast(full)
    kept = rows.select("lexeme", "bucket", "chunk_ids", "seqs", "sizes", "places", askers).join(
        full.select("question_no", "bucket"), ["question_no", "bucket"], "left_semi"
    )
    met = (
        _live(_entries(kept), inverted)
        .groupBy("question_no", "chunk_id")
        .agg(F.collect_list("places").alias("places"))
        .where(F.size("places") == wanted[F.col("question_no")])
    )
    scored = met.select("question_no", "chunk_id", cover_density("places").alias("text_score"))
    return ranked(scored, "text_score", "text_rank", k)


def statistics(inverted: Inverted, project_id: str, words: Sequence[str]) -> tuple[int, int, dict[str, int]]:
    """Chunks of a project, lexemes in them, and for each word the chunks that hold it."""
    rows = inverted.blocks.where(F.col("project_id") == require_project_id(project_id))
    sums = rows.where(F.col("lexeme").isin(["", *words])).groupBy("lexeme").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total")
    )
    found = {r.lexeme: r for r in sums.collect()}  # one row for each word asked for
    whole = found.pop("", None)
    return (whole.n if whole else 0), (whole.total if whole else 0), {w: r.n for w, r in found.items()}


def bm25(inverted: Inverted, project_id: str, questions: Sequence[Sequence[str]], k: int) -> DataFrame:
    """question_no, chunk_id, text_score, text_rank: words joined by OR, by Okapi BM25."""
    spark = inverted.blocks.sparkSession
    words = sorted({w for asked in questions for w in asked})
    chunks, total, held = statistics(inverted, project_id, words)
    if not words or chunks <= 0 or total <= 0:
        return spark.createDataFrame([], CANDIDATES)
    rows, askers = _asked(inverted, project_id, questions)
    rarity = {w: math.log(1 + (chunks - n + 0.5) / (n + 0.5)) for w, n in held.items() if n > 0}
    if not rarity:
        return spark.createDataFrame([], CANDIDATES)
    weights = F.create_map(*[c for w, x in rarity.items() for c in (F.lit(w), F.lit(x))])
    count = F.size("places")
    length = 1 - BM25_B + BM25_B * F.col("size") * chunks / total
    gain = weights[F.col("lexeme")] * count * (BM25_K1 + 1) / (count + BM25_K1 * length)
    entries = _entries(rows.select("lexeme", "chunk_ids", "seqs", "sizes", "places", askers))
    scored = _live(entries, inverted).groupBy("question_no", "chunk_id").agg(
        F.round(F.sum(gain), 9).alias("text_score")
    )
    return ranked(scored, "text_score", "text_rank", k)


#: Ways to score a text search: by name, as the command line and `text_search` take them.
SCORERS = {"any": any_word, "all": all_words, "bm25": bm25}
