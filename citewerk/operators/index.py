"""The retrieval index: a Parquet table, keyed by chunk_id, and the tables that belong to it.

Layout: rows are partitioned by project and `shard` (a hash of the chunk id), so a search prunes to
one project. Every write only appends: rows carry a sequence number, and what they replace or what
is removed is noted in the narrow table `gone` (chunk_id, before: rows with a smaller number are
dead). Readers leave dead rows out by an anti-join with that table, a broadcast as long as its
measured bytes allow. `compact` rewrites the shards that hold dead rows and empties the table; it
is the only step during which nobody should read. The inverted index (`operators.postings`) lies
beside the rows, and so does the model of the compound splitter.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.functions.compounds import Parts
from citewerk.functions.ids import require_project_id
from citewerk.functions.text import passage_text
from citewerk.functions.tokens import index_terms
from citewerk.functions.vectors import Encoder, checked_embedding, embed
from citewerk.operators import postings
from citewerk.operators.retrieval import SHARDS, shard_of
from citewerk.schemas import CHUNK_COLUMNS, INDEX
from citewerk.settings import EMBEDDING_BATCH, EMBEDDING_DIM
from citewerk.sources import storage
from citewerk.sources.tables import first_per_key, is_small, missing_columns, restrict

COLUMNS = tuple(INDEX.fieldNames())
#: Bytes of text in a piece of a shard, which one task lexes and stores.
TASK_BYTES = 8 << 20
STORED = T.StructType(
    [*INDEX.fields, T.StructField("seq", T.LongType()), T.StructField("shard", T.IntegerType())]
)
GONE = T.StructType([T.StructField("chunk_id", T.StringType()), T.StructField("before", T.LongType())])


def text_hash(heading: Column, text: Column) -> Column:
    """Fingerprint of what is embedded. Chunk ids do not depend on the text, so a
    re-chunked document can carry new text under a known id."""
    return F.sha2(passage_text(heading, text), 256)


def check_index(spark: SparkSession, path: str) -> None:
    """Refuse an index written with an older layout instead of searching it silently."""
    if storage.has_data(spark, path):
        missing = missing_columns(spark.read.parquet(path).columns, STORED.fieldNames())
        if missing:
            raise RuntimeError(
                f"Index {path} ist veraltet (es fehlt: {', '.join(missing)}). "
                "Mit --neu neu anlegen und alle Chunks neu einbetten."
            )


def postings_path(path: str) -> str:
    return f"{path}_postings"


def gone_path(path: str) -> str:
    return f"{path}_gone"


def splitter_path(path: str) -> str:
    return f"{path}_splitter"


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows, dead ones too."""
    if not storage.has_data(spark, path):
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).parquet(path).select(*STORED.fieldNames())


def _gone(spark: SparkSession, path: str) -> DataFrame | None:
    """chunk_id, before; null where nothing was replaced or removed since the last compaction."""
    if not storage.has_data(spark, gone_path(path)):
        return None
    noted = spark.read.schema(GONE).parquet(gone_path(path))
    return noted.groupBy("chunk_id").agg(F.max("before").alias("before"))


def _alive(rows: DataFrame, gone: DataFrame | None, how: str = "left_anti") -> DataFrame:
    if gone is None:
        return rows if how == "left_anti" else rows.where(F.lit(False))
    noted = gone.withColumnRenamed("chunk_id", "_gone")
    side = F.broadcast(noted) if is_small(noted) else noted
    return rows.join(side, (F.col("chunk_id") == F.col("_gone")) & (F.col("seq") < F.col("before")), how)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """The live rows of the index, none where nothing has been written yet."""
    check_index(spark, path)
    return _alive(_stored(spark, path), _gone(spark, path))


def open_postings(spark: SparkSession, path: str) -> postings.Inverted:
    """The inverted index that belongs to the index at `path`."""
    return postings.Inverted(postings.read_blocks(spark, postings_path(path)), _gone(spark, path))


def reset_index(spark: SparkSession, path: str) -> None:
    """Drop the index. Nothing is lost: the chunks table is the source."""
    for own in (path, postings_path(path), gone_path(path), splitter_path(path), _mark(path)):
        storage.remove(spark, own)


def index_rows(
    chunks: DataFrame,
    encoder: Encoder,
    lexicon: Parts,
    dim: int = EMBEDDING_DIM,
    batch_size: int = EMBEDDING_BATCH,
    stops: Collection[str] | None = None,
) -> DataFrame:
    """Chunks with everything searching needs. Runs where the chunks are, no shuffle."""
    heading, text = F.col("heading"), F.col("text")
    kept = [c for c in ("seq", "shard") if c in chunks.columns]
    return (
        chunks.select(*CHUNK_COLUMNS, *kept)
        .withColumn("_terms", index_terms(heading, text, lexicon, stops))
        .withColumn("compound_terms", F.col("_terms.compound_terms"))
        .withColumn("embedding", embed(passage_text(heading, text), encoder, dim, batch_size))
        .withColumn("lexemes", F.col("_terms.lexemes"))
        .withColumn("places", F.col("_terms.places"))
        .drop("_terms")
        .withColumn("text_hash", text_hash(heading, text))
    )


def merge_rows(existing: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Upsert as a relation: the batch's rows plus existing rows it does not replace."""
    return batch.unionByName(existing.join(batch.select(key), key, "left_anti"))


def _clustered(rows: DataFrame) -> DataFrame:
    """Rows by project, shard and piece. A shard is cut in so many pieces, a power of two, that each has about
    `TASK_BYTES` of text: what a task lexes, sorts and writes does not grow with the table. A piece holds
    whole buckets of the inverted index as long as there are fewer pieces than buckets."""
    weight = F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(64)
    sizes = rows.groupBy("project_id").agg(F.sum(weight).alias("_bytes"))
    total = sizes.agg(F.sum("_bytes")).first()[0] or 0
    power = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_bytes") / (SHARDS * TASK_BYTES))))
    sizes = sizes.select(F.col("project_id").alias("_project"), F.pow(F.lit(2), power).cast("bigint").alias("_pieces"))
    # one row for each project, which has folders of its own anyway
    sized = rows.join(F.broadcast(sizes), F.col("project_id").eqNullSafe(F.col("_project")))
    piece = F.pmod(F.shiftright(F.xxhash64("chunk_id"), int(math.log2(SHARDS))), F.col("_pieces"))
    dealt = sized.withColumn("_piece", piece).repartition(
        max(1, math.ceil(total / TASK_BYTES)), "project_id", "shard", "_piece"
    )
    return dealt.select(*rows.columns)


def _write(rows: DataFrame, path: str, mode: str) -> None:
    """Store clustered rows. Files are ordered by chunk id, so that looking up ids can skip row groups."""
    (
        rows.select(*STORED.fieldNames())
        .sortWithinPartitions("project_id", "shard", "chunk_id")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", storage.COMPRESSION)
        .partitionBy("project_id", "shard")
        .parquet(path)
    )


def _narrow(spark: SparkSession) -> SparkSession:
    """A session that reads few stored pieces in a task, whose blocks are sorted there."""
    own = spark.newSession()
    own.conf.set("spark.sql.files.maxPartitionBytes", str(2 * TASK_BYTES))
    return own


def _mark(path: str) -> str:
    """A file that exists while a write is under way: rows and postings may differ after a failure."""
    return f"{path}_open_run"


def _next_seq(spark: SparkSession, path: str) -> int:
    stored = _stored(spark, path).agg(F.max("seq")).first()[0] or 0
    gone = _gone(spark, path)
    noted = gone.agg(F.max("before")).first()[0] if gone is not None else 0
    return max(stored, noted or 0) + 1


def _note_gone(spark: SparkSession, path: str, ids: DataFrame, seq: int, live: DataFrame) -> None:
    """Mark the rows of `ids` (chunk_id) that are older than seq as dead."""
    dead = restrict(live.select("project_id", "shard", "chunk_id", "lexemes"), ids, "chunk_id")
    postings.count_out(dead, postings_path(path))
    ids.select("chunk_id", F.lit(seq).cast("long").alias("before")).write.mode("append").parquet(gone_path(path))


def _begin(spark: SparkSession, path: str) -> None:
    if storage.exists(spark, _mark(path)):
        rebuild_postings(spark, path)
    storage.mark(spark, _mark(path))


def rebuild_postings(spark: SparkSession, path: str) -> None:
    """Write the inverted index anew from the live rows, as after a write that did not end."""
    storage.remove(spark, postings_path(path))
    postings.replace(open_index(spark, path), postings_path(path))


def upsert(
    spark: SparkSession,
    path: str,
    rows: DataFrame,
    dim: int | None = None,
    finish: Callable[[DataFrame], DataFrame] | None = None,
) -> int:
    """Insert rows, replacing those with a known chunk_id; returns how many were given.

    With `dim`, a vector of another length fails the job before anything is stored.

    `rows` is written to a staging table first, so it is computed once. `finish` adds what takes much
    room or time (lexemes, places, vectors) to rows that lie in their shards already, so that only
    what it starts from is staged and shuffled; its results are staged, too, if rows are replaced.

    What is stored grows by the rows given, whatever they replace. A run that dies leaves a
    mark, and the next one writes the inverted index anew before it goes on; replaced chunks whose
    new rows were not written count as not indexed.
    """

    def finished(given: DataFrame) -> DataFrame:
        done = finish(given) if finish is not None else given
        if dim is not None:
            done = done.withColumn("embedding", checked_embedding(F.col("embedding"), dim))
        return done

    staged_path = storage.staging_path(spark, path)
    given = rows if finish is not None else finished(rows).select(*COLUMNS)
    given = given.withColumn("shard", shard_of(F.col("chunk_id")))
    given.write.parquet(f"{staged_path}/rows", compression=storage.COMPRESSION)
    staged = spark.read.parquet(f"{staged_path}/rows")
    count = staged.count()
    if count:
        check_index(spark, path)
        _begin(spark, path)
        # Whether ids repeat is asked on narrow rows; the wide rows are regrouped only then.
        ids = staged.groupBy("chunk_id").count()
        repeated = not ids.where("count > 1").isEmpty()
        unique = first_per_key(staged, "chunk_id", ["document_id", "index"]) if repeated else staged
        live = open_index(spark, path)
        restrict(live.select("chunk_id"), unique, "chunk_id").write.parquet(f"{staged_path}/known")
        known = spark.read.parquet(f"{staged_path}/known")
        seq = _next_seq(spark, path)
        fresh = _clustered(unique).withColumn("seq", F.lit(seq).cast("long"))
        replacing = not known.isEmpty()
        if finish is not None:
            fresh = finished(fresh)
            if replacing:
                wide = fresh.select(*STORED.fieldNames())
                wide.write.parquet(f"{staged_path}/finished", compression=storage.COMPRESSION)
                fresh = _clustered(spark.read.parquet(f"{staged_path}/finished"))
        if replacing:
            _note_gone(spark, path, known, seq, live)
        _write(fresh, path, "append")
        storage.remove(spark, staged_path)
        postings.append(_stored(_narrow(spark), path).where(F.col("seq") == seq), postings_path(path))
        storage.remove(spark, _mark(path))
    storage.remove(spark, staged_path)
    return count


def compact(spark: SparkSession, path: str) -> int:
    """Rewrite the shards that hold dead rows, and forget what was noted; returns the dead rows.

    The live rows of these shards are staged first, so a run that dies can be repeated.
    """
    gone = _gone(spark, path)
    if gone is None:
        return 0
    _begin(spark, path)
    staged_path = storage.staging_path(spark, path)
    where = ["project_id", "shard"]
    stored = _stored(spark, path)
    dead = _alive(stored.select("chunk_id", "seq", *where), gone, "left_semi")
    dead.groupBy(*where).count().write.parquet(f"{staged_path}/touched")
    touched = spark.read.parquet(f"{staged_path}/touched")
    side = F.broadcast(touched.select(*where)) if is_small(touched) else touched.select(*where)
    alive = _alive(stored.join(side, where, "left_semi"), gone)
    alive.write.parquet(f"{staged_path}/kept", compression=storage.COMPRESSION)
    kept = spark.read.parquet(f"{staged_path}/kept")
    emptied = touched.join(kept.select(*where).distinct(), where, "left_anti")
    _write(_clustered(kept), path, "overwrite")
    postings.replace(kept, postings_path(path))
    for row in emptied.toLocalIterator():  # a shard without rows gets no file of its own
        for own in (path, postings_path(path)):
            storage.remove(spark, f"{own}/project_id={row.project_id}/shard={row.shard}")
    number = touched.agg(F.sum("count")).first()[0] or 0
    storage.remove(spark, gone_path(path))
    storage.remove(spark, _mark(path))
    storage.remove(spark, staged_path)
    return number


def known_ids(index: DataFrame, project_id: str | None = None) -> DataFrame:
    """chunk_id and text_hash of indexed chunks, optionally of one project."""
    if project_id is not None:
        index = index.where(F.col("project_id") == require_project_id(project_id))
    return index.select("chunk_id", "text_hash")


def pending_ids(chunks: DataFrame, index: DataFrame, compare_texts: bool = False) -> DataFrame:
    """Ids of chunks not indexed yet, or indexed with another span of their segment.

    A segment never changes under its id, so id and offsets tell a text and no text is
    read. After a change of the extraction itself, `compare_texts` compares what was
    embedded.
    """
    if compare_texts:
        same = ["chunk_id", "text_hash"]
        hashed = text_hash(F.col("heading"), F.col("text"))
        wanted = chunks.select("chunk_id", hashed.alias("text_hash"))
    else:
        same = ["chunk_id", "char_start", "char_end"]
        wanted = chunks.select(*same)
    return wanted.join(index.select(*same), same, "left_anti").select("chunk_id")


def stale_ids(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ids of indexed chunks that the chunks table no longer holds."""
    return index.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti")


def prune_index(spark: SparkSession, path: str, chunks: DataFrame) -> int:
    """Remove rows whose chunk is gone; returns their number. Notes their ids and rewrites nothing."""
    live = open_index(spark, path)
    staged_path = storage.staging_path(spark, path)
    stale_ids(live, chunks).write.parquet(f"{staged_path}/stale")
    stale = spark.read.parquet(f"{staged_path}/stale")
    count = stale.count()
    if count:
        _begin(spark, path)
        _note_gone(spark, path, stale, _next_seq(spark, path), live)
        storage.remove(spark, _mark(path))
    storage.remove(spark, staged_path)
    return count
