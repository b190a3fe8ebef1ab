"""What several queries search: an index of the documents, stored once for each session and folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citewerk.functions.compounds import NO_PARTS, Lexicon, Parts
from citewerk.functions.tokens import index_terms
from citewerk.operators import index as ix
from citewerk.operators.postings import Inverted
from citewerk.plans.sample_views import table, view
from citewerk.schemas import CHUNK_COLUMNS
from citewerk.sources import storage

STOPS = ("der", "die", "das", "und", "in", "zu", "von", "mit", "the", "of", "and", "to")
PARTS = (
    "heit", "keit", "ung", "lich", "ver", "sch", "ein", "ent", "ing", "tion", "ment", "ach", "gen",
    "enst", "ieren", "auch", "that", "tive", "lichkeit", "enheit", "erung", "einung",
)

# The questions; each is a handful of words, as a user would ask.
QUESTIONS = (
    "Verkeit und die Genehmigungen",
    "erung lichen schkeit enheit über",
    "the nation and inghere",
)
SEARCHED = "DOC-1"


@dataclass(frozen=True)
class Stored:
    rows: DataFrame
    inverted: Inverted


def corpus_chunks(corpus: DataFrame, *further: str) -> DataFrame:
    """Rows of the corpus view with the columns of the chunks table."""
    made = {
        "segment_id": F.col("document_id"),
        "index": F.col("position").cast("int"),
        "char_start": F.lit(0),
        "char_end": F.length("text"),
        "source_path": F.col("file_name"),
        "page_no": F.lit(None).cast("int"),
    }
    return corpus.select(
        *[made[c].alias(c) if c in made else F.col(c) for c in CHUNK_COLUMNS], *further
    )


def index_source(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks: text of every row, vectors where a row has one."""
    embeddings = table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return corpus_chunks(view(spark, folder, "corpus").join(embeddings, "doc_id", "left"), "embedding")


def finished(rows: DataFrame, lexicon: Parts) -> DataFrame:
    """Index rows of chunks that have their vectors."""
    heading, text = F.col("heading"), F.col("text")
    lexed = rows.withColumn("terms", index_terms(heading, text, lexicon, STOPS))
    return lexed.select(
        *rows.columns, "terms.compound_terms", "terms.lexemes", "terms.places",
        ix.text_hash(heading, text).alias("text_hash"),
    )


def _place(spark: SparkSession) -> str:
    """A new folder on shared storage; a local session without one gets a temporary folder that goes with it."""
    if spark.conf.get("spark.checkpoint.dir", None) is None and spark.sparkContext.master.startswith("local["):
        folder = tempfile.mkdtemp(prefix="citewerk-index-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        return f"{folder}/index"
    return storage.staging_path(spark, f"{spark.conf.get('spark.sql.warehouse.dir')}/citewerk")


#: Where a session has its index of a folder.
_paths: dict[tuple, str] = {}


def stored_index(spark: SparkSession, folder: str, parts: tuple[str, ...] | None) -> Stored:
    """The stored index of all documents of a folder, whose compounds are split by a list of parts.

    Like any index it is built once and then asked: the first query of a session writes it to the
    shared folder, and later ones read rows and blocks.
    """
    key = (spark.sparkContext.applicationId, folder, parts)
    if key not in _paths:
        path = _place(spark)
        lexicon = Lexicon(parts) if parts else NO_PARTS
        ix.upsert(spark, path, index_source(spark, folder), finish=lambda rows: finished(rows, lexicon))
        _paths[key] = path
    return Stored(ix.open_index(spark, _paths[key]), ix.open_postings(spark, _paths[key]))

