"""A statistical splitter of compound words, learnt from the words of a corpus.

For every run of `SHORTEST` to `LONGEST` letters the model knows in how many distinct words it
begins the word, ends it or stands inside. A cut is good where what follows it often begins words,
what precedes it often ends words, and what spans it rarely stands inside of words (after Tuggener,
"Incremental Coreference Resolution for German", 2016). The score of a cut is

    greatest share of beginnings after it - least share of insides across it
    + greatest share of ends before it

with -1, 1 and -1 where nothing is known; a linking `s` before the cut may be left out of what ends.
The best cut counts from `LEAST_SCORE` on, the right-most of equal ones, and its sides are cut again.

Counting is one aggregate over the distinct words. Words are split in two ways with one rule
(`best_cut`): by a join of their letter runs with the model, whatever its size, or inside a UDF with
a model whose bytes were measured. Words are lower-case; those over `LONGEST_WORD` letters are not split
and not learnt from. Null texts and empty tables give an empty model, which splits nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.functions.compounds import (
    MAX_LEXICON_BYTES,
    MIN_NESTED_PART_LENGTH,
    MIN_PART_LENGTH,
    MIN_WORD_LENGTH,
)
from citewerk.sources import storage
from citewerk.sources.tables import settled

# Fixed value: from this score on a cut is nearly always right.
LEAST_SCORE = 0.6
SHORTEST, LONGEST = 3, 6
LONGEST_WORD = 64
#: A letter run in fewer distinct words tells too little.
LEAST_WORDS = 4

MODEL = T.StructType(
    [
        T.StructField("run", T.StringType()),
        T.StructField("begins", T.LongType()),
        T.StructField("ends", T.LongType()),
        T.StructField("inside", T.LongType()),
    ]
)
Shares = Mapping[str, tuple[float, float, float]]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))


def distinct_words(texts: DataFrame, text: Column) -> DataFrame:
    """(word) for each distinct word that a splitter looks at; partial aggregation before the shuffle."""
    words = texts.select(F.explode(words_of(text)).alias("word"))
    size = F.length("word")
    return words.where((size >= SHORTEST) & (size <= LONGEST_WORD)).distinct()


def _runs(words: DataFrame, *keep: str) -> DataFrame:
    """keep, word, at, run: all letter runs of each word."""
    last = F.length("word") - SHORTEST
    starts = words.where(last >= 0).select(*keep, "word", F.explode(F.sequence(F.lit(0), last)).alias("at"))
    longest = F.least(F.lit(LONGEST), F.length("word") - F.col("at"))
    sized = starts.select(*keep, "word", "at", F.explode(F.sequence(F.lit(SHORTEST), longest)).alias("size"))
    return sized.select(*keep, "word", "at", F.substring("word", F.col("at") + 1, F.col("size")).alias("run"))


def _run_array(word: Column) -> Column:
    """The letter runs of one word of SHORTEST letters or more; 242 at most for LONGEST_WORD letters."""
    size = F.length(word)
    from_each = F.transform(
        F.sequence(F.lit(0), size - SHORTEST),
        lambda at: F.transform(
            F.sequence(F.lit(SHORTEST), F.least(F.lit(LONGEST), size - at)),
            lambda long: F.substring(word, at + 1, long),
        ),
    )
    return F.flatten(from_each)


def learn(words: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """MODEL rows from distinct words (word). A whole word counts neither as beginning nor as end."""
    runs = _runs(words)
    first, last = F.col("at") == 0, F.col("at") + F.length("run") == F.length("word")
    counted = runs.groupBy("run").agg(
        F.count_if(first & ~last).alias("begins"),
        F.count_if(last & ~first).alias("ends"),
        F.count_if(~first & ~last).alias("inside"),
    )
    return counted.where(F.col("begins") + F.col("ends") + F.col("inside") >= least_words)


def shares_of(begins: int, ends: int, inside: int) -> tuple[float, float, float]:
    total = float(begins + ends + inside)
    return begins / total, ends / total, inside / total


def best_cut(word: str, shares: Shares) -> int:
    """Where to cut a word; 0 where no cut scores enough."""
    size = len(word)
    if not MIN_WORD_LENGTH <= size <= LONGEST_WORD:
        return 0
    after, before, across = [-1.0] * (size + 2), [-1.0] * (size + 2), [1.0] * (size + 2)
    for at in range(size - SHORTEST + 1):
        for end in range(at + SHORTEST, min(size, at + LONGEST) + 1):
            found = shares.get(word[at:end])
            if found is None:
                continue
            begins, ends, inside = found
            after[at] = max(after[at], begins)
            before[end] = max(before[end], ends)
            if word[end : end + 1] == "s":
                before[end + 1] = max(before[end + 1], ends)
            for cut in range(at + 1, end):
                across[cut] = min(across[cut], inside)
    cuts = range(MIN_PART_LENGTH, size - MIN_PART_LENGTH + 1)
    score, cut = max((after[c] - across[c] + before[c], c) for c in cuts)
    return cut if score >= LEAST_SCORE else 0


def _sides(word: str, cut: int, nested: bool) -> tuple[str, str] | None:
    shortest = MIN_NESTED_PART_LENGTH if nested else MIN_PART_LENGTH
    return (word[:cut], word[cut:]) if cut and min(cut, len(word) - cut) >= shortest else None


class Splitter:
    """A model small enough for a task; takes the place of a word list wherever one is asked for."""

    def __init__(self, counts: Mapping[str, tuple[int, int, int]]):
        self.shares = {run: shares_of(*n) for run, n in counts.items()}
        self.key = uuid.uuid4().hex

    def __reduce__(self):
        return _restored, (self.key, self.shares)

    def parts(self, word: str, nested: bool = False) -> list[str]:
        """Parts of one word in lower case, a part directly followed by its own parts."""
        word = word.lower()
        sides = _sides(word, best_cut(word, self.shares), nested)
        return [p for side in sides for p in (side, *self.parts(side, True))] if sides else []


_held: dict[str, Splitter] = {}


def _restored(key: str, shares: Shares) -> Splitter:
    """One object per model and worker process: its tasks share it and what it has split."""
    if key not in _held:
        _held.clear()
        made = _held[key] = Splitter({})
        made.key, made.shares = key, shares
    return _held[key]


def splitter(model: DataFrame) -> Splitter:
    """The model in memory; refused where its runs exceed what a task may carry."""
    size = model.agg(F.sum(F.octet_length("run") + 24)).first()[0] or 0
    if size > MAX_LEXICON_BYTES:
        raise ValueError(
            f"Model of {size} bytes exceeds the {MAX_LEXICON_BYTES} a task may carry; learn it with more "
            "least_words, or split words by `split_words`"
        )
    return Splitter({r.run: (r.begins, r.ends, r.inside) for r in model.collect()})


def cuts(words: DataFrame, model: DataFrame) -> DataFrame:
    """(word, cut) of the distinct words that have one; the model is met in a join on the letter runs."""

    @F.arrow_udf(T.IntegerType())
    def decide(word: pa.Array, known: pa.Array) -> pa.Array:
        rows = known.flatten()
        runs = rows.field("run").to_pylist()
        counts = np.stack([rows.field(c).to_numpy(zero_copy_only=False) for c in ("begins", "ends", "inside")], axis=1)
        shares = (counts / counts.sum(axis=1, keepdims=True)).tolist()
        found, at = [], 0
        for text, size in zip(word.to_pylist(), known.value_lengths().to_pylist()):
            found.append(best_cut(text, dict(zip(runs[at : at + size], shares[at : at + size]))))
            at += size
        return pa.array(found, pa.int32())

    size = F.length("word")
    long = words.where((size >= MIN_WORD_LENGTH) & (size <= LONGEST_WORD))
    # the distinct runs of a word in one array: an aggregate would hold those of all words of a task
    runs = long.select("word", F.explode(F.array_distinct(_run_array(F.col("word")))).alias("run"))
    known = runs.join(model, "run").groupBy("word").agg(
        F.collect_list(F.struct("run", "begins", "ends", "inside")).alias("known")
    )  # a word of 64 letters has 242 runs at most
    return known.select("word", decide.asNondeterministic()("word", "known").alias("cut")).where("cut > 0")


def split_words(words: DataFrame, model: DataFrame) -> DataFrame:
    """(word, parts) of the distinct words (word) that are compounds, parts in reading order.

    Each round cuts the parts of the round before; parts get shorter, so rounds are few.
    """
    waiting = words.select("word", F.col("word").alias("unit"), F.lit("").alias("path"))
    rounds = []
    while True:
        units = waiting.select(F.col("unit").alias("word")).distinct()
        found = cuts(units, model).withColumnRenamed("word", "unit")
        shortest = F.when(F.col("path") == "", MIN_PART_LENGTH).otherwise(MIN_NESTED_PART_LENGTH)
        fits = F.least(F.col("cut"), F.length("unit") - F.col("cut")) >= shortest
        sides = F.array(
            F.struct(F.concat("path", F.lit("1")).alias("path"), F.substring("unit", F.lit(1), F.col("cut")).alias("unit")),
            F.struct(F.concat("path", F.lit("2")).alias("path"), F.expr("substring(unit, cut + 1)").alias("unit")),
        )
        cut = waiting.join(found, "unit").where(fits).select("word", F.inline(sides))
        waiting = settled(cut.select("word", "unit", "path"))
        if waiting.isEmpty():
            break
        rounds.append(waiting)
    if not rounds:
        return words.where(F.lit(False)).select("word", F.array().cast("array<string>").alias("parts"))
    parts = rounds[0]
    for more in rounds[1:]:
        parts = parts.unionByName(more)
    listed = F.array_sort(F.collect_list(F.struct("path", "unit")))
    return parts.groupBy("word").agg(listed.alias("listed")).select("word", F.col("listed.unit").alias("parts"))


def save(model: DataFrame, path: str) -> None:
    """The model is a table of its own; it replaces the one that was there."""
    model.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """The stored model, empty where there is none."""
    if not storage.has_data(spark, path):
        return spark.createDataFrame([], MODEL)
    return spark.read.schema(MODEL).parquet(path)
