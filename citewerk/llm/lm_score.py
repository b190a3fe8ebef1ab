"""Language-model scores from a log-bilinear neural model trained by noise-contrastive estimation.

What the corpus gives: the count of every word over all training texts, and the counts of all
pairs of neighbouring word classes. The classes are the `OWN` most frequent tokens, each one its
own, and `ENDINGS` classes of the other words by their last two letters, unseen words included.

The model: p(next class | class) from scores r_class . q_next + b_next. It is trained with
noise-contrastive estimation against the unigram distribution of classes; as the class pairs are
few and counted exactly, the expectations over data and noise are taken in closed form, one
matrix product for each step. Batched matrix products then give the normalised log-probabilities
of all classes after each class. A word of a shared class has (c + 1) / (sum of c + words + 1) of
its class, so all words, with one place for unseen ones in each class, sum to one.

Counts of words are not broadcast, but for at most `FREQUENT` of the most frequent ones; all other words of the texts meet their counts in a join.

Defined results: a null text counts as empty, its only token is the end; a null id counts as empty
text in the split; an empty training part leaves uniform probabilities; rows that repeat are
scored, and counted, each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.llm.shared import pieces, raw_texts, settle
from citewerk.llm.words import word_hashes

OWN = 512
ENDINGS = 512
CLASSES = OWN + ENDINGS
FREQUENT = 1 << 18
#: The end of a text, as a token; no word has this hash (its class bits apart, a mixed constant).
END = np.uint64(0x0A5C3F1E9B7D2460)
_FLUSH = 1 << 21


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with one end per text, number of tokens per text)."""
    words, sizes = word_hashes(texts, ENDINGS)
    ends = np.cumsum(sizes)
    return np.insert(words, ends, END), sizes + 1


@dataclass
class Vocabulary:
    """Frequent tokens and the size of each class; arrays of fixed length."""

    own: np.ndarray  # sorted hashes of tokens with a class of their own
    frequent: np.ndarray  # sorted hashes
    counts: np.ndarray  # their counts
    class_counts: np.ndarray
    class_words: np.ndarray
    total: int
    distinct: int

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.own):
            return (OWN + (hashes & np.uint64(ENDINGS - 1))).astype(np.int64)
        at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
        shared = (OWN + (hashes & np.uint64(ENDINGS - 1))).astype(np.int64)
        return np.where(self.own[at] == hashes, at, shared)


def count_tokens(docs: DataFrame, text_col: str) -> DataFrame:
    """(hash, n) of all tokens; tasks pre-aggregate before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([h for h, _ in held])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], np.concatenate([c for _, c in held])[order]
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            return keys[first], np.add.reduceat(n, first)

        def give(pair: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for start in range(0, len(pair[0]), 1 << 17):
                part = slice(start, start + (1 << 17))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[0][part].view(np.int64)), pa.array(pair[1][part])],
                    names=["hash", "n"],
                )

        size = 0
        for batch in pieces(batches):
            found = np.unique(tokens(raw_texts(batch.column(0)))[0], return_counts=True)
            held.append(found)
            size += len(found[0])
            if size > _FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > _FLUSH // 2:
                    yield from give(held[0])
                    held, size = [], 0
        if held:
            yield from give(merged())

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "hash long, n long")
    return rows.groupBy("hash").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Frequent tokens and class sizes from the counts of all."""
    level = F.floor(F.log2("n") * 16)
    steps = counts.groupBy(level.alias("level")).count().collect()  # at most some 1,000 rows
    held, least = 0, None
    for row in sorted(steps, key=lambda r: -r.level):
        held += row["count"]
        if held > FREQUENT:
            break
        least = row.level
    top = counts.where(level >= least if least is not None else F.lit(False)).toPandas()
    top = top.sort_values(["n", "hash"], ascending=[False, True])
    hashes = top["hash"].to_numpy(np.int64).view(np.uint64)
    n = top["n"].to_numpy(np.int64)
    is_end = hashes == END
    own = np.sort(np.r_[hashes[is_end], hashes[~is_end][: OWN - int(is_end.any())]])
    order = np.argsort(hashes)
    class_counts, class_words = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    low = counts.groupBy(F.col("hash").bitwiseAND(ENDINGS - 1).alias("k")).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")
    )
    for row in low.collect():
        class_counts[OWN + row.k], class_words[OWN + row.k] = row.n, row.words
    total, distinct = int(class_counts.sum()), int(class_words.sum())
    found = dict(zip(hashes.tolist(), n.tolist()))
    for at, h in enumerate(own.tolist()):
        shared = OWN + (h & (ENDINGS - 1))
        class_counts[at], class_words[at] = found[h], 1
        class_counts[shared] -= found[h]
        class_words[shared] -= 1
    return Vocabulary(own, hashes[order], n[order], class_counts, class_words, total, distinct)


def pair_counts(docs: DataFrame, text_col: str, words) -> np.ndarray:
    """How often a class follows a class, over all texts; row CLASSES is the start of a text."""
    cells = (CLASSES + 1) * CLASSES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(cells, np.int64)
        for batch in pieces(batches):
            hashes, sizes = tokens(raw_texts(batch.column(0)))
            if len(hashes):
                kinds = words.value.classes(hashes)
                before = np.r_[CLASSES, kinds[:-1]]
                before[np.r_[0, np.cumsum(sizes)[:-1]]] = CLASSES
                where, n = np.unique(before * CLASSES + kinds, return_counts=True)
                seen[where] += n
        where = np.flatnonzero(seen)
        for start in range(0, len(where), 1 << 17):
            part = where[start : start + (1 << 17)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array(seen[part])], names=["cell", "n"]
            )

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "cell int, n long")
    found = rows.groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(cells, np.float64)
    out[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return out.reshape(CLASSES + 1, CLASSES)


def train(
    pairs: np.ndarray, width: int = 32, noise: int = 16, steps: int = 150, rate: float = 0.05, seed: int = 3
) -> np.ndarray:
    """Log-probabilities of all classes after each class, from noise-contrastive estimation.

    The expected gradient over all pairs and `noise` noise classes for each is one pair of matrix
    products; Adam moves the vectors.
    """
    rng = np.random.default_rng(seed)
    rows, columns = pairs.shape
    mass = max(1.0, pairs.sum())
    data = (pairs / mass).astype(np.float32)
    unigram = pairs.sum(axis=0) + 1.0
    unigram = (unigram / unigram.sum()).astype(np.float32)
    contexts = data.sum(axis=1, keepdims=True)
    fake = noise * contexts * unigram  # weight of a noise class in each context
    bar = np.log(noise * unigram)
    params = [
        rng.normal(0, 0.1, (rows, width)).astype(np.float32),
        rng.normal(0, 0.1, (columns, width)).astype(np.float32),
        np.log(unigram),
    ]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1 if pairs.any() else 1):
        r, q, b = params
        real = 1 / (1 + np.exp(bar - b - r @ q.T))  # probability that a pair is data
        pull = data * (1 - real) - fake * real
        for k, slope in enumerate((pull @ q, pull.T @ r, pull.sum(axis=0))):
            slope = slope * np.float32(1e3)
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.98 * second[k] + 0.02 * slope**2
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-6)
            params[k] = params[k] + np.float32(rate * min(1.0, 2 * (1 - step / (steps + 1)))) * move
    return normalised(*params)


def normalised(r: np.ndarray, q: np.ndarray, b: np.ndarray, batch: int = 256) -> np.ndarray:
    """log10 p(class | class before), in batches of contexts."""
    out = []
    for start in range(0, len(r), batch):
        scores = (r[start : start + batch] @ q.T + b).astype(np.float64)
        scores -= scores.max(axis=1, keepdims=True)
        out.append(scores - np.log(np.exp(scores).sum(axis=1, keepdims=True)))
    return (np.concatenate(out) / np.log(10)).astype(np.float32)


def score_texts(
    docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, training, n_tokens, n_known, train_tokens, base_score, score.

    `training` is a boolean over the columns of docs: the rows to learn from.
    """
    context = docs.sparkSession.sparkContext
    learn = docs.where(training)
    counts = settle(count_tokens(learn, text_col))
    words = vocabulary(counts)
    held = context.broadcast(words)
    table = context.broadcast(train(pair_counts(learn, text_col, held)))
    inside = np.log10(words.class_counts + words.class_words + 1.0)
    inside[:OWN] = 0.0
    shared_sizes = context.broadcast(inside)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sizes_of, logs = held.value, shared_sizes.value, table.value
        for batch in pieces(batches):
            hashes, sizes = tokens(raw_texts(batch.column(2)))
            if not len(sizes):
                continue
            starts = np.r_[0, np.cumsum(sizes)[:-1]]
            kinds = known.classes(hashes)
            before = np.r_[CLASSES, kinds[:-1]]
            before[starts] = CLASSES
            n = np.zeros(len(hashes), np.int64)
            rare = np.ones(len(hashes), bool)
            if len(known.frequent):
                at = np.minimum(np.searchsorted(known.frequent, hashes), len(known.frequent) - 1)
                hit = known.frequent[at] == hashes
                n[hit], rare = known.counts[at[hit]], ~hit
            seen = np.log10(n + 1.0)
            model = logs[before, kinds].astype(np.float64) - sizes_of[kinds]
            model += np.where(kinds >= OWN, seen, 0.0)
            doc = np.repeat(np.arange(len(sizes)), sizes)[rare]
            order = np.lexsort((hashes[rare], doc))
            doc, rest = doc[order], hashes[rare][order]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (rest[1:] != rest[:-1])]) if len(doc) else np.empty(0, np.int64)  # noqa: E501
            times = np.diff(np.r_[first, len(doc)]).astype(np.int32)
            offsets = np.searchsorted(doc[first], np.arange(len(sizes) + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes),
                    pa.array(np.add.reduceat((n > 0).astype(np.int64), starts)),
                    pa.array(np.add.reduceat(seen, starts)),
                    pa.array(np.add.reduceat(model, starts)),
                    pa.ListArray.from_arrays(
                        pa.array(offsets),
                        pa.StructArray.from_arrays(
                            [pa.array(rest[first].view(np.int64)), pa.array(times)], names=["hash", "times"]
                        ),
                    ),
                ],
                names=["id", "training", "n_tokens", "known", "seen", "model", "rare"],
            )

    schema = T.StructType().add("id", docs.schema[id_col].dataType).add("training", "boolean")
    schema = schema.add("n_tokens", "long").add("known", "long").add("seen", "double")
    rare_type = T.ArrayType(T.StructType().add("hash", "long").add("times", "integer"))
    schema = schema.add("model", "double").add("rare", rare_type)
    narrow = docs.select(
        F.col(f"`{id_col}`"), F.coalesce(training, F.lit(False)).alias("training"), F.col(f"`{text_col}`")
    )
    scored = settle(narrow.mapInArrow(run, schema))
    scored = scored.withColumn("row", F.monotonically_increasing_id())  # rows are on disk: ids are stable
    rest = scored.select("row", F.explode("rare").alias("r")).select("row", "r.hash", "r.times")
    found = (
        rest.join(counts, "hash")
        .groupBy("row")
        .agg(
            F.sum("times").alias("rare_known"),
            F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("rare_seen"),
        )
    )
    base = float(np.log10(words.total + words.distinct + 1.0))
    rare_seen = F.coalesce("rare_seen", F.lit(0.0))
    return scored.join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "training",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("seen") + rare_seen - F.col("n_tokens") * F.lit(base)).alias("base_score"),
        (F.col("model") + rare_seen).alias("score"),
    )
