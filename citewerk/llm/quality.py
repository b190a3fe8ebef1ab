"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score(x) = sigmoid(b + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]),
the sum-of-squares identity, linear in the number of features of a text.

Features of a text: words (lower-cased A-Z) hashed into `WORD_BUCKETS`, log counts of unit
length; structure statistics (`STRUCTURE`); metadata, here the logarithm of the stored length.
Never used: labels, language, source or ids.

The model is fitted on at most `max_rows` labelled rows, those with the smallest hash of their
id, by mini-batches with Adagrad in numpy; scoring reads every row and whole text. Parameters
have a fixed size of (WORD_BUCKETS + dense) x (factors + 1) floats and are broadcast.

Defined results: a null text counts as empty and gets a score too; null or missing metadata is
0; of repeated labels of one id the largest counts; without any usable label the score is 0.5.
"""

from __future__ import annotations

import operator
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citewerk.llm.shared import LOWER_BYTES, WORD, fresh, pieces, raw_texts

WORD_BUCKETS = 1 << 16
STRUCTURE = (
    "words", "word length", "upper case", "digits", "symbols", "sentence ends", "line length",
    "repeated lines", "distinct words", "long words", "one-letter words", "words ending in a symbol",
    "words repeated at once", "repeated word pairs",
)
DENSE = len(STRUCTURE) + 1
SIZE = WORD_BUCKETS + DENSE
_WORD = re.compile(WORD)
_UPPER = re.compile(rb"[A-Z]")
_DIGIT = re.compile(rb"[0-9]")
_SYMBOL = re.compile(rb"[^A-Za-z0-9\s\x80-\xff]")
_END = re.compile(rb"[.!?](?=\s|$)")
_LETTER_END = re.compile(rb"[A-Za-z0-9\x80-\xff]")


def features(text: bytes, stored_length: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a text's features."""
    words = _WORD.findall(text.translate(LOWER_BYTES))
    counts = Counter(words)
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [line for line in text.split(b"\n") if line.strip()]
    spread = max(1, len(lines))
    dense = (
        np.log1p(len(words)) / 10,
        sum(map(len, words)) / n / 10,
        len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars * 4,
        len(_SYMBOL.findall(text)) / chars * 4,
        len(_END.findall(text)) / n * 4,
        np.log1p(len(words) / spread) / 10,
        1 - len(set(lines)) / spread if lines else 0.0,
        len(counts) / n,
        sum(c for w, c in counts.items() if len(w) > 12) / n,
        sum(c for w, c in counts.items() if len(w) == 1) / n,
        sum(c for w, c in counts.items() if not _LETTER_END.match(w[-1:])) / n,
        sum(map(operator.eq, words, words[1:])) / n,
        1 - len(set(zip(words, words[1:]))) / max(1, len(words) - 1) if len(words) > 1 else 0.0,
        np.log1p(max(0.0, stored_length or 0.0)) / 10,
    )
    where = np.fromiter((zlib.crc32(w) % WORD_BUCKETS for w in counts), np.int32, len(counts))
    value = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    value /= max(1e-6, float(np.sqrt((value * value).sum())))
    return (
        np.concatenate([where, np.arange(WORD_BUCKETS, SIZE, dtype=np.int32)]),
        np.concatenate([value, np.array(dense, np.float32)]),
    )


class FactorisationMachine:
    """Parameters and their use; `fit` takes sparse rows as (index, value) pairs."""

    def __init__(self, factors: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = np.float32(0)
        self.weight = np.zeros(SIZE, np.float32)
        self.factor = rng.normal(0, 0.01, (SIZE, factors)).astype(np.float32)

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.empty(len(rows), np.float64)
        for k, (where, value) in enumerate(rows):
            sums = value @ self.factor[where]
            squares = (value * value) @ self.squares[where]
            out[k] = self.bias + value @ self.weight[where] + 0.5 * (float(sums @ sums) - squares)
        return out

    def freeze(self) -> "FactorisationMachine":
        """Keeps the row sums of squared factors, which every score needs."""
        self.squares = (self.factor**2).sum(axis=1)
        return self

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(rows), -40, 40)))

    def fit(
        self,
        rows: list[tuple[np.ndarray, np.ndarray]],
        labels: np.ndarray,
        epochs: int = 6,
        batch: int = 128,
        rate: float = 0.05,
        decay: float = 1e-5,
        seed: int = 7,
    ) -> "FactorisationMachine":
        """Adagrad on the logistic loss; the factors of a word move by what it meets."""
        rng = np.random.default_rng(seed)
        width = self.factor.shape[1]
        weight_seen = np.full(SIZE, 1e-4, np.float32)
        factor_seen = np.full((SIZE, width), 1e-4, np.float32)
        share = float(labels.mean()) if len(labels) else 0.5
        self.bias = np.float32(np.log((share + 1e-3) / (1 - share + 1e-3)))
        for _ in range(epochs if len(rows) else 0):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), batch):
                chosen = order[start : start + batch]
                where = np.concatenate([rows[i][0] for i in chosen])
                value = np.concatenate([rows[i][1] for i in chosen])
                sizes = np.array([len(rows[i][0]) for i in chosen])
                begins = np.r_[0, np.cumsum(sizes)[:-1]]
                vx = self.factor[where] * value[:, None]
                sums = np.add.reduceat(vx, begins)
                squares = np.add.reduceat((vx * vx).sum(axis=1), begins)
                linear = np.add.reduceat(self.weight[where] * value, begins)
                margin = self.bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares)
                error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - labels[chosen]
                error = (error / len(chosen)).astype(np.float32)
                each = np.repeat(error, sizes)
                # d margin / d v_if = x_i (sum_j v_jf x_j - v_if x_i)
                pull = each[:, None] * value[:, None] * (np.repeat(sums, sizes, axis=0) - vx)
                touched, slot = np.unique(where, return_inverse=True)
                for_weight = np.bincount(slot, each * value, len(touched)).astype(np.float32)
                for_factor = np.stack(
                    [np.bincount(slot, pull[:, f], len(touched)) for f in range(width)], axis=1
                ).astype(np.float32)
                for_weight += decay * self.weight[touched]
                for_factor += decay * self.factor[touched]
                weight_seen[touched] += for_weight**2
                factor_seen[touched] += for_factor**2
                self.weight[touched] -= rate * for_weight / np.sqrt(weight_seen[touched])
                self.factor[touched] -= rate * for_factor / np.sqrt(factor_seen[touched])
                self.bias -= np.float32(rate * error.sum())
        return self.freeze()


def _metadata(docs: DataFrame, length_col: str | None) -> Column:
    if length_col is None or length_col not in docs.columns:
        return F.lit(None).cast("double")
    return F.col(f"`{length_col}`").cast("double")


def fit(
    docs: DataFrame,
    labels: DataFrame,
    usable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    length_col: str | None = "n_chars",
    max_rows: int = 12_000,
    factors: int = 8,
) -> FactorisationMachine:
    """A model of `label_col`, learnt from labelled rows for which `usable` holds (over id_col)."""
    row_id, label = fresh(docs.columns, "label_id", "label")
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & usable)
        .groupBy(F.col(id_col).alias(row_id))
        .agg(F.max(label_col).cast("double").alias(label))
        .orderBy(F.xxhash64(row_id), row_id)
        .limit(max_rows)
    )
    sample = docs.join(F.broadcast(known), F.col(f"`{id_col}`") == F.col(row_id)).select(
        F.col(row_id), F.col(label), F.col(f"`{text_col}`").alias("text"),
        _metadata(docs, length_col).alias("length"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            made = [
                features(t, n)
                for t, n in zip(raw_texts(batch.column(2)), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "id": batch.column(0),
                    "label": batch.column(1),
                    "at": pa.array([w.tobytes() for w, _ in made], pa.binary()),
                    "value": pa.array([v.tobytes() for _, v in made], pa.binary()),
                }
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = sample.mapInArrow(run, f"id {kind}, label double, at binary, value binary").toPandas()
    rows = rows.sort_values(["id", "value"]).reset_index(drop=True)
    made = [
        (np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v in zip(rows["at"], rows.value)
    ]
    return FactorisationMachine(factors).fit(made, rows.label.to_numpy(np.float32))


def score_column(
    docs: DataFrame, model: FactorisationMachine, text_col: str = "text", length_col: str | None = "n_chars"
) -> Column:
    """The score of each row of docs, in batches beside the scan."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        machine = held.value
        for text, length in batches:
            out = []
            for start in range(0, len(text), 256):
                part = slice(start, start + 256)
                rows = [
                    features((t or "").encode(), None if n is None or n != n else n)
                    for t, n in zip(text.iloc[part], length.iloc[part])
                ]
                out.append(machine.scores(rows))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return score(F.col(f"`{text_col}`"), _metadata(docs, length_col))
