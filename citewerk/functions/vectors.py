"""Vector expressions: encoding, dimension check, cosine similarity.

Spark has no vectorised dot product over arrays; a higher-order `aggregate` boxes
every element. Arrow hands whole batches of vectors to numpy instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.functions.text import query_text
from citewerk.settings import EMBEDDING_BATCH, EMBEDDING_DIM


class Encoder(Protocol):
    """Anything that maps texts to vectors. It is sent to the workers by pickle."""

    def encode(self, texts: list[str]) -> Sequence[Sequence[float]]: ...


def load_encoder(model_name: str) -> Encoder:
    """A sentence-transformers model with unit-length output, where that is installed."""
    try:
        from sentence_transformers import SentenceTransformer
    except ImportError as missing:
        raise RuntimeError(
            "sentence-transformers is not installed; pass an encoder of your own"
        ) from missing

    class _Model:
        """Loaded once per process: the model itself is never pickled."""

        def __init__(self, name: str):
            self.name = name

        def __getstate__(self):
            return {"name": self.name}

        def encode(self, texts: list[str]) -> Sequence[Sequence[float]]:
            if not hasattr(self, "_model"):
                self._model = SentenceTransformer(self.name)
            return self._model.encode(texts, normalize_embeddings=True).tolist()

    return _Model(model_name)


def require_dimension(vector: Sequence[float], dim: int) -> list[float]:
    if len(vector) != dim:
        raise ValueError(
            f"Dimension {len(vector)} des Encoders passt nicht zur erwarteten Dimension {dim}; "
            "ein anderes Modell verlangt neue Embeddings."
        )
    return [float(x) for x in vector]


def embed_query(question: str, encoder: Encoder, dim: int = EMBEDDING_DIM) -> list[float]:
    """Vector of one question; runs on the driver."""
    [vector] = encoder.encode([query_text(question)])
    return require_dimension(vector, dim)


def embed(
    texts: Column, encoder: Encoder, dim: int = EMBEDDING_DIM, batch_size: int = EMBEDDING_BATCH
) -> Column:
    """Vectors of stored texts, `batch_size` texts per encoder call, order kept."""

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def run(values: pa.Array) -> pa.Array:
        inputs = values.to_pylist()
        vectors: list[list[float]] = []
        for at in range(0, len(inputs), batch_size):
            batch = inputs[at : at + batch_size]
            encoded = encoder.encode(batch)
            if len(encoded) != len(batch):
                raise ValueError(f"Encoder returned {len(encoded)} vectors for {len(batch)} texts")
            vectors += [require_dimension(v, dim) for v in encoded]
        return pa.array(vectors, pa.list_(pa.float32()))

    return run(texts)


def checked_embedding(embedding: Column, dim: int) -> Column:
    """The stored vector itself; the job fails if its length is not `dim`."""
    message = F.concat(
        F.lit(f"Dimension {dim} erwartet, gefunden: "), F.size(embedding).cast("string")
    )
    return F.when(embedding.isNull() | (F.size(embedding) == dim), embedding).otherwise(
        F.raise_error(message)
    )


def as_matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of an Arrow list array (no NULL rows) as a float64 matrix."""
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    if not np.all(lengths == dim):
        odd = int(lengths[lengths != dim][0])
        raise ValueError(f"Dimension {odd} im Index, die Frage hat Dimension {dim}")
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(vectors), dim)


def cosine_table(matrix: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine similarity of each row with each query; NaN where a norm is zero."""
    norms = np.outer(
        np.sqrt(np.einsum("ij,ij->i", matrix, matrix)),
        np.sqrt(np.einsum("ij,ij->i", queries, queries)),
    )
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(norms > 0, (matrix @ queries.T) / norms, np.nan)


def cosine_similarity(embedding: Column, query: Sequence[float]) -> Column:
    """Similarity of stored vectors with one query vector; NULL for zero vectors."""
    target = np.asarray(query, dtype=np.float64)

    @F.arrow_udf(T.DoubleType())
    def run(vectors: pa.Array) -> pa.Array:
        valid = vectors.is_valid().to_numpy(zero_copy_only=False)
        out = np.full(len(vectors), np.nan)
        if valid.any():
            present = vectors.drop_null()
            out[valid] = cosine_table(as_matrix(present, len(target)), target[None, :])[:, 0]
        return pa.array(out, pa.float64(), mask=np.isnan(out))

    return run(embedding)
