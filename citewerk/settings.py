"""Defaults of the public calls; every one can be passed as an argument.

`from_env` reads overrides once, on the driver, for the command line.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

# Retrieval and chunking defaults that results depend on.
CHUNK_MAX_CHARS = 1200
CHUNK_OVERLAP_CHARS = 150
EMBEDDING_DIM = 768
EMBEDDING_MODEL = "intfloat/multilingual-e5-base"
EMBEDDING_BATCH = 32
RRF_K = 60
CANDIDATES_PER_METHOD = 30
SEARCH_LIMIT = 10
HITS_PER_QUESTION = 16
GENERATOR_RETRIES = 2
SHORT_EXCERPT = 20

# Narrow id sets up to this many bytes, measured first, may be broadcast.
BROADCAST_BYTES = 32 << 20


@dataclass(frozen=True)
class Settings:
    data_dir: str = "data"
    chunk_max_chars: int = CHUNK_MAX_CHARS
    chunk_overlap_chars: int = CHUNK_OVERLAP_CHARS
    embedding_model: str = EMBEDDING_MODEL
    embedding_dim: int = EMBEDDING_DIM
    generator_retries: int = GENERATOR_RETRIES

    @property
    def raw_dir(self) -> str:
        return f"{self.data_dir}/raw"

    @property
    def tables_dir(self) -> str:
        return f"{self.data_dir}/parquet"

    @property
    def index_dir(self) -> str:
        return f"{self.data_dir}/index"

    @property
    def generated_dir(self) -> str:
        return f"{self.data_dir}/generated"


def from_env(prefix: str = "CITEWERK_") -> Settings:
    defaults = Settings()
    found = {}
    for name, value in vars(defaults).items():
        raw = os.environ.get(prefix + name.upper())
        if raw is not None:
            found[name] = type(value)(raw)
    return Settings(**found)
