"""Registered queries: every operator on the given tables, with an equal SQL where
another engine can express it.

Each module fills the registry through `query`.
"""

from citewerk.queries.registry import ORACLES, QUERIES
from citewerk.queries import chunking, documents, fulltext, reports, splitting, sql_examples, vectors  # noqa: F401, E402

__all__ = ["ORACLES", "QUERIES"]
