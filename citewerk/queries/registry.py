from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citewerk.plans.sample_views import view_sql

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Register a query under its function name, with its SQL over the named views."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = with_views(sql, *views)
        return function

    return register


def with_views(sql: str, *views: str) -> str:
    """Prefix SQL with the named sample views; SQL may go on with further CTEs."""
    defined = [f"{name} AS ({view_sql(name)})" for name in views]
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    if body.upper().startswith("WITH"):
        rest = body[len("WITH RECURSIVE" if recursive else "WITH") :]
        if not defined:
            return body
        return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(defined)}, {rest}"
    return f"WITH {', '.join(defined)} {body}" if defined else body
