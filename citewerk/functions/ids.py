"""Content-addressed ids and the project boundary."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewerk.schemas import PROJECT_ID_PATTERN

SEPARATOR = "\x1f"
ID_LENGTH = 32


def derive_id(*parts: Column) -> Column:
    """First 32 hex digits of SHA-256 over the parts joined by U+001F.

    All parts must be non-NULL: `concat` turns a missing part into a NULL id,
    which a NOT NULL table rejects, where `concat_ws` would silently skip it.
    """
    pieces: list[Column] = []
    for part in parts:
        if pieces:
            pieces.append(F.lit(SEPARATOR))
        pieces.append(part.cast("string"))
    return F.substring(F.sha2(F.concat(*pieces), 256), 1, ID_LENGTH)


def derive_id_local(*parts: object) -> str:
    """The same id for a handful of driver-side values (tests, fixtures)."""
    joined = SEPARATOR.join(map(str, parts)).encode("utf-8")
    return hashlib.sha256(joined).hexdigest()[:ID_LENGTH]


def is_project_id(value: Column) -> Column:
    # \z, not $: a dollar would also accept a trailing newline.
    return value.rlike(rf"\A{PROJECT_ID_PATTERN}\z")


def require_project_id(project_id: str) -> str:
    """Check a caller's project id before anything is read."""
    if not isinstance(project_id, str) or re.fullmatch(PROJECT_ID_PATTERN, project_id) is None:
        raise ValueError(
            f"Ungültige Projekt-ID {project_id!r}: erwartet werden 2-10 Großbuchstaben, "
            "ein Bindestrich und 1-6 Ziffern (BAU-42)."
        )
    return project_id
