"""Text expressions. All stay in the JVM except Unicode normalisation."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _normaliser(form: str):
    @F.arrow_udf(T.StringType())
    def normalise(values: pa.Array) -> pa.Array:
        return pa.array(
            [None if v is None else unicodedata.normalize(form, v) for v in values.to_pylist()],
            pa.string(),
        )

    return normalise


nfc = _normaliser("NFC")  # paths and file names
nfkc = _normaliser("NFKC")  # text layers of PDF pages


# All Unicode white space; the separators U+001C to U+001F are missing from Java's \s.
WHITE_SPACE = r"(?U)[\s\x1c-\x1f]+"


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITE_SPACE, " "))


def citation(project_id: Column, file_name: Column, locator: Column, date: Column) -> Column:
    """`project · file · locator · dd.MM.yyyy`; a NULL date drops out."""
    return F.concat_ws(" · ", project_id, file_name, locator, F.date_format(date, "dd.MM.yyyy"))


def source_line(citation_text: Column, document_id: Column) -> Column:
    return F.concat(citation_text, F.lit(" · Version "), F.substring(document_id, 1, 8))


def thousands(number: Column) -> Column:
    return F.translate(F.format_number(number, 0), ",", ".")


def table_cell(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]+", "-"), r"\A-+|-+\z", "")


def is_quoted(excerpt: Column, heading: Column, text: Column) -> Column:
    """Whether the excerpt occurs verbatim, white space aside; an empty or NULL one never does."""
    needle = collapse_whitespace(excerpt)
    haystack = collapse_whitespace(F.concat(F.coalesce(heading, F.lit("")), F.lit(" "), text))
    return F.coalesce((F.length(needle) > 0) & F.contains(haystack, needle), F.lit(False))


def source_element(
    chunk_id: Column,
    file_name: Column,
    doc_type: Column,
    locator: Column,
    date: Column,
    heading: Column,
    text: Column,
) -> Column:
    """One delivered source as the tagged block a generator reads."""
    shown_date = F.coalesce(F.date_format(date, "yyyy-MM-dd"), F.lit("unbekannt"))
    heading_line = F.when(
        F.length(heading) > 0, F.concat(F.lit("Überschrift: "), heading, F.lit("\n"))
    ).otherwise("")
    attributes = [
        ("id", chunk_id),
        ("datei", file_name),
        ("art", doc_type),
        ("stelle", locator),
        ("datum", shown_date),
    ]
    pieces: list[Column] = [F.lit("<quelle")]
    for name, value in attributes:
        pieces += [F.lit(f' {name}="'), value, F.lit('"')]
    pieces += [F.lit(">\n"), heading_line, text, F.lit("\n</quelle>")]
    return F.concat(*pieces)


def match_form(text: Column) -> Column:
    """Lower case, en dash as hyphen, single spaces: the form terms are compared in."""
    return collapse_whitespace(F.translate(F.lower(text), "–", "-"))


def _contains_term(text: Column, term: str) -> Column:
    """Substring test; a term that starts with a digit may not continue a number."""
    if not term[0].isdigit():
        return F.contains(text, F.lit(term))
    quoted = "".join("\\" + c if not c.isalnum() and c != " " else c for c in term)
    return text.rlike(r"(^|[^\d])" + quoted)


def matches_terms(normalised: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Every group must be hit by at least one of its alternatives."""
    verdict = F.lit(True)
    for group in groups:
        hit = F.lit(False)
        for term in group:
            hit = hit | _contains_term(normalised, term)
        verdict = verdict & hit
    return verdict


def passage_text(heading: Column, text: Column) -> Column:
    """Encoder input of a stored text; the heading is context for the encoder only."""
    return F.when(
        F.length(heading) > 0, F.concat(F.lit("passage: "), heading, F.lit("\n"), text)
    ).otherwise(F.concat(F.lit("passage: "), text))


def query_text(question: str) -> str:
    return "query: " + question.strip()
