"""Search tokens and lexemes of a text, shared by stored texts and questions.

One Arrow UDF goes from text to lexemes: as JVM expressions (`regexp_extract_all`
plus higher-order functions) the same work measured more than twice as slow.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Collection, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.functions import stretches
from citewerk.functions.compounds import NO_PARTS, Parts, compound_parts_local, first_parts
from citewerk.functions.german import lexeme, stem, stop_words

# Words (hyphenated ones as a whole), digit-led codes, signed and dotted numbers.
_TOKEN = re.compile(
    r"[^\W\d_][^\W_]*(?:-[^\W\d_][^\W_]*)*"
    r"|\d+[^\W\d_][^\W_]*"
    r"|[-+]?\d+(?:\.\d+)*"
)


_PLAIN = re.compile(r"[^\W\d_]+")


def tokens_of(text: str) -> list[str]:
    """Lower-case tokens in order; a hyphenated word is followed by its parts."""
    found: list[str] = []
    for run in text.lower().split():
        found += _run_tokens(run)
    return found


def _run_tokens(run: str) -> list[str]:
    """Tokens of a stretch without blanks; no token spans a blank."""
    if _PLAIN.fullmatch(run):
        return [run]
    found = []
    for token in _TOKEN.findall(run):
        found.append(token)
        if "-" in token and token[0].isalpha():
            found += token.split("-")
    return found


_DIGIT = re.compile(r"\d")
_FIRST = (0,)


def _form(token: str) -> str:
    """`german.index_form` without a memory of its own."""
    return token if _DIGIT.search(token) else stem(token)


@lru_cache(maxsize=2)
def _vocabulary(stops: frozenset[str]) -> stretches.Vocabulary:
    """(number of tokens, lexemes, place of each): stop words take a place, too."""

    def become(run: str) -> tuple:
        found = _run_tokens(run.lower())
        if len(found) == 1:
            return (1, (), ()) if found[0] in stops else (1, (_form(found[0]),), _FIRST)
        kept = [(n, _form(t)) for n, t in enumerate(found) if t not in stops]
        return len(found), tuple(w for _, w in kept), tuple(n for n, _ in kept)

    return stretches.Vocabulary(become)


def _string_lists(texts: pa.Array, become: Callable[[str], Sequence[str]]) -> pa.Array:
    """For each text what its stretches become, in order."""
    made = [pa.array([], pa.list_(pa.string()))]
    for at, count in stretches.pieces(texts):
        rows, runs, distinct = stretches.runs(texts.slice(at, count))
        lists = [become(run) for run in distinct]
        lengths = stretches.sizes(lists)
        words = pa.array(list(chain.from_iterable(lists)), pa.string())
        words = words.take(pa.array(stretches.items(lengths, runs)))
        made.append(pa.ListArray.from_arrays(stretches.list_offsets(rows, lengths[runs], count), words))
    return pa.concat_arrays(made)


@F.arrow_udf(T.ArrayType(T.StringType()))
def tokens(texts: pa.Array) -> pa.Array:
    return _string_lists(texts, lambda run: _run_tokens(run.lower()))


def lexemes(text: Column, stops: Collection[str] | None = None) -> Column:
    """Stemmed tokens without stop words, repetitions kept, in order.

    Each Python worker remembers what it has seen, so nothing is shuffled to find the distinct words.
    """
    stops = stop_words() if stops is None else frozenset(stops)

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(texts: pa.Array) -> pa.Array:
        known = _vocabulary(stops)
        return _string_lists(texts, lambda run: known[run][1])

    return run(text)


@F.arrow_udf(
    T.ArrayType(
        T.StructType(
            [T.StructField("lexeme", T.StringType()), T.StructField("positions", T.IntegerType())]
        )
    )
)
def lexeme_counts(lexemes_per_text: pa.Array) -> pa.Array:
    """Distinct lexemes of each text with their number of positions."""
    ends, words, counts = [0], [], []
    for found in lexemes_per_text.to_pylist():
        counted = Counter(found or ())
        words += counted.keys()
        counts += counted.values()
        ends.append(len(words))
    entries = pa.StructArray.from_arrays(
        [pa.array(words, pa.string()), pa.array(counts, pa.int32())], names=["lexeme", "positions"]
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)


INDEX_TERMS = T.StructType(
    [
        T.StructField("compound_terms", T.StringType()),
        T.StructField("lexemes", T.ArrayType(T.StringType())),
        T.StructField("places", T.ArrayType(T.IntegerType())),
    ]
)


def index_terms(
    heading: Column, text: Column, lexicon: Parts, stops: Collection[str] | None = None
) -> Column:
    """struct<compound_terms, lexemes, places> of a chunk: the parts of its compounds, and the
    lexemes of heading, text and those parts with their places. One pass over the text for all.
    """
    stops = stop_words() if stops is None else frozenset(stops)

    @F.arrow_udf(INDEX_TERMS)
    def run(headings: pa.Array, texts: pa.Array) -> pa.Array:
        known = _vocabulary(stops)
        whole = pc.binary_join_element_wise(pc.fill_null(headings, ""), pc.fill_null(texts, ""), " ")
        made = [_placed(whole.slice(at, count), known, lexicon) for at, count in stretches.pieces(whole)]
        return pa.concat_arrays([pa.array([], _TERMS), *made])

    return run(heading, text)


_TERMS = pa.struct(
    [("compound_terms", pa.string()), ("lexemes", pa.list_(pa.string())), ("places", pa.list_(pa.int32()))]
)


def _placed(texts: pa.Array, known: stretches.Vocabulary, lexicon: Parts) -> pa.Array:
    """INDEX_TERMS of some texts: the parts of a text's compounds follow its own stretches."""
    count = len(texts)
    rows, runs, distinct = stretches.runs(texts)
    terms, part_rows, part_numbers, parts = first_parts(rows, runs, distinct, count, lexicon)
    runs = np.concatenate([runs, part_numbers + len(distinct)])
    rows = np.concatenate([rows, part_rows])
    order = np.argsort(rows, kind="stable")
    rows, runs = rows[order], runs[order]
    become = [known[run] for run in chain(distinct, parts)]

    tokens_in = np.array([b[0] for b in become], np.int64)[runs]
    ends = np.cumsum(tokens_in)
    before = np.concatenate([[0], ends])[np.searchsorted(rows, np.arange(count))]  # tokens of earlier texts
    at = ends - tokens_in - before[rows]

    lengths = stretches.sizes([b[1] for b in become])
    items = pa.array(stretches.items(lengths, runs))
    words = pa.array(list(chain.from_iterable(b[1] for b in become)), pa.string()).take(items)
    inner = np.array(list(chain.from_iterable(b[2] for b in become)), np.int64)
    places = pa.array(inner[items.to_numpy()] + np.repeat(at, lengths[runs]), pa.int32())
    offsets = stretches.list_offsets(rows, lengths[runs], count)
    lists = [pa.ListArray.from_arrays(offsets, words), pa.ListArray.from_arrays(offsets, places)]
    return pa.StructArray.from_arrays([pa.array(terms, pa.string()), *lists], fields=list(_TERMS))


def question_lexemes(
    question: str, lexicon: Parts = NO_PARTS, stops: Collection[str] | None = None
) -> list[str]:
    """Distinct lexemes of a question and of the parts of its compounds.

    A question is normalised twice: its lexemes are read again as words when the
    alternatives are formed, so a stem that is itself a stop word drops out.
    """
    stops = stop_words() if stops is None else frozenset(stops)
    parts = compound_parts_local(question, lexicon)
    kept: dict[str, None] = {}
    for token in tokens_of(f"{question} {parts}"):
        once = lexeme(token, stops)
        twice = lexeme(once, stops) if once else None
        if twice:
            kept[twice] = None
    return list(kept)
