"""Parts of German compound words, added to the full-text index.

Anything with `parts(word)` can split: the word list of this module, or the statistical splitter
of `operators.splitter`, which is learnt from the corpus.

A word is cut in two where both sides are entries of a lexicon; the left side
may carry a linking `s`. The right-most cut wins because German compounds grow to
the left, and each side is cut further by the same rule. Precision goes before
recall: a word with no such cut gets no parts.

The lexicon is a word list of the language handed over by the caller. It does not
grow with the data, its size is checked, and it travels inside the UDF.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.functions import stretches

# Fixed values.
MIN_WORD_LENGTH = 7
MIN_PART_LENGTH = 3
MIN_NESTED_PART_LENGTH = 4
MAX_LEXICON_BYTES = 64 * 1024 * 1024

_WORD = re.compile(r"[^\W\d_]+")

class Parts(Protocol):
    """What splits words: parts of a compound in reading order, none for other words."""

    def parts(self, word: str) -> list[str]: ...


class Lexicon:
    """A checked, lower-case word list."""

    def __init__(self, words: Iterable[str]):
        self.words = frozenset(w.lower() for w in words if len(w) >= MIN_PART_LENGTH)
        size = sum(len(w.encode("utf-8")) for w in self.words)
        if size > MAX_LEXICON_BYTES:
            raise ValueError(
                f"Lexicon of {size} bytes exceeds the {MAX_LEXICON_BYTES} a task may carry"
            )

    def __reduce__(self):
        return _interned, (self.words,)

    def __contains__(self, word: str) -> bool:
        return word in self.words

    def parts(self, word: str) -> list[str]:
        return split_compound(word, self)

    def as_left_part(self, word: str) -> bool:
        return word in self.words or (word.endswith("s") and word[:-1] in self.words)


@lru_cache(maxsize=4)
def _interned(words: frozenset[str]) -> Lexicon:
    """One object per word list and worker process, so what was split is remembered there."""
    return Lexicon(words)


class NoParts:
    """Splits nothing."""

    def parts(self, word: str) -> list[str]:
        return []


NO_PARTS = NoParts()


def split_compound(word: str, lexicon: Lexicon, shortest: int = MIN_PART_LENGTH) -> list[str]:
    """Parts of one word, a part directly followed by its own parts."""
    word = word.lower()
    if len(word) < MIN_WORD_LENGTH:
        return []
    for cut in range(len(word) - shortest, shortest - 1, -1):
        left, right = word[:cut], word[cut:]
        if right in lexicon and lexicon.as_left_part(left):
            return [
                left,
                *split_compound(left, lexicon, MIN_NESTED_PART_LENGTH),
                right,
                *split_compound(right, lexicon, MIN_NESTED_PART_LENGTH),
            ]
    return []


def _run_parts(run: str, lexicon: Parts) -> Sequence[str]:
    """Parts of all compounds of a stretch without blanks; no word spans a blank."""
    found = _WORD.findall(run)
    return tuple(lexicon.parts(found[0]) if len(found) == 1 else (p for word in found for p in lexicon.parts(word)))


# Of one lexicon only: a learnt model that no task asks any more can be large.
@lru_cache(maxsize=1)
def _vocabulary(lexicon: Parts) -> stretches.Vocabulary:
    return stretches.Vocabulary(lambda run: _run_parts(run, lexicon))


def compound_parts_local(text: str, lexicon: Parts) -> str:
    runs = () if isinstance(lexicon, NoParts) else dict.fromkeys(text.split())
    return " ".join(dict.fromkeys(p for run in runs for p in _run_parts(run, lexicon)))


def first_parts(
    rows: np.ndarray, runs: np.ndarray, distinct: list[str], count: int, lexicon: Parts
) -> tuple[list[str], np.ndarray, np.ndarray, list[str]]:
    """Distinct parts of each text in order of first occurrence: joined by blanks; and as their rows,
    their numbers, and the list that these numbers count in. Takes the stretches of `stretches.runs`."""
    if isinstance(lexicon, NoParts):
        none = np.empty(0, np.int64)
        return [""] * count, none, none, []
    known = _vocabulary(lexicon)
    lists = [known[run] for run in distinct]
    numbers: dict[str, int] = {}
    flat = np.array([numbers.setdefault(p, len(numbers)) for own in lists for p in own], np.int64)
    lengths = stretches.sizes(lists)
    seen = np.repeat(rows, lengths[runs]) * max(1, len(numbers)) + flat[stretches.items(lengths, runs)]
    first = np.sort(np.unique(seen, return_index=True)[1])
    part_rows, part_numbers = np.divmod(seen[first], max(1, len(numbers)))
    parts = list(numbers)
    joined = [parts[n] for n in part_numbers.tolist()]
    ends = np.searchsorted(part_rows, np.arange(count + 1))
    return [" ".join(joined[a:b]) for a, b in zip(ends[:-1], ends[1:])], part_rows, part_numbers, parts


def compound_parts(text: Column, lexicon: Parts) -> Column:
    """Distinct parts of all compounds of a text, in order of first occurrence."""

    @F.arrow_udf(T.StringType())
    def run(texts: pa.Array) -> pa.Array:
        found: list[str] = []
        for at, count in stretches.pieces(texts):
            found += first_parts(*stretches.runs(texts.slice(at, count)), count, lexicon)[0]
        return pa.array(found, pa.string())

    return run(text)


def word_parts(word: Column, lexicon: Parts) -> Column:
    """Parts of a single word as an array.

    Declared non-deterministic so that a filter on the result is not moved below a
    `distinct`, where the UDF would run for every occurrence of a word.
    """

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(words: pa.Array) -> pa.Array:
        return pa.array(
            [lexicon.parts(w or "") for w in words.to_pylist()], pa.list_(pa.string())
        )

    return run.asNondeterministic()(word)
