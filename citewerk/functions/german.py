"""German word stems and stop words for full-text search.

The stemmer follows the published Snowball description for German (the variant
without the ae/oe/ue spellings).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published algorithm.
VOWELS = "aeiouyäöü"
S_ENDING = "bdfghklmnrt"
ST_ENDING = "bdfghklmnt"
STEP1_SUFFIXES = ("em", "ern", "er", "e", "en", "es", "s")
STEP2_SUFFIXES = ("en", "er", "est", "st")
STEP3_SUFFIXES = ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit")

_UMLAUTS = re.compile("[UYäöü]")
_GLIDE = re.compile(f"([{VOWELS}])([uy])([{VOWELS}])")
_REGION = re.compile(f"[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]")
_DIGIT = re.compile(r"\d")
_FOLD = str.maketrans("UYäöü", "uyaou")


def _ending(choices: Iterable[str]):
    """Finder of the longest of some endings; '' where a word has none of them."""
    by_size = {size: frozenset(c for c in choices if len(c) == size) for size in {len(c) for c in choices}}
    longest_first = sorted(by_size.items(), reverse=True)

    def find(word: str) -> str:
        for size, endings in longest_first:
            if word[-size:] in endings:
                return word[-size:]
        return ""

    return find


_step1, _step2, _step3 = map(_ending, (STEP1_SUFFIXES, STEP2_SUFFIXES, STEP3_SUFFIXES))


def _fold(word: str) -> str:
    return word.translate(_FOLD) if _UMLAUTS.search(word) else word


def stem(word: str) -> str:
    """Stem of one lower-case word."""
    if "ß" in word:
        word = word.replace("ß", "ss")
    if "u" in word or "y" in word:
        word = _GLIDE.sub(lambda m: m[1] + m[2].upper() + m[3], word)
    head = _REGION.match(word)
    if head is None or len(word) < 3:
        return _fold(word)
    tail = _REGION.match(word, head.end())
    r1 = max(head.end(), 3)
    r2 = tail.end() if tail else len(word)

    ending = _step1(word)
    if ending and len(word) - len(ending) >= r1:
        if ending != "s":
            word = word[: -len(ending)]
            if ending in ("e", "en", "es") and word.endswith("niss"):
                word = word[:-1]
        elif word[-2] in S_ENDING:
            word = word[:-1]

    ending = _step2(word)
    if ending and len(word) - len(ending) >= r1:
        if ending != "st" or (len(word) >= 6 and word[-3] in ST_ENDING):
            word = word[: -len(ending)]

    ending = _step3(word)
    if ending and len(word) - len(ending) >= r2:
        rest = word[: -len(ending)]
        room = len(rest) - 2
        if ending in ("ig", "ik", "isch"):
            word = word if rest.endswith("e") else rest
        elif ending in ("end", "ung"):
            drop = rest.endswith("ig") and not rest.endswith("eig") and room >= r2
            word = rest[:-2] if drop else rest
        elif ending in ("lich", "heit"):
            word = rest[:-2] if rest.endswith(("er", "en")) and room >= r1 else rest
        elif rest.endswith("lich"):
            word = rest[:-4] if room - 2 >= r2 else rest
        else:
            word = rest[:-2] if rest.endswith("ig") and room >= r2 else rest
    return _fold(word)


@lru_cache(maxsize=1)
def stop_words() -> frozenset[str]:
    """The German stop words Spark ships; 231 entries, a fixed size."""
    from pyspark.ml.feature import StopWordsRemover

    return frozenset(StopWordsRemover.loadDefaultStopWords("german"))


# Words repeat heavily and Python workers outlive a task, so the forms are remembered per
# worker process; the size bound keeps that below some 50 MB.
@lru_cache(maxsize=1 << 18)
def index_form(token: str) -> str:
    """Index form of a token: its stem, but numbers and codes unchanged."""
    return token if _DIGIT.search(token) else stem(token)


def lexeme(token: str, stops: frozenset[str]) -> str | None:
    """Index form of a token, NULL for a stop word."""
    return None if token in stops else index_form(token)


@F.arrow_udf(T.StringType())
def stem_words(words: pa.Array) -> pa.Array:
    return pa.array([None if w is None else stem(w) for w in words.to_pylist()], pa.string())

