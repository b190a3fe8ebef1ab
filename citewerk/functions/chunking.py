"""Citable spans of a text.

The span of one chunk depends on where the previous one ended, so this is the
one place of the text path with sequential state: an Arrow UDF walks each text
once and returns offsets together with the sliced text. Slicing in the UDF is
deliberate: Spark's `substring` counts code points from the start of the string,
which is quadratic for very long texts.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewerk.schemas import UNSPLITTABLE_KIND
from citewerk.settings import CHUNK_MAX_CHARS, CHUNK_OVERLAP_CHARS

# Fixed value: preferred cut points are line breaks and white space after punctuation.
BOUNDARY_PATTERN = r"\n+|(?<=[.!?:;])\s+"

_BOUNDARY = re.compile(BOUNDARY_PATTERN)
_WORD = re.compile(r"\S*")

SPAN_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("segment", T.IntegerType()),
            T.StructField("char_start", T.IntegerType()),
            T.StructField("char_end", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )
)
_SPAN_STRUCT = pa.struct(
    [
        ("segment", pa.int32()),
        ("char_start", pa.int32()),
        ("char_end", pa.int32()),
        ("text", pa.string()),
    ]
)


def spans(text: str, max_chars: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Offsets of the pieces of one text, each at most `max_chars` long."""
    size = len(text)
    if size <= max_chars:
        yield 0, size
        return
    cuts = [m.end() for m in _BOUNDARY.finditer(text)]

    def last_cut(after: int, upto: int) -> int | None:
        at = bisect_right(cuts, upto) - 1
        return cuts[at] if at >= 0 and cuts[at] > after else None

    begin = 0
    while begin + max_chars < size:
        stop = last_cut(begin, begin + max_chars) or begin + max_chars
        yield _tight(text, begin, stop)
        # Step back by the overlap onto a cut, else forward to the next word start.
        goal = max(stop - overlap, begin + 1)
        begin = last_cut(begin, goal) or min(stop, _WORD.match(text, goal - 1).end() + 1)
    if begin < size:
        yield _tight(text, begin, size)


def _tight(text: str, begin: int, stop: int) -> tuple[int, int]:
    """Drop white space at both ends; a blank span collapses onto its end."""
    piece = text[begin:stop]
    lead = len(piece) - len(piece.lstrip())
    if lead == len(piece):
        return stop, stop
    return begin + lead, stop - (len(piece) - len(piece.rstrip()))


def _span_lists(documents: Iterable[Iterable[tuple[str, str]]], max_chars: int, overlap: int):
    """Arrow list array of spans, one list per document of (kind, text) segments."""
    ends = [0]
    segment, first, last, pieces = [], [], [], []
    for parts in documents:
        for number, (kind, text) in enumerate(parts):
            whole = kind == UNSPLITTABLE_KIND
            for begin, stop in ((0, len(text)),) if whole else spans(text, max_chars, overlap):
                segment.append(number)
                first.append(begin)
                last.append(stop)
                pieces.append(text[begin:stop])
        ends.append(len(segment))
    values = pa.StructArray.from_arrays(
        [
            pa.array(segment, pa.int32()),
            pa.array(first, pa.int32()),
            pa.array(last, pa.int32()),
            pa.array(pieces, pa.string()),
        ],
        fields=list(_SPAN_STRUCT),
    )
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def _check_limits(max_chars: int, overlap: int) -> None:
    if max_chars < 1 or overlap < 0:
        raise ValueError("max_chars must be positive and overlap must not be negative")


def with_spans(
    documents: DataFrame, max_chars: int = CHUNK_MAX_CHARS, overlap: int = CHUNK_OVERLAP_CHARS
) -> DataFrame:
    """Add `spans`, the chunks of all segments in order, to documents with a `segments`
    array. The position of a span is its document-wide index; a table row is never split.
    """
    _check_limits(max_chars, overlap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [
                [(s["kind"], s["text"]) for s in row or ()]
                for row in batch.column("segments").to_pylist()
            ]
            found = _span_lists(parts, max_chars, overlap)
            yield batch.append_column(pa.field("spans", found.type), found)

    schema = T.StructType([*documents.schema.fields, T.StructField("spans", SPAN_TYPE)])
    return documents.mapInArrow(run, schema)


def text_spans(
    text: Column,
    kind: Column | None = None,
    max_chars: int = CHUNK_MAX_CHARS,
    overlap: int = CHUNK_OVERLAP_CHARS,
) -> Column:
    """Spans of a single text (one segment)."""
    _check_limits(max_chars, overlap)

    @F.arrow_udf(SPAN_TYPE)
    def run(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        pairs = zip(kinds.to_pylist(), texts.to_pylist(), strict=True)
        return _span_lists(([(k, t)] for k, t in pairs), max_chars, overlap)

    return run(text, F.lit("abschnitt") if kind is None else kind)


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def boundary_positions(texts: pa.Array) -> pa.Array:
    """Ends of all preferred cut points, in code points."""
    return pa.array(
        [[m.end() for m in _BOUNDARY.finditer(t or "")] for t in texts.to_pylist()],
        pa.list_(pa.int32()),
    )
