"""Stretches between blanks of many texts at once, each distinct one looked at once.

No token and no word spans a blank, and stretches repeat heavily: a batch is split by Arrow, Python
sees its distinct stretches, and numpy puts what they become in the places of the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Stretches between blanks that a worker remembers, and the longest of them.
REMEMBERED, LONGEST_REMEMBERED = 1 << 18, 64
#: Texts are lexed in pieces of so many bytes, or of one text: what a task holds beside its batch stays small.
PIECE_BYTES = 1 << 23


class Vocabulary(dict):
    """What each stretch between blanks becomes, worked out when it is first met.

    Stretches repeat heavily; the bounds keep this below some 90 MB a worker.
    """

    def __init__(self, become: Callable[[str], tuple]):
        super().__init__()
        self.become = become

    def __missing__(self, run: str) -> tuple:
        made = self.become(run)
        if len(self) < REMEMBERED and len(run) <= LONGEST_REMEMBERED:
            self[run] = made
        return made


def pieces(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of pieces of `PIECE_BYTES`, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        read = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, read + PIECE_BYTES, side="right")))
        yield at, stop - at
        at = stop


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Of each stretch its row and its number among the distinct ones, and these; null counts as empty."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    known = lists.flatten().dictionary_encode()
    rows = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    return rows, known.indices.to_numpy(zero_copy_only=False), known.dictionary.to_pylist()


def items(sizes: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """Places of the items of picked lists, one list after the other, where lists of `sizes` lie end to end."""
    own = sizes[picked]
    ends = np.cumsum(own)
    first = np.cumsum(sizes) - sizes
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[picked] - ends + own, own)


def sizes(lists: Sequence[Sequence]) -> np.ndarray:
    return np.fromiter(map(len, lists), np.int64, len(lists))


def list_offsets(rows: np.ndarray, lengths: np.ndarray, count: int) -> pa.Array:
    """Where the lists of `count` rows begin and end, made of lists of these lengths in these rows."""
    totals = np.bincount(rows, weights=lengths, minlength=count).astype(np.int64)
    return pa.array(np.concatenate([[0], np.cumsum(totals)]), pa.int32())
