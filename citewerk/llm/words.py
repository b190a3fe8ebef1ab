"""Words of whole texts as 64-bit hashes, computed over bytes in numpy.

A word is a run of bytes other than space, tab, LF, VT, FF and CR, after lower-casing A-Z. Its
hash is a polynomial over random 64-bit values of its bytes, taken from one running sum over the
buffer, and a final mix. Long texts go through in blocks that end between words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_BACK = pow(_BASE, -1, 1 << 64)


def _byte_values() -> np.ndarray:
    """A random odd value per byte; A-Z share those of a-z."""
    values = np.random.default_rng(20_240_611).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
    values[65:91] = values[97:123]
    return values


_VALUES = _byte_values()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    rounded = max(1 << 16, 1 << (size - 1).bit_length())
    if rounded not in _powers:
        tables = []
        for base in (_BASE, _BASE_BACK):
            table = np.full(rounded, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        if rounded > 2 * BLOCK_BYTES:
            return tables[0], tables[1]  # a word longer than a block; not kept
        _powers[rounded] = (tables[0], tables[1])
    return _powers[rounded]


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(32)
    return x


def _block_words(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, bytes) of the words of one block."""
    data = np.frombuffer(block, np.uint8)
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = ~_SPACE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    power, back = _power_tables(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_VALUES[data] * power[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * back[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts, ends, data


def _blocks(text: bytes) -> Iterator[bytes]:
    at = 0
    while len(text) - at > BLOCK_BYTES:
        gap = _GAP.search(text, at + BLOCK_BYTES)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.end()
    yield text[at:] if at else text


def word_hashes(texts: list[bytes], endings: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, number of words per text) of all texts.

    With `endings` (a power of two) the low bits of a hash are a class of the word's last two
    bytes instead.
    """
    found: list[np.ndarray] = []
    sizes = np.zeros(len(texts), np.int64)
    batch: list[bytes] = []
    members: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not batch:
            return
        hashes, starts, ends, data = _block_words(b"\n".join(batch))
        if endings:
            last = data[ends - 1].astype(np.uint64)
            before = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
            kind = mix(_VALUES[last] ^ (before | np.uint64(32)) * np.uint64(_BASE))
            low = np.uint64(endings - 1)
            hashes = (hashes & ~low) | (kind & low)
        found.append(hashes)
        limits = np.cumsum([len(b) + 1 for b in batch])
        per = np.diff(np.searchsorted(starts, limits), prepend=0)
        np.add.at(sizes, members, per)
        batch.clear()
        members.clear()
        held = 0

    for k, text in enumerate(texts):
        for block in _blocks(text):
            if held + len(block) > BLOCK_BYTES:
                flush()
            batch.append(block)
            members.append(k)
            held += len(block) + 1
    flush()
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), sizes
