"""Words of whole texts as numpy arrays, read straight from Arrow buffers.

Texts are handled in chunks of bounded bytes, so memory depends on the longest single text, not on
the batch. Both word rules break at ASCII bytes only, so UTF-8 can be read byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [^\x20\x09-\x0D]
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[9, 10, 11, 12, 13, 32]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
LETTERS = np.zeros(256, dtype=bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


class Words(NamedTuple):
    doc: np.ndarray  # row of the batch
    start: np.ndarray  # byte in the batch's text buffer
    end: np.ndarray
    hash: np.ndarray  # uint64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of uint64 values (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and where each begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    if len(column) == 0 or data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8), at


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``limit`` bytes; a longer text is a run of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(size: int) -> list[np.ndarray]:
    if len(_powers[0]) < size:
        for slot, base in enumerate((_STEP, _BACK)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[slot] = np.cumprod(steps, dtype=np.uint64)
    return _powers


def words(data: np.ndarray, offsets: np.ndarray, first: int, last: int, kind: np.ndarray) -> Words:
    """All words of rows first..last-1 after lower-casing A-Z; ``kind`` marks the bytes of words."""
    low, high = int(offsets[first]), int(offsets[last])
    text = LOWER[data[low:high]]
    if not len(text):
        none = np.zeros(0, dtype=np.int64)
        return Words(none, none, none, none.astype(np.uint64))
    inside = kind[text]
    edges = offsets[first:last] - low
    fresh = np.zeros(len(text) + 1, dtype=bool)
    fresh[edges] = True
    fresh[-1] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | fresh[1:-1]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    up, down = _power(len(text) + 1)
    sums = np.zeros(len(text) + 1, dtype=np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], out=sums[1:])
    value = mix((sums[end] - sums[start]) * down[start])
    doc = np.searchsorted(edges, start, side="right") - 1 + first
    return Words(doc, start + low, end + low, value)


def shingles(found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every run of ``size`` words; a shorter text gives its whole run as one."""
    doc, value = found.doc, found.hash
    if not len(doc):
        return doc, value
    joined = value.copy()
    whole = np.zeros(len(doc), dtype=bool)
    for step in range(1, size):
        more = np.zeros(len(doc), dtype=np.uint64)
        same = doc[step:] == doc[:-step]
        more[:-step][same] = value[step:][same]
        joined = mix(joined) + more
    whole[: max(0, len(doc) - size + 1)] = doc[size - 1 :] == doc[: len(doc) - size + 1]
    begins = np.r_[True, doc[1:] != doc[:-1]]
    keep = whole | (begins & ~_enough(doc, begins, size))
    return doc[keep], mix(joined[keep])


def _enough(doc: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
    """Whether the text a word belongs to has at least ``size`` words."""
    starts = np.flatnonzero(begins)
    count = np.diff(np.r_[starts, len(doc)])
    return np.repeat(count >= size, count)
