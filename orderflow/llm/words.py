"""Words of whole texts as numpy arrays, a chunk of documents at a time.

A word is a run of bytes other than the six ASCII white-space bytes, so a text's words are
those of the pattern ``[^\\x20\\x09-\\x0D]+``. Null texts are read as empty. Everything works on
the UTF-8 buffers that Arrow hands over; no text is cut, a long text is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A chunk takes documents until it holds this many bytes: arrays of 8 bytes a byte stay small.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_CODES = np.random.default_rng(20240611).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER_CODES = _CODES.copy()
_LOWER_CODES[65:91] = _CODES[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


@dataclass
class Texts:
    """Bytes of several texts; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray


@dataclass
class Words:
    """Word ``j`` is ``data[start[j]:end[j]]``; text ``i`` has words ``first[i]`` to ``first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def texts_of(column: pa.Array) -> Texts:
    """The buffer of a string column; nulls become empty."""
    values = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1]
    if len(values) == 0 or offsets[-1] == offsets[0]:
        return Texts(np.zeros(0, np.uint8), np.zeros(len(values) + 1, np.int64))
    data = np.frombuffer(values.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return Texts(data, offsets - offsets[0])


def chunks(batch: pa.RecordBatch, column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts hold about ``most`` bytes, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield batch.slice(at, upto - at)
        at = upto


def words_of(texts: Texts) -> Words:
    data, offsets = texts.data, texts.offsets
    n = len(data)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(opens)
    return Words(start, np.flatnonzero(closes) + 1, np.searchsorted(start, offsets))


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of SplitMix64)."""
    z = values ^ (values >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def word_hashes(texts: Texts, words: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; with ``lower``, A-Z count as a-z.

    A polynomial over random codes of the bytes, so all words come from one prefix sum.
    """
    n = len(texts.data)
    if len(words.start) == 0:
        return np.zeros(0, np.uint64)
    up, down = _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER_CODES if lower else _CODES)[texts.data] * up, out=sums[1:])
    raw = (sums[words.end] - sums[words.start]) * down[words.start]
    return mix(raw + (words.end - words.start).astype(np.uint64))


def sums_by_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
