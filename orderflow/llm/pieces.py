"""Texts cut into pieces that tokenizers encode independently of each other, a chunk at a time.

Byte-level, word and sentencepiece BPE files all split a text at white space before any merge, so
what stands between two cuts has the same ids alone as in its text. A chunk of texts is cut by Arrow,
and only its distinct pieces meet a tokenizer. A piece holds the white space before it. Texts whose white space is
only single spaces and line feeds between words are cut at each of them, and a full stop or comma is
cut off the letter before it; all others only at spaces between two ASCII letters. Joined, the
pieces of a text are the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks cuts; texts that hold it are odd.
_CUT = "\x01"

#: White space and control characters other than the space and the line feed.
_ODD = "[\x00-\x09\x0b-\x1f\x7f-\xa0 ᠎ -‏ -  -⁤　﻿]"

#: Letters and digits that no tokenizer merges with a full stop or comma behind them.
LETTER = "A-Za-z0-9À-ÖØ-öø-įı-ɏ"

#: A full stop or comma before white space that may share a merge with the character before it.
_JOINED_STOP = f"[^{LETTER}][.,][ \n]"

_BETWEEN_WORDS = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")


@dataclass
class Pieces:
    """Text ``i`` is made of the pieces ``distinct[of[first[i]:first[i + 1]]]``, in this order.

    A piece of an odd text may be in ``distinct`` twice.
    """

    distinct: pa.Array
    of: np.ndarray
    first: np.ndarray


def byte_letters() -> dict[str, int]:
    """The letter that byte-level files write for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


def as_bytes(values: pa.Array) -> list[bytes]:
    """The UTF-8 of each string of a large string array without nulls."""
    if not len(values):
        return []
    ends = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + len(values) + 1].tolist()
    raw = (values.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def cut(texts: pa.Array) -> Pieces:
    """The pieces of a string array without nulls."""
    texts = texts.cast(pa.large_string())
    odd = pc.match_substring_regex(texts, f"{_ODD}|[ \n][ \n]|\\A\n|[ \n]\\z")
    marked = pc.replace_substring(pc.replace_substring(texts, " ", f"{_CUT} "), "\n", f"{_CUT}\n")
    apart = marked
    for stop in ".,":
        apart = pc.replace_substring(apart, f"{stop}{_CUT}", f"{_CUT}{stop}{_CUT}")
    marked = pc.if_else(pc.match_substring_regex(texts, _JOINED_STOP), marked, apart)
    where = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(where):
        marked = pc.if_else(odd, pa.scalar("", pa.large_string()), marked)
    lists = pc.split_pattern(marked, _CUT)
    sizes = lists.value_lengths().to_numpy().astype(np.int64)
    distinct, of = _distinct(lists.flatten())
    # what lies before a mark that opens a text, and an empty text, are no pieces
    empty = np.flatnonzero(pc.equal(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False))
    if len(empty):
        gone = int(empty[0])
        keep = of != gone
        sizes = np.diff(np.concatenate([[0], np.cumsum(keep)])[np.cumsum(sizes)], prepend=0)
        of = of[keep]
        of -= of > gone
        distinct = pa.concat_arrays([distinct[:gone], distinct[gone + 1 :]])
    if not len(where):
        return Pieces(distinct, of, np.concatenate([[0], np.cumsum(sizes)]))
    start = np.cumsum(sizes) - sizes
    own = [[p for p in _BETWEEN_WORDS.split(t) if p] for t in texts.take(pa.array(where)).to_pylist()]
    sizes[where] = [len(p) for p in own]
    start[where] = len(of) + np.cumsum(sizes[where]) - sizes[where]
    more, places = _distinct(pa.array([p for one in own for p in one], pa.large_string()))
    of = np.concatenate([of, places + len(distinct)])
    return Pieces(pa.concat_arrays([distinct, more]), of[ranges(start, sizes)], np.concatenate([[0], np.cumsum(sizes)]))


def _distinct(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The different values, and the place of each value among them."""
    coded = values.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).copy()


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places ``first[i]`` to ``first[i] + sizes[i] - 1`` of all ``i``, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - sizes), sizes)


def long_text_slices(text: str, most: int) -> list[str]:
    """A text in slices of about ``most`` characters, cut where pieces are; one with no such place stays whole."""
    slices, at = [], 0
    while len(text) - at > most:
        found = _BETWEEN_WORDS.search(text, at + most)
        if not found:
            break
        slices.append(text[at : found.start()])
        at = found.start()
    return [*slices, text[at:]]
