"""Token ids of whole texts by a public tokenizer's file, a chunk of documents at a time.

Texts are cut into pieces that the file encodes independently of each other (``pieces``), so a
text's ids are those of its pieces, one after another. Only the distinct pieces of a chunk are looked
up; those not remembered go to the tokenizers library together. Ids are gathered as one array a chunk.

Texts are encoded as the library does with ``add_special_tokens=False``: names of special tokens in a
text become those tokens, or with ``plain`` ordinary text. Null is read as empty.
"""

from __future__ import annotations

import ctypes
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from orderflow.llm.pieces import as_bytes, byte_letters, cut, ranges

#: Pieces that a Python worker remembers. The most frequent ones come first, so a full memory stays
#: as it is, until a chunk finds less than half of its pieces in it.
REMEMBERED = 150_000

#: A piece is remembered when it comes a second time; one mark each, by hash.
_MARKS = 1 << 22

#: A word of letters that pre-tokenizers keep together, and marks that they keep together behind it.
_WORD = re.compile("([ \n]?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!#$%&*.,;:?]*)")

#: Latin-1 characters as byte-level files write the bytes they stand for.
_BYTE_LETTERS = {byte: letter for letter, byte in byte_letters().items()}

_loaded: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """The encoder of a file, once per Python worker."""
    if (path, plain) not in _loaded:
        _loaded[path, plain] = Encoder(path, plain)
    return _loaded[path, plain]


class Encoder:
    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # byte-level files open a piece behind a space with a token that holds the space
        self.spaced = self.tokenizer.encode(" a", add_special_tokens=False).tokens[0].startswith("Ġ")
        self.merge = self.tokenizer.model.tokenize
        self.feed = self._ids("\n").tobytes()
        self.marks_known: dict[str, bytes] = {}
        self.words = self._takes_words()
        self.known: dict[bytes, bytes] = {}
        self.marks = bytearray(_MARKS)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _merged(self, letters: str, space: str = "") -> bytes:
        """Ids of a word's letters, or of a run of marks, by the file's merges alone."""
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array("I", [t.id for t in self.merge(space + letters)]).tobytes()

    def _word(self, head: str, letters: str, marks: str) -> bytes:
        """Ids of a word behind a space, a line feed or nothing, and of the marks behind it."""
        if not self.spaced:
            ids = self._merged(letters.lower())
        elif head == "\n":
            ids = self.feed + self._merged(letters)
        else:
            ids = self._merged(letters, head and "Ġ")
        if not marks:
            return ids
        if marks not in self.marks_known:
            if len(self.marks_known) >= 10_000:
                self.marks_known = {}
            self.marks_known[marks] = self._merged(marks)
        return ids + self.marks_known[marks]

    def _takes_words(self) -> bool:
        """Whether the merges of letters and marks alone give the ids of such pieces in a text."""
        pieces = (" a", "The", "\nUntangled", " QUICKLY!!", " zqxvjk###", " Überführung", "\nÑandú", " Éa.,", "ß", " naïve%%%")
        return all(self._word(*_WORD.fullmatch(p).groups()) == self._ids(p).tobytes() for p in pieces)

    def _look_up(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces, each as it is in a text. Words with marks skip all that comes before the merges."""
        found: list[bytes] = [b""] * len(pieces)
        match, word, others = _WORD.fullmatch, self._word, []
        for i, piece in enumerate(pieces):
            text = piece.decode()
            own = match(text) if self.words else None
            if own:
                found[i] = word(*own.groups())
            else:
                others.append((i, text))
        apart = self.tokenizer.encode_batch_fast([text for _, text in others], add_special_tokens=False)
        for (i, _), e in zip(others, apart):
            found[i] = array("I", e.ids).tobytes()
        return found

    def _remember(self, pieces: list[bytes], found: list[bytes], of: int) -> None:
        if len(self.known) >= REMEMBERED:
            if 2 * len(pieces) < of:
                return
            self.known = {}
        marks = self.marks
        for piece, ids in zip(pieces, found):
            mark = hash(piece) & (_MARKS - 1)
            if marks[mark]:
                if len(piece) < 64:
                    self.known[piece] = ids
            else:
                marks[mark] = 1

    def of_pieces(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes): the ids of different pieces, one after another, and how many each has."""
        names = as_bytes(distinct)
        table = list(map(self.known.get, names))
        places = [i for i, ids in enumerate(table) if ids is None]
        fresh = [names[i] for i in places]
        found = self._look_up(fresh)
        for i, ids in zip(places, found):
            table[i] = ids
        self._remember(fresh, found, len(names))
        return np.frombuffer(b"".join(table), "<u4"), np.fromiter(map(len, table), np.int64, len(table)) // 4

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first): all ids of the texts, those of text ``i`` are ``ids[first[i]:first[i + 1]]``."""
        pieces = cut(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat, sizes = self.of_pieces(pieces.distinct)
        each = sizes[pieces.of]
        ids = flat[ranges((np.cumsum(sizes) - sizes)[pieces.of], each)]
        return ids, np.concatenate([[0], np.cumsum(each)])[pieces.first]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        ids, first = self.encode_array(pa.array(texts, pa.large_string()))
        raw, ends = ids.tobytes(), (4 * first).tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:])]


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; behind the last, unused memory goes back to the system, as the worker lives on."""
    try:
        yield from batches
    finally:
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)
