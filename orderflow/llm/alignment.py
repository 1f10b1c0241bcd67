"""Which tokens of two tokenizers cover the same bytes, and how often their ids do so in a corpus.

Both tokenizers encode a space and the text. A token covers a range of bytes; two tokens of different tokenizers that share
a byte overlap. Every token points to its farthest-right overlapping token, the last of each
component to itself, and the pointers of all tokens of a chunk are followed at once by doubling
(``p = p[p]`` until nothing changes): each ends at its component's terminal token, which labels the group. Groups
end exactly where tokens of both tokenizers end. Within a group every token of one is linked with every
token of the other.

A chunk's texts are cut into pieces that both tokenizers encode independently (``pieces``), so only distinct
pieces are encoded, aligned and written out. A document's links are counted there as distinct id
pairs with their multiplicity; a pair's document count is summed before it is shuffled. The
most frequent pairs, at most FREQUENT, go to all tasks; they are most links and all hot keys, and need no
shuffle. The links of all other pairs are joined with their counts, so every link gets its exact count.

Null and empty texts have no tokens, nor have those whose tokens do not give back the text's bytes
(a literal U+2581, say): their numbers are 0 and their hash is ''. Rows with one doc_id are
documents of their own and count apart. Texts beyond LONG_CHARS are worked through in slices that end between two words, where
there are such places. A group's cost is the product of its distinct ids. Names of special tokens
are plain text. An empty table gives no row. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderflow.llm.pieces import LETTER, Pieces, as_bytes, byte_letters, cut, long_text_slices, ranges
from orderflow.llm.tables import written
from orderflow.llm.tokens import encoder, released
from orderflow.llm.words import chunks

CHUNK_BYTES = 4 << 20
LONG_CHARS = 4 << 20
#: Pairs whose counts are sent to all tasks: 16 bytes each.
FREQUENT = 1 << 19
#: Links of a group up to which they are written out one by one before they are counted.
SMALL_GROUP = 1 << 12
#: Pair occurrences that a task adds up before it hands on the sums.
HELD_PAIRS = 1 << 21

ALIGNED = (
    "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"
)


class Table:
    """Bytes of all ids of a vocabulary, one after another."""

    def __init__(self, entries: list[bytes]) -> None:
        self.size = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        return self.bytes[ranges(self.start[ids], self.size[ids])]


class ByteLevel:
    """Ids and bytes of a byte-level file of the tokenizers library."""

    def __init__(self, path: str) -> None:
        self.encoder = encoder(path, plain=True)
        self.tokenizer = self.encoder.tokenizer
        letters, entries = byte_letters(), [b""] * self.encoder.vocabulary
        for token, number in self.tokenizer.get_vocab(with_added_tokens=True).items():
            entries[number] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.table = Table(entries)

    def encode(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, owner): the ids of all pieces and the piece that each is of."""
        ids, sizes = self.encoder.of_pieces(pieces)
        return ids.astype(np.int64), np.repeat(np.arange(len(pieces)), sizes)


class PieceModel:
    """Ids and bytes of a sentencepiece file that puts a space before every text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        self.table = Table([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)])
        own = [p for i, p in enumerate(names) if not (self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i))]
        if any("▁" in p.lstrip("▁") or "\n" in p or re.search(f"[{LETTER}][.,]$", p) for p in own):
            raise ValueError("tokens of this file reach over the ends of words")
        self.space, self.feed = self.model.piece_to_id("▁"), self.model.encode("\n")

    def encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, owner): the ids of all pieces and the piece that each is of.

        The model's own space stands for the first of a piece; other pieces follow a line feed that is dropped.
        """
        found = self.model.encode([p[1:] if p[0] == " " else "\n" + p for p in pieces], num_threads=1)
        skip = len(self.feed)
        return _flat([ids if p[0] == " " and len(p) > 1 else [self.space] if p == " " else ids[skip:] for p, ids in zip(pieces, found)])


@cache
def _tokenizers(byte_level: str, piece_model: str) -> tuple[ByteLevel, PieceModel]:
    return ByteLevel(byte_level), PieceModel(piece_model)


def components(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The terminal token of each token's component; tokens of b are numbered behind those of a.

    Tokens are given by the ends of their ranges, which lie gapless on one line of bytes.
    """
    n = len(ends_a)
    over_a, over_b = np.searchsorted(ends_b, ends_a), np.searchsorted(ends_a, ends_b)
    # the token that holds a token's last byte is the one that reaches farthest of all it overlaps
    points = np.concatenate([np.where(ends_b[over_a] > ends_a, n + over_a, np.arange(n)), over_b])
    while True:
        after = points[points]
        if np.array_equal(after, points):
            return points
        points = after


def _same_bytes(ids: np.ndarray, owner: np.ndarray, table: Table, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the tokens of each piece give back its bytes."""
    fine = np.bincount(owner, table.size[ids], len(sizes)).astype(np.int64) == sizes
    if not fine.all():
        ids, data = ids[fine[owner]], data[np.repeat(fine, sizes)]
    wrong = np.flatnonzero(table.of(ids) != data)
    if len(wrong):
        kept = np.flatnonzero(fine)
        fine[kept[np.searchsorted(np.cumsum(sizes[kept]), wrong, side="right")]] = False
    return fine


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), np.repeat(np.arange(len(lists)), sizes)


@dataclass
class Aligned:
    """The distinct pieces of a chunk: what each holds. Piece ``i``'s pairs are ``key[first[i]:first[i + 1]]``."""

    fine: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    groups: pa.Array
    key: np.ndarray
    times: np.ndarray
    first: np.ndarray


def _group_texts(a: np.ndarray, b: np.ndarray, label_a: np.ndarray, label_b: np.ndarray, owner_a: np.ndarray, owner_b: np.ndarray, n: int) -> pa.Array:
    """``a1,a2|b1;`` of all groups of each piece."""
    label, side = np.concatenate([label_a, label_b]), np.repeat([0, 1], [len(a), len(b)])
    order = np.lexsort((side, label))
    label, side, ids = label[order], side[order], np.concatenate([a, b])[order]
    owner = np.concatenate([owner_a, owner_b])[order]
    last = np.append((label[1:] != label[:-1]) | (side[1:] != side[:-1]), True) if len(ids) else np.zeros(0, bool)
    mark = np.where(last, 1 + side, 0)
    numbers, place = np.unique(ids * 3 + mark, return_inverse=True)
    words = pa.array([f"{x // 3}{',|;'[x % 3]}" for x in numbers.tolist()], pa.large_binary())
    written_out = words.take(pa.array(place)) if len(ids) else pa.array([], pa.large_binary())
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(written_out).to_numpy())])
    cuts = ends[np.searchsorted(owner, np.arange(n + 1))]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(cuts.astype(np.int64)), written_out.buffers()[2] or pa.py_buffer(b"")])


def _pairs(a, b, label_a, label_b, owner_of_group, n_groups: int, n: int, width: int):
    """(key, times, first): the distinct id pairs of each piece's links, and how many links each is."""
    first_a, first_b = np.searchsorted(label_a, np.arange(n_groups + 1)), np.searchsorted(label_b, np.arange(n_groups + 1))
    size_a, size_b = np.diff(first_a), np.diff(first_b)
    small = np.flatnonzero(size_a * size_b <= SMALL_GROUP)
    many = size_b[small]
    tokens = ranges(first_a[small], size_a[small])
    repeat = np.repeat(many, size_a[small])
    starts = np.repeat(first_b[small], size_a[small])
    keys = [np.repeat(a[tokens], repeat) * width + b[ranges(starts, repeat)]]
    owners = [np.repeat(owner_of_group[small], size_a[small] * many)]
    times = [np.ones(len(keys[0]), np.int64)]
    for g in np.flatnonzero(size_a * size_b > SMALL_GROUP):
        ids_a, often_a = np.unique(a[first_a[g] : first_a[g + 1]], return_counts=True)
        ids_b, often_b = np.unique(b[first_b[g] : first_b[g + 1]], return_counts=True)
        keys.append((ids_a[:, None] * width + ids_b).ravel())
        times.append((often_a[:, None] * often_b).ravel())
        owners.append(np.full(len(keys[-1]), owner_of_group[g]))
    key, owner, time = np.concatenate(keys), np.concatenate(owners), np.concatenate(times)
    order = np.lexsort((key, owner))
    key, owner, time = key[order], owner[order], time[order]
    new = np.append(True, (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])) if len(key) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return key[at], np.add.reduceat(time, at) if len(at) else time, np.searchsorted(owner[at], np.arange(n + 1))


def align(distinct: pa.Array, byte_level: ByteLevel, piece_model: PieceModel) -> Aligned:
    """Tokens, groups and links of each piece of ``distinct``."""
    n, names = len(distinct), as_bytes(distinct)
    (a, owner_a), (b, owner_b) = byte_level.encode(distinct), piece_model.encode([name.decode() for name in names])
    sizes = np.fromiter(map(len, names), np.int64, n)
    data = np.frombuffer(b"".join(names), np.uint8)
    fine = _same_bytes(a, owner_a, byte_level.table, data, sizes) & _same_bytes(b, owner_b, piece_model.table, data, sizes)
    for_a, for_b = fine[owner_a], fine[owner_b]
    a, owner_a, b, owner_b = a[for_a], owner_a[for_a], b[for_b], owner_b[for_b]
    # whole pieces lie behind one another on one line of bytes, on which both tokenizers' tokens end at each piece's end
    terminal = components(np.cumsum(byte_level.table.size[a]), np.cumsum(piece_model.table.size[b]))
    labels, label = np.unique(terminal, return_inverse=True)
    label_a, label_b = label[: len(a)], label[len(a) :]
    n_groups = len(labels)
    owner_of_group = owner_a[labels]
    links = np.bincount(label_a, minlength=n_groups) * np.bincount(label_b, minlength=n_groups)
    key, times, first = _pairs(a, b, label_a, label_b, owner_of_group, n_groups, n, len(piece_model.table.size))
    return Aligned(
        fine, np.bincount(owner_a, minlength=n), np.bincount(owner_b, minlength=n), np.bincount(owner_of_group, minlength=n),
        np.bincount(owner_of_group, links, n).astype(np.int64), _group_texts(a, b, label_a, label_b, owner_a, owner_b, n), key, times, first,
    )


@dataclass
class Document:
    """The numbers of one text; of a long one, summed up slice by slice."""

    fine: bool
    numbers: list[int]
    digest: object
    key: np.ndarray
    times: np.ndarray


def _documents(pieces: Pieces, held: Aligned) -> Iterator[tuple[bool, list[int], memoryview, np.ndarray, np.ndarray]]:
    """(fine, numbers, groups as text, pairs, times) of each text of a chunk."""
    of, first = pieces.of, pieces.first
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    fine = np.bincount(owner, ~held.fine[of], n) == 0
    numbers = np.stack([np.bincount(owner, x[of], n).astype(np.int64) for x in (held.n_a, held.n_b, held.n_groups, held.n_links)], axis=1)
    texts = held.groups.take(pa.array(of)) if len(of) else pa.array([], pa.large_binary())
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy())])[first].tolist()
    buffer = memoryview(texts.buffers()[2] or b"")
    # number the pairs of the chunk, so that a text and a pair fit one sortable number
    known, number = np.unique(held.key, return_inverse=True)
    sizes = held.first[of + 1] - held.first[of]
    at = ranges(held.first[of], sizes)
    both = np.repeat(owner, sizes) * max(1, len(known)) + number[at]
    order = np.argsort(both, kind="stable")
    both, often = both[order], held.times[at][order]
    start = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    often = np.add.reduceat(often, start) if len(start) else often
    both = both[start]
    key, cuts = known[both % max(1, len(known))], np.searchsorted(both, np.arange(n + 1) * max(1, len(known)))
    for i in range(n):
        yield bool(fine[i]), numbers[i].tolist(), buffer[ends[i] : ends[i + 1]], key[cuts[i] : cuts[i + 1]], often[cuts[i] : cuts[i + 1]]


def _long(text: str, tokenizers) -> Document:
    whole = Document(True, [0, 0, 0, 0], hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64))
    kept = b""
    for part in long_text_slices(text, LONG_CHARS):
        pieces = cut(pa.array([part], pa.large_string()))
        for fine, numbers, groups, key, times in _documents(pieces, align(pieces.distinct, *tokenizers)):
            whole.fine &= fine
            whole.numbers = [x + y for x, y in zip(whole.numbers, numbers)]
            whole.digest.update(kept + bytes(groups[:-1]))
            kept = b";"
            own, place = np.unique(np.concatenate([whole.key, key]), return_inverse=True)
            whole.times = np.bincount(place, np.concatenate([whole.times, times])).astype(np.int64)
            whole.key = own
    return whole


def aligned(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """What each document holds, with its distinct id pairs and the number of links of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = _tokenizers(byte_level, piece_model)
        for batch in released(batches):
            for chunk in chunks(batch, most=CHUNK_BYTES):
                texts = pc.fill_null(chunk.column("text").cast(pa.large_string()), "")
                if pc.max(pc.utf8_length(texts)).as_py() > LONG_CHARS:
                    found = [_long(" " + t, tokenizers) if t else None for t in texts.to_pylist()]
                    found = [(d.fine, d.numbers, d.digest, d.key, d.times) if d else (False, [0] * 4, b"", [], []) for d in found]
                else:
                    space, empty = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
                    pieces = cut(pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(space, texts, empty)))
                    found = _documents(pieces, align(pieces.distinct, *tokenizers))
                yield _batch(chunk, found)

    numbered = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).withColumn("row", F.monotonically_increasing_id())
    return numbered.mapInArrow(rows, ALIGNED)


def _batch(chunk: pa.RecordBatch, found) -> pa.RecordBatch:
    numbers, hashes, keys, times = [], [], [], []
    for fine, own, groups, key, often in found:
        fine = fine and own[0] > 0
        numbers.append(own if fine else [0, 0, 0, 0])
        digest = groups if hasattr(groups, "hexdigest") else hashlib.sha256(groups[:-1]) if fine else None
        hashes.append(digest.hexdigest() if fine else "")
        keys.append(np.asarray(key, np.uint32).tobytes() if fine else b"")
        times.append(np.asarray(often, np.uint32).tobytes() if fine else b"")
    columns = np.array(numbers, np.int64).reshape(-1, 4).T
    return pa.RecordBatch.from_arrays(
        [chunk.column("row"), chunk.column("doc_id"), *[pa.array(c) for c in columns], pa.array(hashes, pa.string()), pa.array(keys, pa.binary()), pa.array(times, pa.binary())],
        ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
    )


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of bytes, and how many each row holds."""
    sizes = pc.binary_length(column).to_numpy() // 4
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32), sizes


def pair_counts(documents: DataFrame) -> DataFrame:
    """(pair, n): how many documents hold a pair linked."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            keys, _ = _numbers(batch.column("pairs"))
            held.append(keys)
            size += len(keys)
            if size >= HELD_PAIRS:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, often = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(often.astype(np.int64))], ["pair", "n"])

    return documents.select("pairs").mapInArrow(rows, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame) -> tuple[int, pa.Table]:
    """(least, pairs): at most FREQUENT pairs, those with a count of ``least``, a power of two, or more."""
    by_size = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("pairs")).collect()
    total, least = 0, None
    for r in sorted(by_size, reverse=True):
        total += r.pairs
        if total > FREQUENT:
            break
        least = r.power
    if least is None:
        return 1 << 62, counts.limit(0).toArrow()
    return 1 << least, counts.where(F.col("n") >= 1 << least).toArrow()


def aligned_documents(docs: DataFrame, byte_level: str, piece_model: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row of ``docs``.

    ``n_best`` are links whose pair's document count is the highest of its first id, ``count_sum`` is
    the sum of the pairs' document counts over all links.
    """
    width = len(_tokenizers(byte_level, piece_model)[1].table.size)
    documents = written(aligned(docs, byte_level, piece_model), "aligned")
    counts = written(pair_counts(documents).withColumn("a", F.expr(f"pair div {width}")), "pair_counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("highest"))  # a row for each id of a vocabulary
    counts = written(counts.join(highest, "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "pairs")
    least, common = frequent(counts)
    order = np.argsort(common.column("pair").to_numpy())
    known = docs.sparkSession.sparkContext.broadcast(
        (common.column("pair").to_numpy()[order].astype(np.uint32), (common.column("n").to_numpy() * np.where(common.column("best").to_numpy(), 1, -1))[order])
    )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, signed = known.value  # a negative count is none of its id's highest
        for batch in batches:
            keys, sizes = _numbers(batch.column("pairs"))
            times = _numbers(batch.column("times"))[0].astype(np.int64)
            owner = np.repeat(np.arange(batch.num_rows), sizes)
            place = np.minimum(np.searchsorted(pairs, keys), max(0, len(pairs) - 1))
            hit = pairs[place] == keys if len(pairs) else np.zeros(len(keys), bool)
            count = signed[place[hit]]
            sums = np.zeros((2, batch.num_rows), np.int64)
            np.add.at(sums[0], owner[hit], times[hit] * (count > 0))
            np.add.at(sums[1], owner[hit], times[hit] * np.abs(count))
            m, other = batch.num_rows, np.flatnonzero(~hit)
            row = batch.column("row").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(row), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(sums[0]), pa.array(sums[1])], _FOUND
            )
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[owner[other]]), pa.array(keys[other].astype(np.int64)), pa.array(times[other]), *[pa.nulls(len(other), pa.int64())] * 2], _FOUND
            )

    found = written(documents.select("row", "pairs", "times").mapInArrow(rows, ", ".join(f"{c} bigint" for c in _FOUND)), "link_counts")
    rare = found.where("pair IS NOT NULL").select("row", "pair", "times").join(counts.where(F.col("n") < least), "pair").select(
        "row", F.when(F.col("best"), F.col("times")).otherwise(0).alias("n_best"), (F.col("times") * F.col("n")).alias("count_sum")
    )
    sums = found.where("pair IS NULL").select("row", "n_best", "count_sum").unionByName(rare).groupBy("row").agg(
        F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")
    )
    return documents.drop("pairs", "times").join(sums, "row").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )


_FOUND = ["row", "pair", "times", "n_best", "count_sum"]
