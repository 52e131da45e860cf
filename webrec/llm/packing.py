"""Harmonic packing of token sequences.

A length l belongs to class j = capacity // l, that is capacity/(j+1) < l <=
capacity/j, and a bin of class j takes exactly j pieces, whatever they are: no
search and no state but one open bin per class, so every worker fills bins by
itself.

Documents may be cut, which removes most of the padding of plain harmonic
packing: full sequences go first; of the rest, a piece of the next reciprocal
length capacity // (j+1) is cut off until what is left wastes at most
``slack`` of a bin of its class. Lengths at or below ``slack * capacity`` are
never cut, so a document has a few pieces at most beside its full sequences.

Three levels, all by the same filling: (0) each scan task fills bins of all
classes; what stays open, less than j pieces per class and task, goes (1) to
one task per class; what stays open there, less than j pieces per class of the
whole corpus (a constant, under 20,000 rows for 2,048), is (2) packed by best fit,
longest first. Only piece rows travel, never ids.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from webrec.llm.base import SLICE, cut_lineage, id_text
from webrec.llm.bpe import MARKS, WORD_BPE, Memo, WordBpe, byte_symbols, normal, tokens

CAPACITY = 2048
SLACK = 1 / 32
END_ID = 1

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PLACED = f"{PIECE}, sequence_id long, offset long"
FIELDS = [f.split()[0] for f in PLACED.split(", ")]


class LibraryBpe(WordBpe):
    """The same texts and words, merged by the tokenizers library."""

    def __init__(self, path: str):
        super().__init__(path)
        self.library = Tokenizer.from_file(path).model
        self.symbols = dict(enumerate(byte_symbols()))

    def word(self, word: str) -> list[int]:
        shown = word.encode("utf-8").decode("latin-1").translate(self.symbols)
        return [t.id for t in self.library.tokenize(shown)]


@lru_cache(maxsize=1)
def id_bytes(path: str = WORD_BPE) -> Callable[[str], bytes]:
    """Encoder of texts into little-endian unsigned 32-bit ids. A Python
    worker keeps it for its next tasks. Words stand once among the tokens: a
    capitalised one, or one with a mark behind it, is made of theirs."""
    bpe = LibraryBpe(path)

    def packed(token: str) -> bytes:
        body, mark = (token[:-1], token[-1]) if token[-1] in MARKS else (token, "")
        if body.isalpha():
            word = normal(body)
            if word == token:
                ids = bpe.word(word)
                return struct.pack(f"<{len(ids)}I", *ids)
            if word.isalpha() and normal(word) == word:
                return memo[word] + memo[mark] if mark else memo[word]
        ids = bpe.token(token)
        return struct.pack(f"<{len(ids)}I", *ids)

    memo = Memo(packed)
    return lambda text: b"".join(map(memo.__getitem__, tokens(text)))


def cut(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """Lengths of the pieces of a document of n tokens, in order."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        j = capacity // rest
        if capacity - j * rest <= slack * capacity:
            out.append(rest)
            break
        out.append(capacity // (j + 1))
        rest -= out[-1]
    return out


class Bins:
    """Open bins by class; a piece is a tuple with its length at place 2."""

    def __init__(self, capacity: int):
        self.capacity, self.open, self.full = capacity, defaultdict(list), []

    def add(self, piece: tuple) -> None:
        j = self.capacity // piece[2]
        self.open[j].append(piece)
        if len(self.open[j]) == j:
            self.full.append(self.open.pop(j))


def placed(bins: list[list[tuple]], first: int) -> list[tuple]:
    """Pieces with sequence and gapless offset; bins are numbered from ``first``."""
    out = []
    for n, pieces in enumerate(bins, first):
        at = 0
        for p in pieces:
            out.append((*p[:5], n, at))
            at += p[2]
    return out


def best_fit(pieces: list[tuple], capacity: int) -> list[list[tuple]]:
    """Longest first, each into the fullest bin that still takes it."""
    bins: list[list[tuple]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for p in sorted(pieces, key=lambda p: (-p[2], str(p))):
        k = bisect.bisect_left(room, (p[2], -1))
        free, b = room.pop(k) if k < len(room) else (capacity, len(bins))
        if b == len(bins):
            bins.append([])
        bins[b].append(p)
        if free > p[2]:
            bisect.insort(room, (free - p[2], b))
    return bins


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], FIELDS)


def pack(
    docs: DataFrame, path: str = WORD_BPE, capacity: int = CAPACITY, slack: float = SLACK, end_id: int = END_ID,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset``. A null or blank text is its end id alone; repeated
    rows are packed each; an empty table gives no rows. Sequences hold at most
    ``capacity`` ids, without gaps from offset 0."""

    def cut_and_fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, bins = id_bytes(path), struct.pack("<I", end_id), Bins(capacity)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    ids = memoryview(encode(text) + end)
                    start, n = 0, len(ids) // 4
                    for length in cut(n, capacity, slack):
                        bins.add((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n))
                        start += length
                if bins.full:
                    yield as_batch(placed(bins.full, number))
                    number += len(bins.full)
                    bins.full = []
        yield as_batch([(*p, None, None) for pieces in bins.open.values() for p in pieces])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, numbers = Bins(capacity), defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                for p in zip(*(c.to_pylist() for c in part.columns[:5])):
                    bins.add(p)
                out = []
                for pieces in bins.full:
                    j = capacity // pieces[0][2]
                    out += placed([pieces], (1 << 60) + (j << 40) + numbers[j])
                    numbers[j] += 1
                bins.full = []
                if out:
                    yield as_batch(out)
        yield as_batch([(*p, None, None) for pieces in bins.open.values() for p in pieces])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = [p for batch in batches for p in zip(*(c.to_pylist() for c in batch.columns[:5]))]
        yield as_batch(placed(best_fit(pieces, capacity), 2 << 60))

    first = cut_lineage(id_text(docs, id_col, text_col).mapInArrow(cut_and_fill, PLACED))
    left = first.filter("sequence_id IS NULL").withColumn("class", F.expr(f"{capacity} div length"))
    second = cut_lineage(
        left.repartition("class").sortWithinPartitions("class", F.desc("length"), "doc_id", "start").select(*FIELDS).mapInArrow(fill, PLACED)
    )
    third = second.filter("sequence_id IS NULL").coalesce(1).mapInArrow(finish, PLACED)
    done = "sequence_id IS NOT NULL"
    return first.filter(done).unionByName(second.filter(done)).unionByName(third)
