"""Vector codes: each vector is cut into parts, each part becomes the index of
its nearest codebook entry.

The nearest entries come from a trie over the distinct parts of a batch, in
lexicographic order of their components. Going down the trie depth first, each
node adds one dimension's squared differences to the vector of distances to all
entries that its parent holds, so parts with a common prefix share that work;
leaves take the argmin, weigh their part by how often it occurs and add it to
its entry's sums. A block of ``BLOCK`` siblings is worked on at once.

Vectors never move: every round reads them where they lie and sends sums per
(part, entry, dimension), pre-aggregated per task. The codebooks are
``parts x entries x dimensions`` integers, whatever the table's size, so they
may pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrec.llm.base import stored
from webrec.llm.vector_rows import matrix, usable

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK = 1024


class Trie:
    """Distinct rows of an integer matrix as a trie, one level per column."""

    def __init__(self, rows: np.ndarray):
        order = np.lexsort(rows.T[::-1])
        rows = rows[order]
        starts, new = [], np.zeros(len(rows), bool)
        new[:1] = True
        for column in rows.T:  # where the prefix up to this column begins anew
            new[1:] |= column[1:] != column[:-1]
            starts.append(np.flatnonzero(new))
        self.values = [rows[s, k] for k, s in enumerate(starts)]
        self.parents = [np.zeros(len(starts[0]), np.int64)] + [np.searchsorted(up, s, side="right") - 1 for up, s in zip(starts, starts[1:])]
        #: nodes of the next level that begin at or after each node, and its end
        self.children = [np.append(np.searchsorted(down, s), len(down)) for s, down in zip(starts, starts[1:])]
        self.leaves = rows[starts[-1]]
        self.weights = np.diff(np.append(starts[-1], len(rows)))
        leaf = np.cumsum(new) - 1
        self.leaf_of = np.empty(len(rows), np.int64)
        self.leaf_of[order] = leaf

    def nearest(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per leaf: its nearest entry, of equal ones the first, and the
        squared distance."""
        index, error = np.empty(len(self.leaves), np.int64), np.empty(len(self.leaves), np.int64)
        deepest = len(self.values) - 1

        def down(level: int, a: int, b: int, above: np.ndarray, first: int) -> None:
            for at in range(a, b, BLOCK):
                end = min(at + BLOCK, b)
                step = self.values[level][at:end, None] - entries[:, level]
                d = above[self.parents[level][at:end] - first] + step * step
                if level == deepest:
                    index[at:end] = d.argmin(1)
                    error[at:end] = d.min(1)
                else:
                    below = self.children[level]
                    down(level + 1, below[at], below[end], d, at)

        down(0, 0, len(self.values[0]), np.zeros((1, len(entries)), np.int64), 0)
        return index, error


def _integers(column: pa.Array, width: int, scale: int, parts: int) -> np.ndarray:
    """Rows x parts x dimensions of floor(scale * component)."""
    x = np.floor(matrix(column, width) * scale)
    if x.size and np.abs(x).max() > 2.0**30 / np.sqrt(max(width // parts, 1)):
        raise OverflowError("components too large: a squared distance of their integers would pass 64 bits")
    return x.astype(np.int64).reshape(len(x), parts, -1)


def _sums(width: int, scale: int, books: np.ndarray):
    parts, entries, dims = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = _integers(batch.column("vector"), width, scale, parts)
            for p in range(parts):
                trie = Trie(x[:, p])
                index, _ = trie.nearest(books[p])
                np.add.at(count[p], index, trie.weights)
                np.add.at(total[p], index, trie.leaves * trie.weights[:, None])
        p, e = np.nonzero(count)
        at = [np.repeat(p, dims), np.repeat(e, dims), np.tile(np.arange(dims), len(p)), total[p, e].ravel(), np.repeat(count[p, e], dims)]
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in at], ["part", "entry", "place", "total", "n"])

    return run


def _codes(width: int, scale: int, books: np.ndarray):
    parts = books.shape[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _integers(batch.column("vector"), width, scale, parts)
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                trie = Trie(x[:, p])
                index, d = trie.nearest(books[p])
                code[:, p] = index[trie.leaf_of]
                error += d[trie.leaf_of]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error)],
                ["vec_id", "label", "code", "error"],
            )

    return run


def _vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    return rows.filter(usable("vector"))


def fit_codebooks(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[np.ndarray, int]:
    """Codebooks (parts x entries x dimensions, integers) and the width of the
    vectors, padded so that the parts divide it.

    They start as the parts of the ``entries`` least ids (null ids last, then
    by the vector); fewer rows make fewer entries, no row none."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    rows = _vectors(df, id_col, vector_col, label_col)
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return np.zeros((parts, 0, 0), np.int64), 0
    width = -(-max(longest, 1) // parts) * parts
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    books = _integers(first["vector"].combine_chunks(), width, scale, parts).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        sums = rows.select("vector").mapInArrow(_sums(width, scale, books), "part long, entry long, place long, total long, n long")
        new = sums.groupBy("part", "entry", "place").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toArrow()
        part, entry, place, total, n = (new[c].to_numpy() for c in ("part", "entry", "place", "total", "n"))
        books = books.copy()
        books[part, entry, place] = total // n
    return books, width


def vector_codes(
    df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` per vector.

    Components become ``floor(scale * x)``. Rows whose vector is null or holds
    a component that is null or not finite are dropped. A vector shorter than
    the longest counts as if zeros followed, and the width is padded with zeros
    to a multiple of ``parts``. Repeated rows stay, and count each time; an
    empty table gives no rows; null labels are one label; other columns are not
    read. Ties go to the lower index. Integers beyond 2**30 over the root of a
    part's dimensions raise OverflowError, as ``error`` could not hold them."""
    books, width = fit_codebooks(df, parts, entries, rounds, scale, id_col, vector_col, label_col)
    rows = _vectors(df, id_col, vector_col, label_col)
    label = rows.schema["label"].dataType.simpleString()
    coded = stored(rows.mapInArrow(_codes(width, scale, books), f"vec_id long, label {label}, code string, error long"))
    # stored: one row per label on one side, two plain shuffles a planner may split where the labels do not fit a broadcast
    sums = stored(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return coded.join(sums, coded["label"].eqNullSafe(sums["of"])).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
