"""Embedding near-duplicates by products of int8 tiles.

Vectors are stored in tiles of at most ``TILE_BYTES``, as they came. Where tiles
meet, each vector is brought to unit length and to int8 codes with a scale. A
code ``q`` with scale ``s`` stands for ``s q``; its error ``e = |u - s q|`` is
measured, so for two vectors

    |u.v - s t q.r|  <=  (|s q| + e) (|t r| + f) - |s q| |t r|

holds whatever the data (Cauchy and Schwarz). The product of two code tiles is
one matrix product, exact in single precision, as its sums of integers stay
below 2**24. Only pairs whose upper bound reaches the threshold are looked at,
and of those only pairs whose lower bound does not are computed again in double
precision from the vectors. Nothing is approximate.

Tiles are dealt to blocks in the order of their bytes; a task compares two
blocks, so each tile travels once per block. Products are made a stripe of
``STRIPE`` numbers at a time, and the links of a stripe are counted and joined
into components before the next, so a task holds its two blocks and one stripe,
however many links there are. No pair leaves a task: it returns, per vector,
how many links it found and one other vector of its component there, which
keeps a group of copies linear. Vectors of different lengths are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webrec.llm.base import SLICE, cut_lineage, stored
from webrec.llm.components import components
from webrec.llm.vector_rows import flat, usable

THRESHOLD = 0.95
#: Rows (2**ROW_BITS) and bytes of a tile at most, and bytes of tiles not yet
#: full that a task holds.
ROW_BITS = 11
TILE_BYTES = 1 << 18
HELD_BYTES = 1 << 25
#: Vectors of a block where the table is small, blocks up to which blocks grow
#: with the table instead of their number, and bytes of a block at most.
BLOCK = 4096
BLOCKS = 24
BLOCK_BYTES = 1 << 23
#: Bytes that one task deals out, tasks at most that compare (each may compare
#: several pairs of blocks, one after the other; what is known of each task's
#: share by each that deals stays small), and numbers of a product held at once.
DEALT_BYTES = 1 << 26
TASKS = 10_000
STRIPE = 1 << 19
#: Integer sums of so many products of codes stay below 2**24.
EXACT_DIMS = 1024

TILES = "tile long, dims int, n int, ids array<long>, before long, bytes long, vectors binary"


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows at length one, in double precision; they may not be zero. Large and
    tiny components neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantise(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales, lengths of what the codes stand for, and lengths of the
    difference to the vectors, rounded up."""
    scale = np.abs(u).max(1) / 127
    codes = np.rint(u / scale[:, None]).astype(np.int8)
    back = codes * scale[:, None]
    up = 1 + 1e-12
    return codes, scale, np.sqrt((back * back).sum(1)) * up, np.sqrt(((u - back) ** 2).sum(1)) * up + 1e-15


def _tile(key: int, ids: list, x: np.ndarray, before: int = 0) -> list:
    return [key, x.shape[1], len(x), ids, before, x.nbytes, x.tobytes()]


def _tiled(dtype: str):
    """Rows of one length, at most a tile of them, to a row; a tile's number
    comes from the task's and its own within the task, shifted so that a row
    number in the tile fits. Next to it are the bytes of the task's tiles before."""
    names = [f.split()[0] for f in TILES.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, before, held, held_bytes = TaskContext.get().partitionId(), 0, 0, {}, 0

        def out(ids, x):
            nonlocal made, before
            row = _tile((task << 28 | made) << ROW_BITS, ids, x, before)
            made, before = made + 1, before + x.nbytes
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

        def rest():
            for ids, parts in held.values():
                if ids:
                    yield out(ids, np.concatenate(parts))
            held.clear()

        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            values, sizes = flat(batch.column("vector"))
            ends, all_ids = np.cumsum(sizes), batch.column("vec_id").to_pylist()
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                x = values[(ends[at] - dims)[:, None] + np.arange(dims)].astype(dtype)
                size = max(1, min(1 << ROW_BITS, TILE_BYTES // (x.itemsize * dims)))
                ids, parts = held.setdefault(dims, ([], []))
                while len(at):
                    room = size - len(ids)
                    ids += [all_ids[k] for k in at[:room]]
                    parts.append(x[:room])
                    held_bytes += parts[-1].nbytes
                    at, x = at[room:], x[room:]
                    if len(ids) == size:
                        held_bytes -= sum(p.nbytes for p in parts)
                        yield out(ids, np.concatenate(parts))
                        ids, parts = held[dims] = [], []
            if held_bytes > HELD_BYTES:
                yield from rest()
                held_bytes = 0
        yield from rest()

    return work


class Tile:
    """Stored tiles of one vector length, read as one."""

    def __init__(self, *rows: dict):
        self.dims, self.n = rows[0]["dims"], sum(r["n"] for r in rows)
        self.row = np.concatenate([r["tile"] + np.arange(r["n"]) for r in rows])
        self.unit, self.codes = np.empty((self.n, self.dims)), np.empty((self.n, self.dims), np.float32)
        self.scale, self.norm, self.error = (np.empty(self.n) for _ in range(3))
        at = 0
        for r in rows:
            part, width = slice(at, at := at + r["n"]), len(r["vectors"]) // (r["n"] * self.dims)
            self.unit[part] = unit_rows(np.frombuffer(r["vectors"], f"f{width}").reshape(r["n"], -1))
            self.codes[part], self.scale[part], self.norm[part], self.error[part] = quantise(self.unit[part])
        self.links = np.zeros(self.n, np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All products of codes, exact."""
    if a.shape[1] <= EXACT_DIMS:
        return a @ b.T
    parts = (a[:, k : k + EXACT_DIMS] @ b[:, k : k + EXACT_DIMS].T for k in range(0, a.shape[1], EXACT_DIMS))
    return sum(p.astype(np.float64) for p in parts)


def _stripe(a: Tile, b: Tile, x: slice, y: slice, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """``linked`` for some rows of both."""
    near = _product(a.codes[x], b.codes[y])
    near *= b.scale[y].astype(near.dtype)
    # an upper bound for all pairs at once; the slack covers the single precision of the scaling
    e, f = a.error[x].max(), b.error[y].max()
    widest = e * b.norm[y].max() + f * a.norm[x].max() + e * f
    at = np.flatnonzero(near >= ((threshold - widest - 1e-5) / a.scale[x]).astype(near.dtype)[:, None])
    i, j = np.divmod(at, near.shape[1])
    i, j, near = i + x.start, j + y.start, near.ravel()[at]
    if a is b:
        i, j, near = i[i < j], j[i < j], near[i < j]
    estimate = near.astype(np.float64) * a.scale[i]
    bound = (a.norm[i] + a.error[i]) * (b.norm[j] + b.error[j]) - a.norm[i] * b.norm[j] + 1e-5
    sure = estimate - bound >= threshold
    open_ = np.flatnonzero(~sure & (estimate + bound >= threshold))
    step = max(1, (1 << 20) // a.dims)
    for at in range(0, len(open_), step):
        k = open_[at : at + step]
        sure[k] = np.einsum("ij,ij->i", a.unit[i[k]], b.unit[j[k]]) >= threshold
    return i[sure], j[sure], len(open_)


def _stripes(a: Tile, b: Tile, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """``linked``, a stripe of pairs at a time."""
    if a.dims != b.dims:
        return
    down = 512
    across = STRIPE // down
    for x in range(0, a.n, down):
        for y in range(x if a is b else 0, b.n, across):
            yield _stripe(a, b, slice(x, min(x + down, a.n)), slice(y, min(y + across, b.n)), threshold)


def linked(a: Tile, b: Tile, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows of ``a`` and ``b`` with a cosine of at least the threshold, pair by
    pair (each once where the tiles are the same), and how many pairs were
    computed in full precision."""
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), 0), *_stripes(a, b, threshold)]
    i, j, n = zip(*found)
    return np.concatenate(i), np.concatenate(j), sum(n)


def _together(least: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the groups of ``a`` and ``b``, pair by pair; ``least`` is the least
    member of everyone's group, before and after."""
    a, b = least[a], least[b]
    while (apart := a != b).any():
        a, b = a[apart], b[apart]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(new := least[least], least):
            least[:] = new
        a, b = least[a], least[b]


def _compare(threshold: float):
    names = ["row", "links", "other"]

    def work(key: tuple, group: pa.Table) -> pa.Table:
        g, h = (k.as_py() for k in key)
        sides: dict = {g: {}, h: {}}
        for row in sorted(group.to_pylist(), key=lambda r: r["tile"]):
            sides[row["block"]].setdefault(row["dims"], []).append(row)
        for of in sides.values():
            of.update({dims: Tile(*rows) for dims, rows in of.items()})
        tiles = [t for of in sides.values() for t in of.values()]
        rows = np.sort(np.concatenate([t.row for t in tiles]))
        least = np.arange(len(rows))
        place = {id(t): np.searchsorted(rows, t.row) for t in tiles}
        for dims, a in sides[g].items():
            if b := sides[h].get(dims):
                for i, j, _ in _stripes(a, b, threshold):
                    if len(i):
                        a.links += np.bincount(i, minlength=a.n)
                        b.links += np.bincount(j, minlength=b.n)
                        _together(least, place[id(a)][i], place[id(b)][j])
        out = [[t.row[t.links > 0], t.links[t.links > 0], rows[least[place[id(t)][t.links > 0]]]] for t in tiles]
        return pa.table({c: np.concatenate(x) for c, x in zip(names, zip(*out))})

    return work


def near_vectors(
    df: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row: to how many other rows
    the cosine is at least the threshold, the least id reachable over such
    links, and whether that is the row's own.

    Vectors that are null, empty, zero, or hold a null or a number that is not
    finite have no links, nor have vectors of different lengths one another.
    Repeated rows are vectors of their own, linked with each other. Null ids
    take part; they are a component's id only where it has no other. An empty
    table gives no rows; other columns are not read.

    ``block`` is the number of vectors that a task compares with as many others
    in a small table; in a larger one it is a share of ``1 / BLOCKS``, up to
    ``BLOCK_BYTES``. Work grows with the square of the table, as every two
    vectors are compared; what travels is ``BLOCKS`` times the table, beyond
    ``BLOCKS`` times ``BLOCK_BYTES`` its square over ``BLOCK_BYTES``."""
    kind = df.select(vector_col).schema[0].dataType
    kind = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{kind}>").alias("vector"))
    rows = rows.withColumn("usable", usable("vector") & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)))
    tiles = rows.filter("usable").select("vec_id", "vector").mapInArrow(_tiled("f4" if kind == "float" else "f8"), TILES)
    tiles = stored(tiles, **{"parquet.block.size": TILE_BYTES * 64})
    alone = rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    task = F.shiftright("tile", 28 + ROW_BITS).alias("task")
    n, size = tiles.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    part = max(1, min(BLOCK_BYTES, max(block, n // BLOCKS) * size // max(1, n)))
    blocks = max(1, -(-size // part))
    # one row per task that made tiles
    earlier = F.sum("size").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = tiles.groupBy(task).agg(F.sum("bytes").alias("size")).select("task", F.coalesce(earlier, F.lit(0)).alias("start"))
    mine, other = F.floor((F.col("start") + F.col("before")) / part).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with")
    deals = max(df.sparkSession.sparkContext.defaultParallelism, min(-(-size * blocks // DEALT_BYTES), 100_000))
    placed = tiles.select("tile", "dims", "n", "before", "vectors", task).repartition(deals).join(F.broadcast(starts), "task")
    dealt = placed.select("tile", "dims", "n", "vectors", mine).select("*", other).select("*", F.least("block", "with").alias("g"), F.greatest("block", "with").alias("h"))
    tasks = min(blocks * (blocks + 1) // 2, TASKS)
    found = dealt.drop("with").repartition(tasks, "g", "h").groupBy("g", "h").applyInArrow(_compare(threshold), "row long, links long, other long")
    found = stored(found)

    roots = components(found.select(F.col("row").alias("a"), F.col("other").alias("b")))
    counts = found.groupBy("row").agg(F.sum("links").alias("links"))
    place = F.posexplode("ids").alias("place", "vec_id")
    ids = tiles.select("tile", place).select((F.col("tile") + F.col("place")).alias("row"), "vec_id")
    linked_rows = counts.join(roots, counts["row"] == roots["node"]).select("row", "links", "root")
    whole = ids.join(cut_lineage(linked_rows), "row", "left")
    least = whole.filter("root IS NOT NULL").groupBy("root").agg(F.min("vec_id").alias("least"))
    out = whole.join(cut_lineage(least), "root", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("root").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))).unionByName(alone)
