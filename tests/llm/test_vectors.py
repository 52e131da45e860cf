import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.harness import compare, duck
from webrec.llm import codebooks, queries, tiles

SCHEMA = "vec_id long, embedding array<float>, label int, code string, row long, tile long, n int, links long"
NAN, INF = float("nan"), float("inf")


def dirty(spark, n=300, dims=32, seed=5):
    """Groups of near and exact copies, unusable vectors, other lengths, ties, repeated rows."""
    r = random.Random(seed)
    vector = lambda: [r.gauss(0, 1) for _ in range(dims)]
    groups = [vector() for _ in range(12)]
    rows = []
    for i in range(n):
        g, noise = r.choice(groups), r.choice([0.0, 0.01, 0.15, 0.24, 1.0])
        rows.append((i // 2 * 2 if i % 7 == 0 else i, [x + r.gauss(0, noise) for x in g], None if i % 5 == 0 else i % 3, "c", 1, 1, 1, 1))
    odd = [None, [], [0.0] * dims, [NAN] * dims, [INF] + [1.0] * (dims - 1), [None] + [1.0] * (dims - 1), [1.0] * dims, [2.0] * dims, [1e-30] * dims, [1.0] * 5, [2.0] * 5]
    rows += [(1000 + i, v, 9, None, None, None, None, None) for i, v in enumerate(odd)]
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def vectors(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def brute_codes(rows, parts=16, entries=64, rounds=2):
    good = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not good:
        return Counter()
    width = -(-max(1, max(len(v) for _, v, _ in good)) // parts) * parts
    x = np.array([[int(np.floor(256 * float(c))) for c in v] + [0] * (width - len(v)) for _, v, _ in good], object)
    x = x.reshape(len(good), parts, -1)
    order = sorted(range(len(good)), key=lambda k: (good[k][0] is None, good[k][0], [float(c) for c in good[k][1]]))[:entries]
    books = [[list(x[k, p]) for k in order] for p in range(parts)]

    def near(p, k):
        d = [sum((a - b) ** 2 for a, b in zip(x[k, p], e)) for e in books[p]]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            members = defaultdict(list)
            for k in range(len(good)):
                members[near(p, k)[0]].append(x[k, p])
            for e, got in members.items():
                books[p][e] = [sum(c) // len(got) for c in zip(*got)]
    final = [[near(p, k) for p in range(parts)] for k in range(len(good))]
    by_label = Counter()
    for (_, _, lab), f in zip(good, final):
        by_label[lab] += sum(d for _, d in f)
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return Counter((i, "".join(f"{e:02x}" for e, _ in f), sum(d for _, d in f), by_label[lab], sha) for (i, _, lab), f in zip(good, final))


def test_codes(spark, sf_dir):
    con = duck("/root/testdata/sf0.01")
    assert compare(queries.op12_vector_codes(spark, "/root/testdata/sf0.01"), con, queries.ORACLES["op12_vector_codes"]) is None
    for df in (dirty(spark, 120), dirty(spark, 40, dims=19), dirty(spark, 20).repartition(40)):
        got = Counter(tuple(r) for r in codebooks.vector_codes(df).collect())
        assert got == brute_codes([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert codebooks.vector_codes(empty(spark)).count() == 0
    assert codebooks.vector_codes(dirty(spark, 0).filter("vec_id = 1000")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=4, max_size=4), min_size=1, max_size=60), st.lists(st.lists(st.integers(-3, 3), min_size=4, max_size=4), min_size=1, max_size=7), st.integers(1, 5))
def test_trie(rows, entries, block):
    """Leaves are the distinct rows; ties go to the first entry; blocks do not matter."""
    rows, entries = np.array(rows), np.array(entries)
    trie = codebooks.Trie(rows)
    assert np.array_equal(trie.leaves[trie.leaf_of], rows) and len({*map(tuple, rows.tolist())}) == len(trie.leaves)
    assert np.array_equal(trie.weights, np.bincount(trie.leaf_of))
    keep, codebooks.BLOCK = codebooks.BLOCK, block
    try:
        index, error = trie.nearest(entries)
    finally:
        codebooks.BLOCK = keep
    d = ((trie.leaves[:, None] - entries[None]) ** 2).sum(2)
    assert np.array_equal(index, d.argmin(1)) and np.array_equal(error, d.min(1))


def brute_links(rows, threshold=0.95):
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    unit = [np.array(v, float) / np.abs(np.array(v, float)).max() if k else None for k, (_, v) in zip(ok, rows)]
    links = defaultdict(set)
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and len(unit[a]) == len(unit[b]):
                if unit[a] @ unit[b] / np.sqrt((unit[a] @ unit[a]) * (unit[b] @ unit[b])) >= threshold:
                    links[a].add(b)
                    links[b].add(a)
    out, seen = [], {}
    for k in range(len(rows)):
        if k not in seen:
            stack, members = [k], {k}
            while stack:
                for m in links[stack.pop()] - members:
                    members.add(m)
                    stack.append(m)
            least = min((rows[m][0] for m in members if rows[m][0] is not None), default=None)
            seen |= dict.fromkeys(members, least)
        out.append((rows[k][0], len(links[k]), seen[k], rows[k][0] == seen[k]))
    return Counter(out)


def test_near_vectors(spark, sf_dir):
    con = duck("/root/testdata/sf0.01")
    assert compare(queries.op13_near_vectors(spark, "/root/testdata/sf0.01"), con, queries.ORACLES["op13_near_vectors"]) is None
    df = dirty(spark)
    want = brute_links([(r.vec_id, r.embedding) for r in df.collect()])
    assert max(n for _, n, _, _ in want) > 20
    for block in (4096, 50):
        assert Counter(tuple(r) for r in tiles.near_vectors(df.repartition(7), block=block).collect()) == want
    assert tiles.near_vectors(empty(spark)).count() == 0
    assert [tuple(r) for r in tiles.near_vectors(df.filter("vec_id IN (1000, 1001)")).orderBy("vec_id").collect()] == [(1000, 0, 1000, True), (1001, 0, 1001, True)]


def test_a_chain_and_a_large_group(spark):
    """A group of a third of all rows, and vectors linked only through others, over many tiles."""
    chain = F.array(*[F.lit(c) for c in ()] or [F.cos(F.col("id") * 0.2), F.sin(F.col("id") * 0.2)])
    df = spark.range(31).select("id", chain.alias("v")).union(spark.range(100, 1300).select("id", F.array(F.lit(5.0), F.lit(-5.0) + F.col("id") * 1e-9)))
    got = {r.vec_id: r for r in tiles.near_vectors(df.repartition(16).withColumnRenamed("id", "vec_id"), block=100, vector_col="v").collect()}
    want = brute_links([(r.id, r.v) for r in df.filter("id < 31").collect()])
    near = sum(1 for i in range(31) if (np.cos(i * 0.2) - np.sin(i * 0.2)) / 2**0.5 >= 0.95)
    assert {got[i].component_id for i in range(31)} == {0} and near > 0
    assert {(got[i].n_links, got[i].component_id) for i in range(100, 1300)} == {(1199 + near, 0)}
    assert sum(got[i].n_links for i in range(31)) == sum(n * c for (_, n, _, _), c in want.items()) + 1200 * near


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 7, 64, 1500]), st.sampled_from([0.3, 0.8, 0.95, 0.999]))
def test_bounds_lose_nothing(seed, dims, threshold):
    """Every pair at or above the threshold and none below, also close to it;
    few pairs are computed in full where the data are spread out."""
    r = np.random.default_rng(seed)
    base = r.normal(size=(1, dims))
    u = tiles.unit_rows(np.concatenate([base + r.normal(size=(40, dims)) * s for s in (0.0, 0.1, 0.33, 1.0)]) * 10 ** r.uniform(-100, 100))
    names = [f.split()[0] for f in tiles.TILES.split(", ")]
    a, b = (tiles.Tile(dict(zip(names, tiles._tile(k << 11, [], x)))) for k, x in enumerate((u[::2], u[1::2])))
    cosine = a.unit @ b.unit.T
    i, j, _ = tiles.linked(a, b, threshold)
    got = np.zeros(cosine.shape, bool)
    got[i, j] = True
    clear = np.abs(cosine - threshold) > 1e-14
    assert np.array_equal(got[clear], (cosine >= threshold)[clear])
    i, j, _ = tiles.linked(a, a, threshold)
    assert np.all(i < j) and len({*zip(i.tolist(), j.tolist())}) == len(i)


def compared(sides):
    """What a task returns for tiles of unit vectors, by block, and its peak in MB."""
    names = [f.split()[0] for f in tiles.TILES.split(", ")]
    rows = [dict(zip(names, tiles._tile((b << 30) + (k << 11), [], x))) | {"block": b} for b, parts in sides.items() for k, x in enumerate(parts)]
    group = pa.Table.from_pylist([{c: v for c, v in r.items() if c != "ids"} for r in rows])
    tracemalloc.start()
    out = tiles._compare(0.95)((pa.scalar(min(sides)), pa.scalar(max(sides))), group)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return {r["row"]: (r["links"], r["other"]) for r in out.to_pylist()}, peak


def test_memory_does_not_grow_with_links():
    """Blocks of 4,096 copies: 8 and 17 million links in a task."""
    r = np.random.default_rng(1)
    x = tiles.unit_rows(r.normal(size=(1, 64)) + r.normal(size=(8192, 64)) * 0.01)
    a, b = np.split(x[:4096], 2), np.split(x[4096:], 2)
    for sides, links in (({0: a}, 4095), ({0: a, 1: b}, 4096)):
        got, peak = compared(sides)
        assert len(got) == 4096 * len(sides) and {*got.values()} == {(links, 0)}
        assert peak < 150


def test_stripes_find_every_link():
    """Two blocks of more rows than a stripe has, in tiles of odd sizes and of two lengths."""
    r = np.random.default_rng(2)
    groups = r.normal(size=(40, 8))
    x = tiles.unit_rows(groups[r.integers(0, 40, 3000)] + r.normal(size=(3000, 8)) * r.choice([0.01, 0.2, 1.0], (3000, 1)))
    other = tiles.unit_rows(r.normal(size=(5, 9)))
    sides = {0: [x[:1300], other[:3], x[1300:1307]], 1: [x[1307:1400], x[1400:], other[2:]]}
    got, _ = compared(sides)
    rows = np.concatenate([(b << 30) + (k << 11) + np.arange(len(p)) for b, parts in sides.items() for k, p in enumerate(parts) if p.shape[1] == 8])
    near = x[:1307] @ x[1307:].T >= 0.95
    links = np.concatenate([near.sum(1), near.sum(0)])
    least = np.arange(3000)
    while True:
        low = np.where(near, least[1307:], 3000).min(1), np.where(near, least[:1307, None], 3000).min(0)
        new = np.minimum(least, np.concatenate(low))
        if np.array_equal(new, least):
            break
        least = new
    want = {int(rows[k]): (int(links[k]), int(rows[least[k]])) for k in range(3000) if links[k]}
    extra = {(0 << 30) + (1 << 11) + 2: (1, (1 << 11) + 2), (1 << 30) + (2 << 11): (1, (1 << 11) + 2)}
    assert got == want | extra


def test_tiles_are_small(monkeypatch):
    """A tile is at most so many bytes and no more than its vectors; tiles that
    do not fill leave before they are many."""
    monkeypatch.setattr(tiles, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    r = np.random.default_rng(3)
    for lengths, held in (([64] * 3000 + [30000] * 9 + [200000], 1 << 25), ([*range(1, 900)], 1 << 12)):
        monkeypatch.setattr(tiles, "HELD_BYTES", held)
        vectors = [r.normal(size=n).astype(np.float32) for n in lengths]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(lengths))), pa.array(vectors, pa.list_(pa.float32()))], ["vec_id", "vector"])
        got = [row for b in tiles._tiled("f4")(iter([batch])) for row in b.to_pylist()]
        assert sorted(i for t in got for i in t["ids"]) == [*range(len(lengths))] and len({t["tile"] for t in got}) == len(got)
        before = 0
        for t in got:
            x = np.frombuffer(t["vectors"], np.float32).reshape(t["n"], t["dims"])
            assert all(np.array_equal(vectors[i], v) for i, v in zip(t["ids"], x))
            assert (t["before"], t["bytes"]) == (before, x.nbytes) and (x.nbytes <= tiles.TILE_BYTES or t["n"] == 1)
            before += x.nbytes
    x = r.normal(size=(1000, 64)).astype(np.float32)
    assert sum(len(v) for v in tiles._tile(0, [], x) if isinstance(v, bytes)) == x.nbytes
