import random
from collections import Counter, defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.data import dirty, documents, empty
from webrec.llm import exact, queries, simhash
from webrec.llm.components import components


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400), st.binary(max_size=400))
def test_hash_composes(x, y):
    t = exact.powers()
    hx, hy, hxy = (exact.chunk_hash(b, t) for b in (x, y, x + y))
    assert exact.combine(hx, hy, len(y)) == hxy
    plain = tuple(sum((c + 1) * pow(b, len(x) - 1 - i, p) for i, c in enumerate(x)) % p for b, p in zip(exact.BASES, exact.PRIMES))
    assert hx == plain


def check_exact(df, out):
    groups = defaultdict(list)
    for r in df.collect():
        groups[lower(r.text)].append(r.doc_id)
    want = Counter()
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[i, keep, len(ids)] += 1
    rows = out.collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)
    assert all(r.doc_id == r.keep_id for r in rows if r.kept)


def test_exact(spark, sf_dir):
    for df in (documents(spark, sf_dir), dirty(spark)):
        check_exact(df, exact.exact_duplicates(df))
    assert exact.exact_duplicates(empty(spark)).count() == 0


def test_exact_ids_that_repeat(spark):
    """One id on different texts of one length that all have copies; many texts without an id."""
    rows = [(5, "aaaa"), (5, "bbbb"), (1, "aaaa"), (2, "bbbb"), (5, "AAAA"), (None, "aaaa"), (None, "cccc"), (None, "cccc"), (None, "dddd"), (None, None), (None, "")]
    rows += [(None if i % 3 else i, f"{i % 1500:04d} text of one length") for i in range(4500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_exact(df, exact.exact_duplicates(df))


def test_exact_large_group(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Copy " * 50)).otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    check_exact(df, exact.exact_duplicates(df))


def test_exact_survives_collisions(spark, sf_dir, monkeypatch):
    """Fingerprints so weak that many different texts share one."""
    plain = exact.fingerprints
    monkeypatch.setattr(exact, "fingerprints", lambda d: plain(d).withColumn("h1", F.col("h1") % 1).withColumn("h2", F.col("h2") % 1))
    df = spark.createDataFrame([(i, f"{i % 5} text") for i in range(40)] + [(99, "longer text")], "doc_id long, text string")
    check_exact(df, exact.exact_duplicates(df))


def test_pieces(spark):
    text = "Größe, " * 30_000
    cuts = [0, 10, 70_001, 140_000, len(text)]
    rows = [(1, n, text[a:b]) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))] + [(2, 0, None)]
    got = {r.doc_id: (r.n_bytes, r.h1, r.h2) for r in exact.fingerprint_pieces(spark.createDataFrame(rows, "doc_id long, piece_no int, text string")).collect()}
    whole = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    assert got == {r.doc_id: (r.n_bytes, r.h1, r.h2) for r in exact.fingerprints(whole).collect()}


def brute_simhash(t):
    words = lower(t).encode().split()
    s = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, sf_dir):
    for df in (documents(spark, sf_dir), dirty(spark)):
        rows = df.collect()
        fp = [(r.doc_id, brute_simhash(r.text)) for r in rows]
        ids = sorted({d for d, _ in fp if d is not None})
        pairs = [(a, b) for i, (a, x) in enumerate(fp) for b, y in fp[:i] if a is not None and b is not None and (x ^ y).bit_count() <= 4]
        roots = brute_components(ids, pairs)
        got = simhash.near_duplicates(df).collect()
        assert Counter((r.doc_id, r.fingerprint) for r in got) == Counter((d, f"{f:016x}") for d, f in fp)
        assert all(r.component_id == roots[r.doc_id] for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def clusters(seed=3):
    r = random.Random(seed)
    out = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(40):
            out.add(x)
            for b in r.sample(range(64), r.randint(1, 6)):
                x ^= 1 << b
    return sorted(v - (1 << 64) if v >> 63 else v for v in out)


def test_triples():
    t = simhash.triples()
    assert len(t) == 20
    from itertools import combinations

    assert all(any(set(x) <= set(four) for x in t) for four in combinations(range(8), 4))


def test_links_by_any_posting_size(spark):
    fps = clusters()
    pairs = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    want = brute_components(fps, pairs)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    for posting in (1, 3, 4096):
        got = [(r.a, r.b) for r in simhash.links(df, posting=posting).collect()]
        assert brute_components(fps, got) == want


def test_long_postings_over_batches():
    import pyarrow as pa

    keys = np.repeat(np.arange(4, dtype=np.int32), [3, 500, 2, 7])
    fps = np.arange(len(keys), dtype=np.int64)
    whole = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps)], ["posting", "fp"])
    for size in (1, 7, 100, 1000):
        over, met = [], []
        for b in simhash._pair(4, 20)(whole.slice(i, size) for i in range(0, len(keys), size)):
            for a, c in zip(b.column("a").to_pylist(), b.column("b").to_pylist()):
                (over if c is None else met).append((a, c))
        assert [a for a, _ in over] == list(range(3, 503))
        assert len(met) == 2 + 1 + 6


def test_components(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(200)] + [(5000, 5000), (7, 3), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {n: r for n, r in brute_components({x for p in chain for x in p}, chain).items() if n != 5000}


def test_op4_sql(spark, sf_dir):
    from tests.harness import compare, duck

    assert compare(queries.QUERIES["op4_exact_dedup"](spark, sf_dir), duck(sf_dir), queries.ORACLES["op4_exact_dedup"]) is None
