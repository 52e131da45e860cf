import numpy as np
import pytest

from webrec.operators import vectors as V


def brute(corpus, queries, k, max_distance=None):
    """Sorted by distance and id, one query after the other."""
    out = set()
    c = np.array([v for _, v in corpus])
    for q, v in queries:
        d = ((c - np.array(v)) ** 2).sum(1)
        best = sorted((x, i) for x, (i, _) in zip(d.tolist(), corpus) if max_distance is None or x < max_distance)[:k]
        out |= {(q, n, i, round(x, 9)) for n, (x, i) in enumerate(best, 1)}
    return out


def rows(n, dim, seed, first=0):
    v = np.random.default_rng(seed).normal(size=(n, dim))
    return [(first + i, x) for i, x in enumerate(v.tolist())]


def result(df):
    got = [(r.query_id, r["rank"], r.vec_id, round(r.distance, 9)) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def frames(spark, corpus, queries):
    return (spark.createDataFrame(corpus, "vec_id long, embedding array<double>"), spark.createDataFrame(queries, "query_id long, embedding array<double>"))


def test_ten_thousand_queries(spark):
    corpus, queries = rows(1500, 8, 1), rows(10_000, 8, 2)
    c, q = frames(spark, corpus, queries)
    got = result(V.vector_topk(c, q, 3))
    assert got == brute(corpus, queries, 3)
    assert len(got) == 30_000


@pytest.mark.parametrize("max_distance", [None, 6.0])
def test_small_blocks(spark, max_distance):
    corpus, queries = rows(300, 6, 3), rows(70, 6, 4, first=1000)
    # copies, more than k, that tie
    corpus += [(500 + i, corpus[5][1]) for i in range(12)]
    queries.append((2000, corpus[5][1]))
    c, q = frames(spark, corpus, queries)
    got = result(V.vector_topk(c, q, 5, max_distance, query_rows=16, corpus_rows=40))
    assert got == brute(corpus, queries, 5, max_distance)
    assert {i for qid, _, i, _ in got if qid == 2000} == {5, 500, 501, 502, 503}


def test_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(90, None), (91, []), (92, [1.0, None]), (93, [nan, 1.0]), (94, [inf, 1.0]), (95, [1.0, 2.0, 3.0])]
    good = [(None, [0.0, 1.0]), (2, [1.0, 0.0]), (2**60 + 1, [0.0, 1.0])]
    c, q = frames(spark, bad + good, bad[:5] + [(1, [0.0, 1.0])])
    c = c.selectExpr("*", "1 AS query", "2 AS rank", "3 AS q_block")
    got = [(r.query_id, r["rank"], r.vec_id, r.distance) for r in V.vector_topk(c, q, 5).collect()]
    assert sorted(got, key=lambda r: r[1]) == [(1, 1, None, 0.0), (1, 2, 2**60 + 1, 0.0), (1, 3, 2, 2.0)]


def test_empty_tables(spark):
    c, q = frames(spark, rows(5, 2, 1), rows(5, 2, 2))
    assert V.vector_topk(c.limit(0), q).collect() == []
    assert V.vector_topk(c, q.limit(0)).collect() == []
    assert V.vector_topk(c.limit(0), q.limit(0)).columns == ["query_id", "rank", "vec_id", "distance"]
