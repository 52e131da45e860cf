"""The pipeline's stages against brute force over the same rows."""

from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from tests.llm.data import dirty, documents, empty
from tests.llm.test_bpe_packing import check_packing
from tests.llm.test_duplicates import brute_components, brute_simhash, lower
from webrec.llm import bpe, langid, secrets
from webrec.llm.base import stored


def tables(spark, df, sf_dir):
    out = [df]
    for _, stage in pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf_dir)))
    return out


def check_stages(spark, df, sf_dir):
    start, language, exact, near, masked, packed = tables(spark, df, sf_dir)
    for t in (language, exact, near, masked):
        assert t.columns == pipeline.COLUMNS
    # language: what it keeps is what the operator accepts
    model = langid.fit(start)
    tag = langid.tagger(model)
    rows = start.collect()
    names, _, unsure = tag([r.text for r in rows])
    want = Counter((r.doc_id, r.text, n) for r, n, u in zip(rows, names, unsure) if n != "und" and not u)
    assert Counter((r.doc_id, r.text, r.lang) for r in language.collect()) == want
    # exact: one row per text, the largest id
    best = {}
    for r in language.collect():
        key = lower(r.text)
        best[key] = max(best.get(key, -1), r.doc_id if r.doc_id is not None else -1)
    assert Counter((lower(r.text), r.doc_id if r.doc_id is not None else -1) for r in exact.collect()) == Counter(best.items())
    # near: one row per component of fingerprints, the smallest id
    rows = [(r.doc_id, brute_simhash(r.text)) for r in exact.collect() if r.doc_id is not None]
    pairs = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if (x ^ y).bit_count() <= 4]
    roots = brute_components([d for d, _ in rows], pairs)
    assert sorted(r.doc_id for r in near.collect() if r.doc_id is not None) == sorted(set(roots.values()))
    # secrets: no base pattern is left, texts without one are as they were
    text = {r.doc_id: r.text for r in near.collect()}
    assert Counter(r.doc_id for r in masked.collect()) == Counter(r.doc_id for r in near.collect())
    for r in masked.collect():
        assert not secrets.base_spans(r.text) and r.n_chars == len(r.text) or r.text == text[r.doc_id]
        if secrets.base_spans(text[r.doc_id]):
            assert "[SECRET]" in r.text
    library = Tokenizer.from_file(bpe.WORD_BPE)
    check_packing(packed.collect(), [(r.doc_id, r.text) for r in masked.collect()], library)


def test_stages(spark, sf_dir):
    check_stages(spark, documents(spark, sf_dir), sf_dir)


def test_run(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    by_doc = defaultdict(int)
    for r in rows:
        by_doc[r.doc_id] += r.length
    assert rows and all(by_doc[r.doc_id] == r.doc_tokens for r in rows)
    assert entry.queries()["pipeline"] is pipeline.run and pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_dirty(spark, sf_dir, name):
    stage = dict(pipeline.STAGES)[name]
    out = stage(spark, dirty(spark), sf_dir)
    assert out.count() > 0
    assert stage(spark, empty(spark), sf_dir).count() == 0
    if name == "exact_dedup":
        assert out.groupBy("doc_id", "text").count().filter("count > 1").count() == 0
    if name == "mask_secrets":
        assert out.count() == dirty(spark).count()


def test_near_dedup_by_row(spark, sf_dir):
    """Null and repeated ids: one row of each component of fingerprints stays,
    of the smallest id, null ids last; all others stay."""
    words = "amber basil cedar delta ember fjord grove heron inlet jetty knoll larch maple north ocean pearl quill raven slate thorn".split()
    fresh = lambda k: " ".join(words[(k * 7 + i * (k + 1) + i * i) % 20] + str(k * i % 9) for i in range(80))
    base = [fresh(k) for k in range(9)]
    near = lambda k: base[k].upper()  # noqa: E731  the same fingerprint
    rows = [
        (1, base[0]), (None, near(0)),  # the null id goes
        (None, base[1]),  # alone: stays
        (7, base[2]), (3, near(2)), (7, base[3]),  # id 7 stays with its other text
        (None, base[4]), (None, near(4)),  # one stays
        (5, base[5]), (5, near(5)),  # one stays
        (6, base[6]), (6, base[6]),  # one stays
        (None, base[7]), (None, base[7]), (None, base[7]), (8, base[8]),
        (5, base[8] + " of"),
    ]
    prints = [brute_simhash(t) for _, t in rows]
    pairs = [(a, b) for a, x in enumerate(prints) for b, y in enumerate(prints[:a]) if (x ^ y).bit_count() <= 4]
    roots = brute_components(range(len(rows)), pairs)
    groups = defaultdict(list)
    for k, (doc, text) in enumerate(rows):
        groups[roots[k]].append(doc)
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], pipeline.SCHEMA).repartition(4)
    got = defaultdict(list)
    for r in pipeline.near_dedup(spark, df, sf_dir).collect():
        k = next(k for k, (d, t) in enumerate(rows) if (d, t) == (r.doc_id, r.text))
        got[roots[k]].append(r.doc_id)
    assert len(groups) >= 9
    assert dict(got) == {g: [min(ids, key=lambda d: (d is None, d or 0))] for g, ids in groups.items()}
