import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException

from tests.harness import compare, duck
from tests.llm.data import dirty, documents, empty
from webrec.llm import collocations as C
from webrec.llm import queries


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in ([x for x in re.split("[\x20\x09]+", p) if x] for p in re.split("[.,;:!?\x0a-\x0d]", low)) if w]


def brute(rows, max_words=3, min_count=10, top=2000, absorb=50):
    """The same from plain counts of word tuples."""
    count, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            words[lang] += len(p)
            for n in range(1, max_words + 1):
                for i in range(len(p) - n + 1):
                    count[lang][tuple(p[i : i + n])] += 1
    out = set()
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        held = Counter()
        for p, a in cand.items():
            for n in range(2, len(p)):
                for i in range(len(p) - n + 1):
                    held[p[i : i + n]] = max(held[p[i : i + n]], a)
        kept = []
        for p, a in cand.items():
            if held[p] and 100 * held[p] >= absorb * a:
                continue
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return out


def check(df, **options):
    got = [tuple(r) for r in C.collocations(df, **options).collect()]
    assert len(got) == len(set(got))
    want = brute([(r.text, r.lang) for r in df.select("text", "lang").collect()], **{k: v for k, v in options.items() if k in ("max_words", "min_count", "top")})
    assert set(got) == want
    return want


def test_registered(spark, sf_dir):
    con = duck("/root/testdata/sf0.01")
    assert compare(queries.op11_collocations(spark, "/root/testdata/sf0.01"), con, queries.ORACLES["op11_collocations"]) is None
    assert check(documents(spark, sf_dir))


def test_dirty(spark):
    assert check(dirty(spark))
    assert check(dirty(spark), max_words=5, min_count=40)
    assert check(dirty(spark), max_words=2, top=3)
    assert C.collocations(empty(spark)).count() == 0
    assert C.collocations(spark.createDataFrame([(1, None, None), (2, " . \t,", "en")], "doc_id long, text string, lang string")).count() == 0


def test_blocks_join_up(spark, monkeypatch):
    """Texts cut in many parts, with runs of separators and words across the cuts."""
    monkeypatch.setattr(C, "BLOCK", 64)
    monkeypatch.setattr(C, "HELD", 50)
    r = random.Random(3)
    text = lambda: "".join(r.choice(["a ", "b\t", "cc  ", "Dd, ", "é\n", " " * 90, "w" * 100 + " ", "x.y "]) for _ in range(400))
    docs = [(i, text(), r.choice(["en", None, "de"])) for i in range(20)]
    rows = [(t, "und" if lang is None else lang) for _, t, lang in docs]
    poly = C.Polynomials()
    for t, _ in rows:  # the generator itself, in this process
        n = Counter()
        for found, _ in C._grams(poly, [t.encode()], np.zeros(1, np.uint64), [1, 2, 3], 3, True):
            for k, (_, new, _, _, fp, c) in found.items():
                n.update(zip([k] * len(fp), fp[new].tolist(), c[new].tolist()))
        want = Counter((k, tuple(p[i : i + k])) for p in pieces(t) for k in (1, 2, 3) for i in range(len(p) - k + 1))
        assert sorted(n.values()) == sorted(want.values())
    check(spark.createDataFrame(docs, "doc_id long, text string, lang string"), min_count=2)


def test_one_word_longer_than_a_block(spark):
    text = ("q" * (C.BLOCK + 10) + " tail end ") * 3 + "tail end. " * 12
    check(spark.createDataFrame([(1, text, "en")], "doc_id long, text string, lang string"), min_count=3)


def test_a_task_sends_each_phrase_once(monkeypatch):
    """However often it counts, with the sums and the first and the last text."""
    monkeypatch.setattr(C, "HELD", 20)
    texts, keys = ["a b c. a b", "a b", "B c, a B c", "c"] * 30, [7, -3, 9, 1] * 30
    work, end = C._pointers(C.Polynomials, 3, lambda: C.Marks(np.full(1, 2**64 - 1, np.uint64), 6))()
    sent = []
    for k in range(0, 120, 4):
        sent += work(pa.RecordBatch.from_pydict({"text": texts[k : k + 4], "salt": pa.array([5] * 4, pa.int64()), "text_key": pa.array(keys[k : k + 4], pa.int32())}))
    sent += end()
    rows = [dict(zip(C.POINTED, x)) for b in sent for r in b.to_pylist() for x in zip(*(r[c] for c in C.POINTED))]
    assert len(rows) == len({(r["fp"], r["checked"], r["words"]) for r in rows}) == 7
    at = {(r["words"], r["n"], r["key_0"], r["at_0"], r["key_1"], r["at_1"]) for r in rows}
    assert at == {
        (1, 120, -3, 0, 9, 5), (1, 150, -3, 2, 9, 0), (1, 120, 1, 0, 9, 2),  # a, b, c
        (2, 120, -3, 0, 9, 5), (2, 90, 7, 2, 9, 0), (3, 60, 7, 0, 9, 5), (0, 390, 1, 0, 1, 0),  # all words, at the last text
    }


def test_memory_of_a_task(monkeypatch):
    """600,000 n-grams, all different: 40 bytes each, and a sixteenth of them copied at once."""
    monkeypatch.setattr(C, "HELD", 1 << 14)
    texts = [" ".join(f"w{k}" for k in range(at, at + 1000)) + "." for at in range(0, 200_000, 1000)]
    batch = pa.RecordBatch.from_pydict({"text": texts, "salt": pa.array([5] * 200, pa.int64()), "text_key": pa.array(range(200), pa.int32())})
    for make in (C._pointers(C.Polynomials, 3, lambda: C.Marks(np.full(1, 2**64 - 1, np.uint64), 6)), C._fingerprints(C.Polynomials, 3, 2, None)):
        work, end = make()
        sent = 0
        tracemalloc.start()
        for b in (b for part in (work(batch), end()) for b in part):
            sent += len(b.column("n").values)
            del b
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sent in (200_000 + 199_800 + 199_600 + 1, 200_000 + 199_800)
        assert peak < 60 * sent


def test_collisions_count_apart(spark, sf_dir):
    """Fingerprints of 6 bits: the checks part them. A bitmap of 64 bits: nothing is lost."""
    df = documents(spark, sf_dir)
    plain = {tuple(r) for r in C.collocations(df).collect()}
    assert plain == {tuple(r) for r in C.collocations(df, bits=6).collect()}
    assert plain == {tuple(r) for r in C.collocations(df, slot_bits=6).collect()}


def test_texts_share_a_pointer(spark, monkeypatch):
    """Offsets of one text fall within characters of another."""
    monkeypatch.setattr(C, "KEY_BITS", 1)
    assert check(spark.createDataFrame([(i, "é" * (i % 7) + "x" * (i % 3) + " à bé ç", "fr") for i in range(60)], "doc_id long, text string, lang string"))


def test_collisions_of_both_are_seen(spark, monkeypatch):
    """Where the checks collide too, the texts tell and the job fails."""
    monkeypatch.setattr(C, "PRIME", np.int64(3))
    monkeypatch.setattr(C.Polynomials, "__init__", _weak)
    df = spark.createDataFrame([(i, f"w{k} v{k}", "en") for k in range(40) for i in range(12)], "doc_id long, text string, lang string")
    with pytest.raises(PySparkException, match="another seed"):
        C.collocations(df, bits=2).collect()


def _weak(self, seed=0, bits=64, real=C.Polynomials.__init__):
    real(self, seed, bits)
    self.letter_check = np.ones(256, np.int64)
    self.power_check = self.inverse_check = np.zeros(self.size, np.int64)
    self._reach = lambda n: None


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "ab", "ba", " ", "\t", ".", "é", "aa"]), max_size=40))
def test_equal_phrases_equal_fingerprints(parts):
    text = "".join(parts)
    poly, by = C.Polynomials(), {}
    for found, _ in C._grams(poly, [text.encode()], np.zeros(1, np.uint64), [1, 2, 3], 3, True):
        for n, (_, _, _, offset, fp, check) in found.items():
            for o, f, c in zip(offset.tolist(), fp.tolist(), check.tolist()):
                hit = re.compile(C.WORD + rb"(?:[ \t]+" + C.WORD + rb"){%d}" % (n - 1)).match(text.encode(), o)
                phrase = tuple(hit[0].split())
                assert len(phrase) == n and by.setdefault(phrase, (f, c)) == (f, c)
    assert len(set(by.values())) == len(by)


def test_counts_beyond_64_bits(spark):
    """The arithmetic of the score, on counts no test table can hold."""
    row = spark.sql("SELECT 900000000001L AS a, 900000000007L AS l, 900000000003L AS r")
    sql = "(1000000 * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(18, 0)))"
    a, l, r = 900000000001, 900000000007, 900000000003
    assert row.selectExpr(f"{sql} AS s").first().s == 1000000 * a * a // (l * r)
