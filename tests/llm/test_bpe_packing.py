import hashlib
import sys
import unicodedata
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from tokenizers import Tokenizer

from tests.llm.data import dirty, documents, empty
from webrec.llm import bpe, packing


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.WORD_BPE)


@pytest.fixture(scope="module")
def own():
    return bpe.WordBpe()


def test_every_code_point(library, own):
    """All that Python's own tables know; younger characters differ between the libraries' Unicode versions."""
    wrong = []
    for lo in range(0, sys.maxunicode + 1, 512):
        chars = [chr(c) for c in range(lo, lo + 512) if unicodedata.category(chr(c)) not in ("Cs", "Cn")]
        texts = [f"a{c}b {c}" for c in chars]
        for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
            if own.encode(t) != e.ids:
                wrong.append(hex(ord(t[1])))
    assert not wrong, (len(wrong), wrong[:20])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcsdtrevml'ßÉéΣσςİı́ \n\t\x1c\x1f\x85!?1½²Ⅷ٣—…日本🙂<|endoftxsar>")), max_size=60))
def test_like_the_library(library, own, text):
    want = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == want
    assert own.decode(want) == library.decode(want, skip_special_tokens=False)


def test_long_word(library, own):
    text = "abcdefgh" * 20_000
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_digests(spark, sf_dir, library):
    for df in (documents(spark, sf_dir), dirty(spark)):
        got = sorted(map(repr, bpe.digests(df).collect()))
        want = []
        for r in df.collect():
            ids = library.encode(r.text or "", add_special_tokens=False).ids
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
            want.append(repr(Row(doc_id=r.doc_id, n_tokens=len(ids), ids_sha256=sha[0], decoded_sha256=sha[1])))
        assert got == sorted(want)
    assert bpe.digests(empty(spark)).count() == 0


def test_encode_decode(spark, library):
    df = dirty(spark)
    back = bpe.decode(bpe.encode(df)).collect()
    assert len(back) == df.count()
    assert {r.text for r in back if r.doc_id == 5} == {"same</w> text</w> here</w> now</w>"}


def test_memo_bound():
    memo = bpe.Memo(len, 3)
    assert [memo[x] for x in ("a", "bb", "ccc", "dddd", "a", "y" * 99)] == [1, 2, 3, 4, 1, 99]
    assert len(memo) <= 3 and len(memo.elder) <= 3 and "y" * 99 not in memo


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 20_000))
def test_cut(n):
    parts = packing.cut(n)
    assert sum(parts) == n and all(0 < p <= 2048 for p in parts)
    assert len(parts) <= n // 2048 + 4
    for p in parts:
        j = 2048 // p
        assert 2048 - j * p <= max(2048 / 32, j)


def check_packing(rows, texts, library):
    ids = {}
    for d, t in texts:
        ids.setdefault(d, np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for d, ps in by_doc.items():
        assert sorted({(p.start, p.length) for p in ps})[0][0] == 0
        assert sum(p.length for p in ps) % len(ids[d]) == 0
    assert set(by_doc) == set(ids)
    padded = total = 0
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        total += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    return padded / total


def test_pack(spark, sf_dir, library):
    df = documents(spark, sf_dir)
    rows = packing.pack(df.repartition(4, "doc_id")).collect()
    waste = check_packing(rows, [(r.doc_id, r.text) for r in df.collect()], library)
    assert waste < 0.05
    assert len({r.sequence_id for r in rows if 2048 // r.length == 2}) <= len([r for r in rows if 2048 // r.length == 2]) // 2 + 3


def test_pack_dirty(spark, library):
    df = dirty(spark).filter("doc_id is not null")
    check_packing(packing.pack(df).collect(), [(r.doc_id, r.text) for r in df.collect()], library)
    assert packing.pack(empty(spark)).count() == 0
    assert packing.pack(dirty(spark)).filter("doc_id is null").count() >= 2
