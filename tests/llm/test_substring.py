import random

import numpy as np

from tests.llm.data import dirty, documents, empty
from webrec.llm import substring


def prose(r, n):
    return " ".join("".join(r.choice("abcdefghijklmnoprstuvwxyzéß") for _ in range(r.randint(2, 9))) for _ in range(n))


def test_rolling_is_the_gear_hash():
    table, data = substring.gear(), bytes(random.Random(1).randbytes(200))
    got = substring.rolling(np.frombuffer(data, np.uint8), table).tolist()
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - substring.WINDOW + 1) : i + 1]:
            h = (2 * h + int(table[b])) % 2**64
        assert got[i] == h


def test_ends_resist_insertions(monkeypatch):
    r, table = random.Random(2), substring.gear()
    text = prose(r, 4000)
    plain = substring.chunk_ends(text.encode(), table)
    parts = {text.encode()[a:b] for a, b in zip([0, *plain], plain)}
    moved = ("x" * 7 + text[:9000] + " inserted words " + text[9000:]).encode()
    ends = substring.chunk_ends(moved, table)
    same = [moved[a:b] in parts for a, b in zip([0, *ends], ends)]
    assert sum(same) >= len(same) - 8
    assert b"".join(moved[a:b] for a, b in zip([0, *ends], ends)) == moved
    monkeypatch.setattr(substring, "BLOCK", 500)
    assert substring.chunk_ends(text.encode(), table).tolist() == plain.tolist()


def test_ends_of_odd_texts():
    table = substring.gear()
    for t in ("", "a", "é" * 40, "x" * 10_000, "ab " * 5000, "日本語" * 300):
        data = t.encode()
        ends = substring.chunk_ends(data, table).tolist()
        assert (ends[-1] if ends else 0) == len(data) and ends == sorted(set(ends))
        assert "".join(data[a:b].decode() for a, b in zip([0, *ends], ends)) == t
        assert all(b - a <= substring.MOST + 4 for a, b in zip([0, *ends], ends))


def test_planted_passages(spark):
    """Passages of 51 words in otherwise unique texts: all found, nothing else."""
    r = random.Random(4)
    rows, want = [], {}
    for p in range(60):
        passage = prose(r, 51)
        for k in range(r.choice([2, 2, 3, 10])):
            before, i = prose(r, r.randint(0, 150)), len(rows)
            text = before + " " + passage + " " + prose(r, r.randint(0, 150))
            want[i] = (len(before) + 1, len(before) + 1 + len(passage))
            rows.append((i, text))
    clean = range(len(rows), len(rows) + 100)
    rows += [(i, prose(r, 200)) for i in clean]
    out = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {s.doc_id for s in out} == set(want)
    for s in out:
        a, b = want[s.doc_id]
        assert a - 3 <= s.start < s.end <= b + 3 and s.n_words >= 25
        assert s.kept == (s.doc_id == s.keep_id)


def test_third_document_has_a_part(spark):
    """Passages of 51 words in two documents; a third one, before or after
    them, has one middle chunk or half of the passage."""
    r, table = random.Random(11), substring.gear()
    rows, want = [], {}

    def put(i, part):
        before = prose(r, 60)
        rows.append((i, before + " " + part + " " + prose(r, 60)))
        return len(before) + 1

    for p in range(40):
        passage = prose(r, 51)
        if p % 4 < 2:
            data = passage.encode()
            ends = substring.chunk_ends(data, table)
            # the words around a middle chunk, so that its ends are found again
            lo, hi = (int(ends[k]) for k in (len(ends) // 2 - 2, len(ends) // 2 + 1))
            part = data[lo:hi].decode()
        else:
            part = " ".join(passage.split()[:26])
        first, third = 1000 * p + 10, 1000 * p + (5 if p % 2 else 20)
        put(third, part)
        for i in (first, first + 1):
            at = put(i, passage)
            want[i] = (at, at + len(passage))
    out = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    found = {s.doc_id: s for s in out if s.doc_id in want}
    assert set(found) == set(want) and len([s for s in out if s.doc_id in want]) == len(want)
    for i, s in found.items():
        a, b = want[i]
        assert a - 3 <= s.start < s.end <= b + 3 and s.end - s.start > 0.6 * (b - a)


def test_spans_do_repeat(spark, sf_dir):
    df = documents(spark, sf_dir.replace("0.001", "0.01"))
    text = {r.doc_id: r.text for r in df.collect()}
    out = substring.repeated_passages(df).collect()
    assert out
    for s in out[:400]:
        part = text[s.doc_id][s.start : s.end]
        probe = part[5:65]
        assert any(probe in t for d, t in text.items() if d != s.doc_id and t), s
    copies = {}
    for d, t in text.items():
        copies.setdefault(t, []).append(d)
    found = {s.doc_id for s in out}
    assert all(d in found for t, ids in copies.items() if len(ids) > 1 and t and len(t.split()) > 60 and len(set(t.split())) > 30 for d in ids)


def test_dirty_and_without(spark):
    df = dirty(spark)
    out = substring.repeated_passages(df)
    rows = out.collect()
    assert {s.doc_id for s in rows} == {9, 10}  # the long text and the same with an end
    back = substring.without_passages(df.filter("doc_id is not null"), out)
    text = {r.doc_id: r.text for r in back.collect()}
    src = {r.doc_id: r.text for r in df.collect()}
    assert text[9] == src[9] and len(text[10]) < 300 and text[0] == "" and text[5] == src[5]
    assert substring.repeated_passages(empty(spark)).count() == 0
    assert substring.without_passages(empty(spark), substring.repeated_passages(empty(spark))).count() == 0
