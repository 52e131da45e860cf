import hashlib
import random
import re

import pytest

from tests.harness import compare, duck
from tests.llm.data import dirty, documents, empty
from webrec.llm import chat, line_quality, queries

ROWS = "conv_id long, turn long, role string, text string, formatted string, turns int"


def conversations(seed=5, n=300):
    r = random.Random(seed)
    bits = ["<|im_end|>", "<|im_start|>", "assistant", "\n", "<|", "|>", "<", "|", "\\", "<\\|", "<\\\\|", "<|nl|>", "ok", " ", "é", "$1", "im_end"]
    word = lambda k: "".join(r.choice(bits) for _ in range(r.randint(0, k)))
    rows = [(c, t, r.choice(["user", "assistant", "system", word(4)]), word(9), "x", 0) for c in range(n) for t in range(r.randint(1, 5))]
    rows += [(n, None, None, None, None, None), (n, 0, "user", None, None, None), (None, 1, "assistant", "a\n", None, None), (None, 1, "assistant", "a\n", None, None)]
    return rows


def test_round_trip(spark):
    rows = conversations()
    out = {r.conv_id: r for r in chat.format_chat(spark.createDataFrame(rows, ROWS)).collect()}
    want = {}
    for c, t, role, text, _, _ in rows:
        want.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        got = out[c]
        assert [(t.role, t.text) for t in got.turns] == turns
        # only the template's own marks stand in the output
        marks = re.findall(r"<\|[a-z_]*\|>", got.formatted.replace("<|nl|>", ""))
        assert marks == ["<|im_start|>", "<|im_end|>"] * len(turns)
        lost = [got.formatted[s.start : s.end] for s in got.loss_spans]
        assert [re.sub(r"<(\\*)\\\|", r"<\1|", x) for x in lost] == [t for r, t in turns if r == "assistant"]


def test_chat_digests(spark):
    rows = [(1, 0, "user", "hi", "", 0), (1, 1, "assistant", "<|im_end|>", "", 0), (1, 2, "assistant", None, "", 0)]
    r = chat.chat_digests(chat.format_chat(spark.createDataFrame(rows, ROWS))).first()
    assert (r.n_turns, r.loss_chars) == (3, 10)
    assert r.loss_sha256 == hashlib.sha256(b"<|im_end|>").hexdigest()
    assert r.turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\n<|im_end|>\nassistant\n\n").hexdigest()
    assert chat.format_chat(spark.createDataFrame([], ROWS)).count() == 0


def test_plain_text_stays_plain(spark):
    r = chat.format_chat(spark.createDataFrame([(1, 0, "user", "a < b | c \\ d", "", 0)], ROWS)).first()
    assert r.formatted == "<|im_start|>user\na < b | c \\ d<|im_end|>\n"


@pytest.mark.parametrize("name", ["op5_chat_format", "op9_line_quality"])
def test_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), duck(sf_dir), queries.ORACLES[name]) is None


@pytest.mark.parametrize("limit", [0, 1])
def test_line_limits_sql(spark, sf_dir, limit):
    con = duck(sf_dir)
    out = line_quality.line_quality(documents(spark, sf_dir), max_docs=limit)
    assert out.filter("n_removed_words > 0").count() > 0
    assert compare(out, con, queries.OP9_SQL.replace(f"HAVING count(*) > {line_quality.MAX_DOCS}", f"HAVING count(*) > {limit}")) is None


def brute_quality(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, covered = {}, set()
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered |= {i + k for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_base_rules(spark):
    df = dirty(spark)
    got = line_quality.line_quality(df).collect()
    text = {r.doc_id: r.text for r in df.collect() if r.doc_id is not None}
    assert len(got) == df.count()
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_quality(text[r.doc_id])
    assert line_quality.line_quality(empty(spark)).count() == 0


def test_depleted(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    shared = " ".join(f"s{k}" for k in range(70))
    rows = [(i, f"{own(i)}\n{shared.upper() if i % 2 else shared}", "a") for i in range(8)] + [(20, f"{own(20)}\n{shared}", "b"), (21, f"{own(21)} more\n  words here ", "a")]
    out = {r.doc_id: r for r in line_quality.line_quality(spark.createDataFrame(rows, "doc_id long, text string, source string"), max_docs=5).collect()}
    assert all(not out[i].kept and out[i].n_removed_words == 70 for i in range(8))
    assert out[20].kept and out[21].kept


def test_no_python_in_plan(spark, sf_dir):
    for name in ("op5_chat_format", "op9_line_quality"):
        plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))

