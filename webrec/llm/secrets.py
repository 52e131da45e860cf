"""Secret scan: fixed patterns, and a linear-chain conditional random field.

The patterns (``assign``, ``access``, ``hex``) give the base spans. The field
tags every token as begin, inside or outside of a secret by its own shape, the
shapes and words of its neighbours and features of the whole text, and is
decoded by Viterbi; what it finds beside the base spans is added as ``crf``.

Training data: windows around tokens of a bounded sample of the table's texts,
labelled by the patterns, and the same windows with secrets of many makes
(drawn by rule, fixed seed) and with harmless look-alikes put in. The weights
maximise the conditional likelihood (forward-backward, Adam).

Decoding is exact and whole. Scores are sums over a token and its neighbours,
so each distinct token's share is looked up, not computed. Where outside beats
the other tags by more than two transitions can give back, it is in every best
path; Viterbi runs over the stretches between such tokens.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrec.llm.base import id_text, map_slices
from webrec.llm.bpe import Memo

# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "crf")

SAMPLE = 300
WINDOW = 12
ROUNDS = 120
MEMO_WORDS = 250_000
OUTSIDE, BEGIN, INSIDE = range(3)

TOKEN = re.compile(r"[\w+/.\-]+|[^\s\w+/.\-]+")
#: What may be said before, in or after a secret; identities the field knows.
HINTS = (
    "password", "passwd", "pwd", "pass", "secret", "token", "key", "api_key", "apikey", "api", "access", "auth", "authorization", "bearer", "basic",
    "private", "credential", "credentials", "login", "session", "id", "is", "my", "the", "=", ":", ":=", "=>", '"', "'", '="', '":', "='", "://", "@", ",", "(", ")", "`",
)
HINT_ID = {w: k for k, w in enumerate(HINTS)}
HEXES, MASKED = frozenset(string.hexdigits), bytes(1 if chr(c) in "0123456789abcdef" else 0 for c in range(256))


def shape(token: str) -> list[int]:
    """Numbers of the features that a token has."""
    on = [0]
    n = len(token)
    body = token.strip(".-/+")
    lower, upper, digit = (sum(map(f, body)) for f in (str.islower, str.isupper, str.isdigit))
    on.append(1 + min(7, int(math.log2(n + 1))))  # 1..8
    for k, yes in enumerate((lower, upper, digit, lower and upper, lower and digit, upper and digit, lower and upper and digit, not (lower or upper or digit), not body.isascii()), 9):
        if yes:
            on.append(k)  # 9..17
    if body:
        if all(c in HEXES for c in body) and digit:
            on.append(18 + min(3, len(body) // 12))  # 18..21
        if upper + digit == len(body) and upper and digit:
            on.append(22 + min(3, len(body) // 8))  # 22..25
        kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "p" for c in body]
        turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
        on.append(26 + min(5, turns // 2))  # 26..31
        if len(set(body)) > 10:
            on.append(32 + min(3, len(set(body)) // 6))  # 32..35
        if body.isdigit():
            on.append(36)
        if body[0].isupper() and body[1:].islower():
            on.append(37)
        if re.fullmatch(r"[0-9]+([./-][0-9]+)+", body):
            on.append(38)  # dates, addresses, versions
        if "/" in body or "+" in body:
            on.append(39)
        if re.fullmatch(r"(?:[a-z0-9-]+\.)+[a-z]{2,}", body) or "://" in token or "@" in token:
            on.append(40)  # hosts
        if re.match(r"[A-Za-z]{2,6}[_-]", body) and turns > 4:
            on.append(41)  # a named prefix
        if len(body) >= 16 and turns > 4:
            on.append(42)
    word = token.lower()
    if word in HINT_ID:
        on.append(SHAPES + HINT_ID[word])
    return on


SHAPES = 43
WIDTH = SHAPES + len(HINTS)
FILE = 6


def file_features(n_tokens: int, n_digits: int, n_marks: int) -> np.ndarray:
    """Features of a whole text: size, share of tokens with digits, of marks."""
    out = np.zeros(FILE, np.float32)
    out[0 if n_tokens < 50 else 1 if n_tokens < 1000 else 2] = 1
    out[3] = n_digits * 20 > n_tokens
    out[4] = n_marks * 4 > n_tokens
    out[5] = n_digits == 0
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``start, kind, end`` of the base spans in code points. Cheap searches
    decide whether a pattern needs to run."""
    low = text.encode("utf-8")
    found = []
    small = low.lower()
    if any(w in small for w in (b"passw", b"secret", b"token", b"apikey", b"api_key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in low:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"\x01" * 24 in low.translate(MASKED):
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Field:
    """Weights: emission by place (previous, own, next token), file, and
    transitions; the outside tag's emissions are zero."""

    def __init__(self, weights: np.ndarray, file: np.ndarray, moves: np.ndarray):
        self.weights, self.file, self.moves = weights, file, moves  # [3 places, WIDTH, 3], [FILE, 3], [3, 3]

    def row(self, token: str) -> np.ndarray:
        """A token's share of its next, own and previous token's scores, then
        whether it has a digit and is a mark."""
        on = shape(token)
        return np.concatenate([self.weights[:, on].sum(1).ravel(), [any(map(str.isdigit, token)), not any(map(str.isalnum, token))]]).astype(np.float32)


def scores(rows: np.ndarray, field: Field) -> np.ndarray:
    """Emission of every token of a text from the rows of its tokens."""
    s = rows[:, 3:6] + file_features(len(rows), rows[:, 9].sum(), rows[:, 10].sum()) @ field.file
    s[1:] += rows[:-1, 0:3]
    s[:-1] += rows[1:, 6:9]
    return s


def viterbi(s: np.ndarray, moves: np.ndarray, before: bool, after: bool) -> list[int]:
    """Best tags of a stretch; ``before`` and ``after`` say that an outside
    token stands there."""
    best = s[0] + (moves[OUTSIDE] if before else 0)
    came = []
    for x in s[1:]:
        paths = best[:, None] + moves
        came.append(paths.argmax(0))
        best = paths.max(0) + x
    if after:
        best = best + moves[:, OUTSIDE]
    tags = [int(best.argmax())]
    for c in reversed(came):
        tags.append(int(c[tags[-1]]))
    return tags[::-1]


def tagged_spans(text: str, tags: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of the tagged secrets, without punctuation at the ends."""
    spans: list[list[int]] = []
    for m, tag in zip(TOKEN.finditer(text), tags.tolist()):
        if tag == BEGIN or (tag == INSIDE and (not spans or spans[-1][2] != m.start() - 1 and spans[-1][3] == OUTSIDE)):
            spans.append([m.start(), m.end(), 0, tag])
        elif tag == INSIDE:
            spans[-1][1] = m.end()
        if spans:
            spans[-1][3] = tag
    out = []
    for a, b, *_ in spans:
        while a < b and not text[a].isalnum():
            a += 1
        while a < b and not text[b - 1].isalnum():
            b -= 1
        if a < b:
            out.append((a, b))
    return out


# --- training -----------------------------------------------------------------


def drawn_secret(r: random.Random) -> tuple[str, str]:
    """What stands before a secret (often nothing), and one."""
    many = lambda abc, lo, hi: "".join(r.choice(abc) for _ in range(r.randint(lo, hi)))
    alnum = string.ascii_letters + string.digits
    made = r.choice([
        lambda: many("0123456789abcdef", 16, 64), lambda: "AKIA" + many(string.ascii_uppercase + string.digits, 12, 20), lambda: many(alnum, 20, 44),
        lambda: r.choice(["ghp_", "sk-", "sk_live_", "xoxb-", "glpat-", "pk_test_"]) + many(alnum, 18, 40), lambda: many(alnum + "+/", 24, 60),
        lambda: "eyJ" + many(alnum, 16, 30) + "." + many(alnum, 20, 40) + "." + many(alnum + "_-", 20, 40), lambda: "AIza" + many(alnum + "_-", 30, 36),
    ])()
    lead = r.choice(["", "", "", "password=", "secret: ", "token = ", "api_key=", "Authorization: Bearer ", "my key is ", "credentials: ", 'key="', "pwd:"])
    return lead, made


def drawn_harmless(r: random.Random) -> str:
    n = lambda k: str(r.randint(0, 10**k))
    word = "".join(r.choice(string.ascii_lowercase) for _ in range(r.randint(6, 14)))
    return r.choice([
        lambda: f"{r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", lambda: f"{word}@{word[:5]}.com", lambda: f"https://www.{word}.org/{word[:4]}/{n(5)}",
        lambda: f"{n(4)}-{n(2)}-{n(2)}", lambda: f"+{n(2)} {n(3)} {n(4)}", lambda: n(9), lambda: word.upper() + "!!", lambda: word + "***", lambda: "the password", lambda: "a secret",
        lambda: "token of thanks", lambda: word.capitalize() * 2, lambda: f"v{n(1)}.{n(2)}.{n(1)}", lambda: f"{n(3)}%", lambda: word * 3, lambda: f"ISBN {n(9)}", lambda: f"#{n(5)}",
        lambda: f"555-{n(4)}", lambda: f"{word}_{word[:3]}", lambda: f"{word}/{word}",
    ])()


def labelled(text: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    words, tags, k, inside = [], [], 0, False
    for m in TOKEN.finditer(text):
        while k < len(spans) and spans[k][1] <= m.start():
            k, inside = k + 1, False
        hit = k < len(spans) and m.start() < spans[k][1] and m.end() > spans[k][0]
        words.append(m[0])
        tags.append((INSIDE if inside else BEGIN) if hit else OUTSIDE)
        inside = hit
    return words, tags


def secret_part(text: str, kind: int, start: int, end: int) -> tuple[int, int]:
    """Of an assignment only the value is tagged."""
    if kind == 0:
        m = ASSIGN.match(text, start)
        return m.span(2)
    return start, end


def examples(texts: list[str], seed: int = 11) -> list[tuple[list[str], list[int], np.ndarray]]:
    """Windows with tags and the features of their text."""
    r, out = random.Random(seed), []
    for text in sorted(texts):
        spans = base_spans(text)
        words, tags = labelled(text, sorted({secret_part(text, k, a, b) for a, k, b in spans}))
        if not words:
            continue
        file = file_features(len(words), sum(any(map(str.isdigit, w)) for w in words), sum(not any(map(str.isalnum, w)) for w in words))
        hits = [i for i, t in enumerate(tags) if t]
        odd = [i for i, w in enumerate(words) if len(w) > 14 or any(map(str.isdigit, w))]
        places = hits[:4] + r.sample(odd, min(3, len(odd))) + [r.randrange(len(words)) for _ in range(2)]
        for i in places:
            a = max(0, i - r.randint(1, WINDOW - 1))
            out.append((words[a : a + WINDOW], tags[a : a + WINDOW], file))
        for put in range(3):
            a = r.randrange(len(words))
            around = words[a : a + WINDOW - 2]
            cut = r.randint(0, len(around))
            lead, value = drawn_secret(r) if put < 2 else ("", drawn_harmless(r))
            head = " ".join(around[:cut]) + " " + lead
            tail = r.choice(["", ".", '"', ","]) + " " + " ".join(around[cut:])
            whole = head + value + tail
            w, t = labelled(whole, [(len(head), len(head) + len(value))] if put < 2 else [])
            out.append((w[: WINDOW + 6], t[: WINDOW + 6], file))
    return out


def train(data: list[tuple[list[str], list[int], np.ndarray]], rounds: int = ROUNDS, rate: float = 0.08, decay: float = 2e-4) -> Field:
    """Adam on the mean negative log-likelihood of the windows."""
    n, t = len(data), max(len(w) for w, _, _ in data)
    x = np.zeros((n, t + 2, WIDTH), np.float32)  # a blank token at both ends
    y, mask, file = np.zeros((n, t), np.int64), np.zeros((n, t), np.float32), np.stack([f for _, _, f in data])
    for k, (words, tags, _) in enumerate(data):
        for i, w in enumerate(words):
            x[k, i + 1, shape(w)] = 1
        y[k, : len(tags)], mask[k, : len(tags)] = tags, 1
    places = [x[:, 0:t].reshape(-1, WIDTH), x[:, 1 : t + 1].reshape(-1, WIDTH), x[:, 2:].reshape(-1, WIDTH)]
    one = np.eye(3, dtype=np.float32)
    gold = one[y] * mask[..., None]
    pair = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    w, f, m = np.zeros((3, WIDTH, 3), np.float32), np.zeros((FILE, 3), np.float32), np.zeros((3, 3), np.float32)
    params, first, second = [w, f, m], [np.zeros_like(p) for p in (w, f, m)], [np.zeros_like(p) for p in (w, f, m)]
    for step in range(1, rounds + 1):
        s = sum(p @ w[k] for k, p in enumerate(places)).reshape(n, t, 3) + (file @ f)[:, None]
        alpha = np.zeros_like(s)
        alpha[:, 0] = s[:, 0]
        for i in range(1, t):
            go = np.logaddexp.reduce(alpha[:, i - 1, :, None] + m, axis=1) + s[:, i]
            alpha[:, i] = np.where(mask[:, i, None] > 0, go, alpha[:, i - 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        beta, moved = np.zeros((n, 3), np.float32), np.zeros((3, 3))
        expect = np.zeros_like(s)
        for i in range(t - 1, -1, -1):
            live = mask[:, i, None]
            expect[:, i] = np.exp(np.minimum(alpha[:, i] + beta - z[:, None], 0)) * live
            if i:
                both = np.exp(np.minimum(alpha[:, i - 1, :, None] + m + (s[:, i] + beta)[:, None] - z[:, None, None], 0)) * live[..., None]
                moved += both.sum(0)
                beta = np.where(live > 0, np.logaddexp.reduce(m + (s[:, i] + beta)[:, None], axis=2), beta)
        off = ((expect - gold) / n).astype(np.float32)
        flat = off.reshape(-1, 3)
        grads = [np.stack([p.T @ flat for p in places]) + decay * w, file.T @ off.sum(1) + decay * f, ((moved - pair) / n).astype(np.float32) + decay * m]
        for p, g, a, b in zip(params, grads, first, second):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Field(w, f, m)


def fit(docs: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Field trained on at most ``sample`` texts, picked by a hash of their
    text; of an empty table, on drawn examples alone."""
    rows = docs.select(F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL AND length(text) < 20000").withColumn("pick", F.xxhash64("text"))
    least = [r.pick for r in rows.select("pick").distinct().orderBy("pick").limit(sample).collect()]
    texts = [r.text for r in rows.filter(F.col("pick") <= least[-1]).dropDuplicates(["pick"]).select("text").collect()] if least else []
    return train(examples(texts + ["one two three four five six seven eight"] * 40))


# --- scanning -----------------------------------------------------------------


def margin(shares: np.ndarray) -> np.ndarray:
    """How far outside is ahead in a share of the scores. The margin of a sum
    is at least the sum of its shares' margins."""
    return shares[..., 0] - np.maximum(shares[..., 1], shares[..., 2])


class Tagger(Memo):
    """Tags texts. Keeps, for a bounded number of distinct words, the numbers
    of their tokens' rows; plain words of one make share a row. Scores are made
    only where the margins do not settle a token by themselves."""

    def __init__(self, field: Field):
        super().__init__(self.numbers, MEMO_WORDS)
        self.field = field
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.elder = {}
        self.by_key: dict[object, int] = {}
        self.count, self.rows = 0, np.empty((1024, 11), np.float32)
        self.margins, self.flags = np.empty((3, 1024)), np.empty(1024, np.uint8)

    def number(self, token: str) -> int:
        """Row of a token. All features of a plain word follow from its
        length, case, alphabet and, if long, number of different letters."""
        body = token if token.isalpha() else token.strip(".-/+")
        key: object = token
        if body.isalpha() and token.lower() not in HINT_ID:
            head, rest, plain = body[0], body[1:], body.isascii()
            if (head.islower() or head.isupper()) and (not rest or (rest.islower() if plain else all(map(str.islower, rest)))):
                n = len(body)
                if n <= 10:
                    key = (len(token) + 1).bit_length(), head.islower(), n > 1, plain
                else:
                    key = (len(token) + 1).bit_length(), head.islower(), plain, min(24, len(set(body))), n >= 16
        at = self.by_key.get(key)
        if at is None:
            at = self.count
            if at == len(self.rows):
                self.rows, self.flags = np.concatenate([self.rows] * 2), np.concatenate([self.flags] * 2)
                self.margins = np.concatenate([self.margins] * 2, 1)
            row = self.rows[at] = self.field.row(token)
            self.margins[:, at] = margin(row[:9].reshape(3, 3).astype(float))
            self.flags[at] = row[9] + 2 * row[10]
            self.by_key[key] = at
            self.count += 1
        return at

    def numbers(self, word: str) -> tuple[int, ...]:
        if word.isalpha():  # one token
            return (self.number(word),)
        return tuple(map(self.number, TOKEN.findall(word)))

    def tags(self, text: str) -> np.ndarray:
        """Tags of a whole text, the same as Viterbi over all of it."""
        if self.count > MEMO_WORDS:
            self.reset()
        n = np.fromiter(chain.from_iterable(map(self.__getitem__, text.split())), np.int64)
        tags = np.zeros(len(n), np.int8)
        if not len(n):
            return tags
        flags, moves = self.flags[n], self.field.moves
        file = file_features(len(n), np.count_nonzero(flags & 1), np.count_nonzero(flags & 2)) @ self.field.file
        ahead = self.margins[1][n] + float(margin(file))
        ahead[1:] += self.margins[0][n[:-1]]
        ahead[:-1] += self.margins[2][n[1:]]
        # a little more than the bound, for the rounding of the scores
        unsure = np.flatnonzero(ahead <= 2 * float(moves.max() - moves.min()) + 1e-3)
        for run in np.split(unsure, np.flatnonzero(np.diff(unsure) > 1) + 1) if len(unsure) else ():
            a, b = int(run[0]), int(run[-1]) + 1
            s = self.rows[n[a:b], 3:6] + file
            lo, hi = max(a, 1), min(b, len(n) - 1)
            s[lo - a :] += self.rows[n[lo - 1 : b - 1], 0:3]
            s[: hi - a] += self.rows[n[a + 1 : hi + 1], 6:9]
            tags[a:b] = viterbi(s, moves, a > 0, b < len(n))
        return tags

    def spans(self, text: str) -> list[tuple[int, int]]:
        tags = self.tags(text)
        return tagged_spans(text, tags) if tags.any() else []


def outside(text: str, a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a..b outside the base spans that hold a letter or digit."""
    parts, at = [], a
    for s, _, e in sorted(base):
        if s < b and a < e:
            parts.append((at, s))
            at = max(at, e)
    return [(s, e) for s, e in [*parts, (at, b)] if s < e and any(c.isalnum() for c in text[s:e])]


def all_spans(text: str, tagger: Tagger) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: those and what the field finds beside them,
    also the rest of a secret that a base span covers in part."""
    base = base_spans(text)
    extra = [(s, 3, e) for a, b in tagger.spans(text) for s, e in outside(text, a, b, base)]
    return base, sorted(base + extra)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, field: Field | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, n_crf``. A null or empty text has no spans; repeated rows stay; an
    empty table gives no rows; other columns are not read."""
    field = field or fit(docs, sample, id_col, text_col)

    def make():
        tagger = Tagger(field)

        def work(batch):
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column("text").to_pylist():
                base, spans = all_spans(text, tagger)
                for k in range(3):
                    out[k].append(sum(kind == k for _, kind, _ in base))
                out[3].append(hashlib.sha256(listed(base).encode()).hexdigest())
                out[4].append(listed(spans))
                out[5].append(len(spans) - len(base))
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf"],
            )

        return work

    return map_slices(id_text(docs, id_col, text_col), make, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long")


def masked(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every span replaced; spans that touch or overlap as one."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a > end:
            out += [text[at:a], mark]
        at = end = max(end, b)
    return "".join([*out, text[at:]])
