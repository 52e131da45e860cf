"""BPE encoding and decoding by a priority queue of merge ranks.

``WordBpe`` reads a public vocabulary file of the "BPE with word ends" kind
(NFC, lower case, white space dropped, byte-level symbols, ``</w>`` on the last
symbol of a word). The path is a parameter; the file is never copied.

A word starts as a doubly linked list of byte symbols. All adjacent pairs that
have a merge stand in a heap by (rank, position). The smallest is taken; when
its symbols have changed meanwhile the entry is stale and skipped; otherwise
the right symbol is unlinked and the two new pairs are pushed. That is
O(n log n) in the length of a word, so a run of a million characters without a
blank is no special case. Decoding joins vocabulary strings by one blank, as
the file names no decoder.

Special tokens written out in a text become their ids, as the library does by
default. White space separates words for the pattern, so a text is the
concatenation of its white-space tokens and each distinct token is worked out
once per task (memory bounded by ``MEMO_WORDS``; only speed depends on it).

Letters and digits are those of the ``regex`` module. For characters younger
than Unicode 15.1 its tables and the library's may differ.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from webrec.llm.base import id_text, map_slices

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
MEMO_WORDS = 250_000
WORD_MEMO = 200_000
MEMO_CHARS = 64
#: One of these behind letters is a word of its own.
MARKS = frozenset(".,;:!?)")
#: Controls that Python's split takes for white space and the pattern does not.
NOT_SPACE = re.compile(r"[\x1c-\x1f]")
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")
# fixed value: the word pattern named in the vocabulary file
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable and no
    blank, else the next free character from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


def normal(text: str) -> str:
    """NFC and lower case, letter by letter: a final sigma is no special case."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return text.lower() if "Σ" not in text else "".join(c.lower() for c in text)


class WordBpe:
    def __init__(self, path: str = WORD_BPE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings.update({i: s for s, i in self.special.items()})
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        symbols = byte_symbols()
        self.inner = [self.vocab[s] for s in symbols]
        self.last = [self.vocab[s + end] for s in symbols]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[self.vocab[a], self.vocab[b]] = (rank, self.vocab[a + b])
        self.known = Memo(self.word, WORD_MEMO)

    def word(self, word: str) -> list[int]:
        """Ids of one word of the pattern, already normalised."""
        data = word.encode("utf-8")
        ids = [self.inner[b] for b in data[:-1]] + [self.last[data[-1]]]
        n, merges = len(ids), self.merges
        if n == 1:
            return ids
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        # (rank, new) order equals (rank) order: a rank has one result
        while queue:
            _, new, i, left, right = heapq.heappop(queue)
            if ids[i] != left or (j := after[i]) >= n or ids[j] != right:
                continue  # stale
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(queue, (*m, i, new, ids[k]))
            if (h := before[i]) >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(queue, (*m, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def token(self, token: str) -> list[int]:
        """Ids of a stretch without white space."""
        if token.isalpha():
            word = normal(token)
            if word.isalpha():
                return [*self.known[word]]
        elif token[-1] in MARKS and (body := token[:-1]).isalpha():
            word = normal(body)
            if word.isalpha():
                return [*self.known[word], *self.known[token[-1]]]
        ids: list[int] = []
        for part in self.split_special.split(token) if "<|" in token else (token,):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for w in WORD.findall(normal(part)):
                    ids.extend(self.known[w])
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for t in tokens(text) for i in self.token(t)]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])


def tokens(text: str) -> list[str]:
    """White-space tokens of a text."""
    return text.split() if not NOT_SPACE.search(text) else [t for t in SPACE.split(text) if t]


class Memo(dict):
    """What ``make`` says of each token. At ``limit`` tokens these become the
    elder half, and what is asked again is taken over from there: frequent
    tokens stay, and twice ``limit`` are held at most."""

    def __init__(self, make: Callable, limit: int = MEMO_WORDS):
        super().__init__()
        self.make, self.limit, self.elder = make, limit, {}

    def __missing__(self, token: str):
        value = self.elder.get(token)
        if value is None:
            value = self.make(token)
            if len(token) > MEMO_CHARS:
                return value
        if len(self) >= self.limit:
            self.elder = dict(self)
            self.clear()
        self[token] = value
        return value


def encode(docs: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids array<int>`` per row. A null or blank text has no ids;
    repeated rows stay; other columns are not read."""

    def make():
        bpe = WordBpe(path)
        memo = Memo(bpe.token)

        def work(batch):
            ids = [[i for t in tokens(x) for i in memo[t]] for x in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return work

    return map_slices(id_text(docs, id_col, text_col), make, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids; null ids give the empty text."""

    def make():
        bpe = WordBpe(path)

        def work(batch):
            texts = [bpe.decode(x or []) for x in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

        return work

    return map_slices(rows.selectExpr(f"cast(`{id_col}` as long) doc_id", f"`{ids_col}` ids"), make, "doc_id long, text string")


def digests(docs: DataFrame, path: str = WORD_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: number of ids, SHA-256 of the decimal ids and of the decoded
    text. Encoding and decoding in one pass: what is kept per distinct token
    are its ids, decoded there and then; ids never leave the task."""

    def make():
        bpe = WordBpe(path)

        def both(token: str) -> tuple[int, str, str]:
            ids = bpe.token(token)
            return len(ids), " ".join(map(str, ids)), bpe.decode(ids)

        memo = Memo(both)

        def work(batch):
            out: list[list] = [[], [], []]
            for text in batch.column("text").to_pylist():
                parts = [memo[t] for t in tokens(text)]
                out[0].append(sum(p[0] for p in parts))
                for k in (1, 2):
                    out[k].append(hashlib.sha256(" ".join([p[k] for p in parts]).encode("utf-8")).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1]), pa.array(out[2])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return work

    return map_slices(id_text(docs, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
