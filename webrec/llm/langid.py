"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary classifier per bit, a
logistic regression over hashed byte n-grams, predicts that bit; the codeword
with the smallest loss wins, each bit's logistic loss weighted by how well its
classifier did in training. Up to 7 languages use all dichotomies, more use
random codewords far apart. The score is the winner's share of
exp(-loss); where the runner-up is within ``margin`` the answer is flagged as
ambiguous.

Training uses at most ``max_docs`` whole documents, the same number for each
language, picked by a hash of their id among rows outside the held-out fold.
Only text and language of those rows are learned from; prediction sees text
alone. The model is a small matrix that travels with the tasks.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrec.llm.base import id_text, map_slices, raw

DIM = 1 << 12
ORDERS = (2, 3)
MAX_DOCS = 1200
ROUNDS = 150
MARGIN = 1.0
FOLDS = 5
UNKNOWN = "und"

#: A-Z to lower case; all other ASCII but a-z to a blank.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))
MIX = np.uint32(2654435761)


def features(text: bytes, dim: int = DIM) -> np.ndarray:
    """Square roots of hashed n-gram counts, unit length."""
    b = np.frombuffer(b" " + text.translate(LETTERS) + b" ", np.uint8).astype(np.uint32)
    counts = np.zeros(dim, np.float32)
    bits = np.uint32(32 - (dim.bit_length() - 1))
    for n in ORDERS:
        if len(b) < n:
            continue
        g = np.full(len(b) - n + 1, n, np.uint32)
        blank = np.ones(len(g), bool)
        for k in range(n):
            part = b[k : len(b) - n + 1 + k]
            g = g * np.uint32(263) + part
            blank &= part == 32
        counts += np.bincount(((g * MIX) >> bits)[~blank], minlength=dim).astype(np.float32)
    np.sqrt(counts, out=counts)
    norm = float(np.sqrt(counts @ counts))
    return counts / norm if norm else counts


def codewords(n: int, seed: int = 17) -> np.ndarray:
    """One row of -1/+1 per language, no constant and no repeated column."""
    if n <= 7:
        columns = [[1] + [1 if k >> i & 1 else -1 for i in range(n - 1)] for k in range(max(1, 2 ** (n - 1) - 1))]
        return np.array(columns, np.float32).T.reshape(n, -1)
    r, bits, best = np.random.default_rng(seed), int(np.ceil(12 * np.log2(n))), None
    for _ in range(32):
        code = r.choice(np.array([-1, 1], np.float32), (n, bits))
        apart = (bits - code @ code.T)[~np.eye(n, dtype=bool)].min()
        if best is None or apart > best[0]:
            best = (apart, code)
    return best[1]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted loss of each codeword, rows of ``x`` being texts."""
        z = x @ self.weights + self.bias
        up, down = np.logaddexp(0, -z) * self.trust, np.logaddexp(0, z) * self.trust
        return up @ (self.code.T > 0) + down @ (self.code.T < 0)

    def predict(self, x: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Winner, score and ambiguity of each row."""
        loss = self.losses(x)
        best = loss.argmin(1)
        least = loss[np.arange(len(loss)), best]
        share = 1 / np.exp(least[:, None] - loss).sum(1)
        loss[np.arange(len(loss)), best] = np.inf
        return best, np.clip(share, 0, 1), (loss.min(1) - least < margin) if loss.shape[1] > 1 else np.zeros(len(loss), bool)


def train(x: np.ndarray, y: np.ndarray, languages: list[str], rounds: int = ROUNDS, rate: float = 20.0, decay: float = 1e-5) -> Model:
    """Accelerated gradient descent on all bits at once; rows count so that
    each language weighs the same."""
    code = codewords(len(languages))
    target = code[y]
    share = (1 / np.bincount(y, minlength=len(languages)))[y].astype(np.float32)[:, None] / len(languages)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    dw, db = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * share
        dw = 0.9 * dw - rate * (x.T @ g + decay * w)
        db = 0.9 * db - rate * 0.1 * g.sum(0)
        w, b = w + dw, b + db
    right = ((x @ w + b) * target > 0).astype(np.float32)
    trust = np.clip((right * share).sum(0) * 2 - 1, 0.05, 1)
    return Model(languages, code, w, b, (trust / trust.mean()).astype(np.float32))


def held_out(id_col: Column | str = "doc_id") -> Column:
    """The fold that is never learned from. A row without an id is in it."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def fit(docs: DataFrame, max_docs: int = MAX_DOCS, dim: int = DIM, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Model of the labelled rows outside the held-out fold; None without any."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter(~held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    each = max(1, max_docs // len(languages))
    # a thin slice of each language by hash, some times what is needed, then the exact number of it:
    # what is shuffled does not grow with the table
    hash_ = F.xxhash64("doc_id")
    parts = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, min(1 << 30, (8 * each + 64) * (1 << 30) // n))])
    thin = rows.filter(F.pmod(hash_, F.lit(1 << 30)) < F.element_at(parts, F.col("lang")))
    order = Window.partitionBy("lang").orderBy(hash_, "doc_id", "text")
    picked = thin.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= each).select("lang", "text")

    def make():
        def work(batch):
            x = [features(t, dim).astype(np.float16).tobytes() for t in raw(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(x, pa.binary())], ["lang", "x"])

        return work

    sample = sorted((r.lang, bytes(r.x)) for r in map_slices(picked, make, "lang string, x binary").collect())
    number = {name: k for k, name in enumerate(languages)}
    x = np.frombuffer(b"".join(s for _, s in sample), np.float16).reshape(len(sample), dim).astype(np.float32)
    return train(x, np.array([number[name] for name, _ in sample]), languages)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def tagger(model: Model | None, margin: float = MARGIN, dim: int = DIM):
    """Function from texts to their languages, scores and ambiguity."""

    def tag(texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        names, scores, unsure = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        real = [k for k, t in enumerate(texts) if model and t and has_letter(t)]
        if real:
            x = np.stack([features(texts[k].encode("utf-8"), dim) for k in real])
            for k, best, score, doubt in zip(real, *model.predict(x, margin)):
                names[k], scores[k], unsure[k] = model.languages[best], float(score), bool(doubt)
        return names, scores, unsure

    return tag


def predict(docs: DataFrame, model: Model | None, margin: float = MARGIN, dim: int = DIM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, lang_pred, score, ambiguous``."""

    def make():
        tag = tagger(model, margin, dim)

        def work(batch):
            names, scores, unsure = tag(batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names), pa.array(scores, pa.float64()), pa.array(unsure)], ["doc_id", "lang_pred", "score", "ambiguous"]
            )

        return work

    return map_slices(id_text(docs, id_col, text_col), make, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame, max_docs: int = MAX_DOCS, margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row: ``doc_id, held_out, lang_pred, score, ambiguous``.

    A text that is null, empty or without a letter is ``und`` with score 0, and
    so is every text where nothing could be learned. Rows without an id count
    as held out; repeated rows stay; an empty table gives no rows."""
    model = fit(docs, max_docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    return predict(docs, model, margin, id_col=id_col, text_col=text_col).withColumn("held_out", held_out())


def fold_of(doc_id: int) -> int:
    """The fold of an id, as SQL's crc32 gives it."""
    return zlib.crc32(str(doc_id).encode()) % FOLDS
