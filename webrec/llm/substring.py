"""Repeated passages by content-defined chunks.

A gear hash rolls over the bytes of a text, h = 2h + GEAR[byte], over the last
``WINDOW`` bytes. A chunk ends where the hash is smaller than at any of the
``NEAR`` places before and after, so an end depends on some 50 bytes around it
and on nothing else: an insertion moves the ends near it and no others. Chunks
are longer than ``NEAR`` bytes and about twice that on average. Text that
repeats a few bytes has no such place and is cut every ``MOST`` bytes. Ends are
moved to the next character.

A chunk is known by a 64-bit digest. Digests found in two or more documents are
duplicates; per document, neighbouring duplicate chunks form a span if their
first or last other document is the same, or if the two stand side by side in
another document too, whoever else has one of them. Spans of at least
``MIN_WORDS`` words are reported. A passage of over 50 words holds several whole
chunks in every document that has it; a few chunks that agree by chance do not
get there.

Chunks are written once, in the shared folder. Per digest only the smallest
and largest document id are gathered (pre-aggregated, so a passage of a third
of all documents is no large group); duplicate digests are joined back, a join
that the adaptive planner may split, and what is left meets by document. Pairs of
neighbours are gathered in the same way, of duplicate chunks only, and not where
the first and the last document of both agree: every document then sees one of
the two as another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webrec.llm.base import SLICE, id_text, raw, stored

NEAR = 16
WINDOW = 16
MOST = 512
MIN_WORDS = 25
SEED = 2024
BLOCK = 1 << 20


def gear() -> np.ndarray:
    """256 random 64-bit numbers."""
    return np.random.default_rng(SEED).integers(0, (1 << 64) - 1, 256, dtype=np.uint64)


def rolling(data: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Gear hash after each byte over the last ``WINDOW`` bytes, by doubling:
    H over 2w bytes is H over w, plus that of w bytes before, shifted by w."""
    h = table[data]
    w = 1
    while w < WINDOW:
        h[w:] += h[:-w] << np.uint64(w)
        w *= 2
    return h


def least(h: np.ndarray, near: int) -> np.ndarray:
    """Least value of each stretch of ``near`` places."""
    w = 1
    while w < near:
        step = min(w, near - w)
        h = np.minimum(h[: len(h) - step], h[step:])
        w += step
    return h


def chunk_ends(data: bytes, table: np.ndarray, near: int = NEAR) -> np.ndarray:
    """End of each chunk in bytes, in order; the last is the text's length.
    Long texts go block by block, with what an end may depend on around them."""
    n = len(data)
    found = [np.empty(0, np.int64)]
    for at in range(0, n, BLOCK):
        lo, hi = max(0, at - near - WINDOW), min(n, at + BLOCK + near)
        h = rolling(np.frombuffer(data, np.uint8, hi - lo, lo), table)
        if len(h) <= 2 * near:
            continue
        low = least(h, near)  # low[i]: of places i .. i + near - 1
        mid = h[near : len(h) - near]
        ends = np.flatnonzero((mid < low[: len(mid)]) & (mid < low[near + 1 : near + 1 + len(mid)])) + near + lo + 1
        found.append(ends[(ends > at) & (ends <= at + BLOCK)])
    edges = np.r_[0, np.concatenate(found), n].astype(np.int64)
    far = np.flatnonzero(np.diff(edges) > MOST)
    ends = np.concatenate([edges[1:], *(np.arange(edges[i] + MOST, edges[i + 1], MOST) for i in far)])
    b = np.frombuffer(data, np.uint8)
    heads = np.r_[np.flatnonzero((b & 0xC0) != 0x80), n]
    ends = np.unique(heads[np.searchsorted(heads, ends)])
    return ends[ends > 0]


CHUNKS = "doc_id long, n int, start int, end int, digest long, n_words int"


def chunks(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """Chunks of ``doc_id, text``: number, start and end in code points,
    digest, and the words that begin in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = gear()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                out: list[list] = [[] for _ in range(6)]
                for doc, data in zip(part.column("doc_id").to_pylist(), raw(part, "text")):
                    stops = chunk_ends(data, table, near)
                    if not len(stops) or doc is None:
                        continue
                    edges = np.r_[0, stops]
                    cuts = edges.tolist()
                    b = np.frombuffer(data, np.uint8)
                    chars = np.searchsorted(np.flatnonzero((b & 0xC0) != 0x80), edges)
                    blank = (b == 32) | ((b >= 9) & (b <= 13))
                    begins = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
                    digests = [xxhash.xxh3_64_intdigest(data[s:e]) for s, e in zip(cuts, cuts[1:])]
                    for column, x in zip(out, (
                        np.full(len(stops), doc), np.arange(len(stops)), chars[:-1], chars[1:], np.array(digests, np.uint64).view(np.int64),
                        np.diff(np.searchsorted(begins, edges)),
                    )):
                        column.append(x)
                if out[0]:
                    whole = [np.concatenate(c) for c in out]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64() if k in (0, 4) else pa.int32()) for k, c in enumerate(whole)],
                        ["doc_id", "n", "start", "end", "digest", "n_words"],
                    )

    return docs.mapInArrow(run, CHUNKS)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, near: int = NEAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span of a document that also stands in another one:
    ``doc_id, start, end`` (code points), ``n_words, keep_id`` and ``kept``
    (``keep_id`` is this document). Each chunk stays in the smallest id that has
    it; ``keep_id`` is the largest of those over the span, so a span that is
    not kept stands, chunk by chunk, in documents before this one.

    Documents without such a span have no row: null, empty and unique texts.
    Rows repeated with one id are one document; rows without an id are not
    compared. Other columns are not read."""
    parts = stored(chunks(id_text(docs, id_col, text_col), near))
    shared = parts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    met = parts.join(shared, "digest").repartition("doc_id").dropDuplicates(["doc_id", "n", "digest"])
    order = Window.partitionBy("doc_id").orderBy("n", "digest")
    before = [F.lag(c).over(order) for c in ("n", "first", "last", "digest")]
    beside = F.coalesce(F.col("n") - before[0] <= 1, F.lit(False))
    # the same other document before and here
    same = [(F.col(c) == b) & (F.col(c) != F.col("doc_id")) for c, b in zip(("first", "last"), before[1:])]
    both = (F.col("first") == before[1]) & (F.col("last") == before[2])
    met = met.select("*", beside.alias("beside"), (beside & (same[0] | same[1])).alias("goes_on"), (beside & ~both).alias("mixed"), before[3].alias("prior"))
    met = stored(met.drop("last"))
    pairs = met.filter("mixed").groupBy("prior", "digest").agg((F.min("doc_id") < F.max("doc_id")).alias("met")).filter("met")
    asked = met.filter("beside AND NOT goes_on").join(pairs, ["prior", "digest"], "left").withColumn("goes_on", F.col("met").isNotNull())
    columns = ["doc_id", "n", "start", "end", "digest", "n_words", "first", "goes_on"]
    met = met.filter("goes_on OR NOT beside").select(columns).unionByName(asked.select(columns))
    spans = met.withColumn("new", F.when(F.col("goes_on"), 0).otherwise(1)).withColumn("span", F.sum("new").over(order))
    spans = spans.groupBy("doc_id", "span").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_words").alias("n_words"), F.max("first").alias("keep_id")
    )
    return spans.filter(F.col("n_words") >= min_words).select(
        "doc_id", F.col("start").cast("long"), F.col("end").cast("long"), "n_words", "keep_id", (F.col("doc_id") == F.col("keep_id")).alias("kept")
    )


def without_passages(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text`` with the spans that are kept elsewhere cut out. A null
    text is empty; rows without spans stay as they are."""
    cuts = spans.filter("NOT kept").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    rows = id_text(docs, id_col, text_col).join(cuts, "doc_id", "left")
    text = F.col("text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(
        "cuts", start,
        lambda acc, c: F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(c["start"] - acc["at"], F.lit(0)).cast("int"))).alias("out")),
        lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))),
    )
    return rows.select("doc_id", F.coalesce(cut, text).alias("text"))
