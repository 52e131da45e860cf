"""Exact duplicates by composable polynomial fingerprints.

A text, lower-cased in A-Z only, is a string of bytes b. Its fingerprint is
sum((b[i] + 1) * BASE^(n-1-i)) modulo two primes below 2^31, with its length.
That composes: H(x + y) = H(x) * BASE^len(y) + H(y). So a text is hashed in
chunks, each by one vector product; a chunk's hash is shifted by the bytes that
follow it, and the chunks of a document simply add up, in any order, in a
pre-aggregated ``groupBy``. A huge document whose pieces lie in several rows is
hashed piece by piece where the pieces are (``fingerprint_pieces``).

Equal fingerprints are candidates only. The row with the largest id of each
group sends its text to the group's buckets (about ``BUCKET`` rows each, so a
group of any size is spread), where it comes first and every member's text is
compared with it chunk by chunk, up to the first difference. Members that
differ (a collision) form groups of their own in another round, until none is
left. Texts of documents whose fingerprint is unique take no part in that.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrec.llm.base import SLICE, ascii_lower, cut_lineage, id_text, map_slices, raw

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 69069069)
CHUNK = 1 << 16
BUCKET = 64
LOWEST = -(1 << 63)


def powers() -> list[np.ndarray]:
    """BASE^(CHUNK-1) ... BASE^0 for each modulus."""
    out = []
    for p, b in zip(PRIMES, BASES):
        row = [1]
        for _ in range(CHUNK - 1):
            row.append(row[-1] * b % p)
        out.append(np.array(row[::-1], np.uint64))
    return out


def chunk_hash(chunk: bytes, table: list[np.ndarray]) -> tuple[int, int]:
    """Hashes of at most ``CHUNK`` bytes. No sum passes 2^(9+31+16)."""
    data = np.frombuffer(chunk, np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int(np.dot(data, t[CHUNK - len(data) :])) % p for t, p in zip(table, PRIMES))


def shift(hashes: tuple[int, int], after: int) -> tuple[int, int]:
    """Hashes of the same bytes with ``after`` more behind them, those left out."""
    return tuple(h * pow(b, after, p) % p for h, b, p in zip(hashes, BASES, PRIMES))


def combine(x: tuple[int, int], y: tuple[int, int], y_bytes: int) -> tuple[int, int]:
    """Hashes of x + y."""
    return tuple((a + b) % p for a, b, p in zip(shift(x, y_bytes), y, PRIMES))


HASHED = "row_id long, doc_id long, text_sha256 string, n_bytes long, h1 long, h2 long"


def _chunk_rows(rows: DataFrame) -> DataFrame:
    """One row per chunk of ``row_id, doc_id, text``, hashes shifted to their place."""

    def make():
        table = powers()

        def work(batch):
            out: list[list] = [[] for _ in range(6)]
            for row, doc, text in zip(batch.column("row_id").to_pylist(), batch.column("doc_id").to_pylist(), raw(batch, "text")):
                text = text.lower()  # bytes: A-Z only
                sha = hashlib.sha256(text).hexdigest()
                for at in range(0, len(text) or 1, CHUNK):
                    chunk = text[at : at + CHUNK]
                    h = shift(chunk_hash(chunk, table), len(text) - at - len(chunk))
                    for c, v in zip(out, (row, doc, sha, len(text), *h)):
                        c.append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["row_id", "doc_id", "text_sha256", "n_bytes", "h1", "h2"])

        return work

    return map_slices(rows, make, HASHED)


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of ``doc_id, text``: ``row_id, doc_id, text_sha256,
    n_bytes, h1, h2``."""
    chunks = _chunk_rows(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text"))
    sums = [(F.sum(h) % p).alias(h) for h, p in zip(("h1", "h2"), PRIMES)]
    return chunks.groupBy("row_id", "doc_id", "text_sha256", "n_bytes").agg(*sums)


def fingerprint_pieces(pieces: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, h1, h2`` of documents given as rows ``doc_id,
    piece_no, text``: pieces are hashed where they are and combined by the
    bytes that follow each. A null text is empty; only numbers travel."""
    rows = pieces.select(F.col("piece_no").cast("long").alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    hashed = _chunk_rows(rows).groupBy("doc_id", "row_id", "n_bytes").agg(*[(F.sum(h) % p).alias(h) for h, p in zip(("h1", "h2"), PRIMES)])
    parts = F.sort_array(F.collect_list(F.struct("row_id", "n_bytes", "h1", "h2")))
    whole = hashed.groupBy("doc_id").agg(parts.alias("parts"), F.sum("n_bytes").alias("n_bytes"))

    def make():
        def work(batch):
            out = []
            for parts in batch.column("parts").to_pylist():
                h = (0, 0)
                for p in parts:
                    h = combine(h, (p["h1"], p["h2"]), p["n_bytes"])
                out.append(h)
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *[pa.array([h[k] for h in out], pa.int64()) for k in (0, 1)]],
                ["doc_id", "n_bytes", "h1", "h2"],
            )

        return work

    return map_slices(whole.select("doc_id", "n_bytes", "parts"), make, "doc_id long, n_bytes long, h1 long, h2 long")


def same(a: bytes, b: bytes) -> bool:
    """Chunkwise comparison, ended by the first difference."""
    x, y = memoryview(a), memoryview(b)
    return len(x) == len(y) and all(x[i : i + CHUNK] == y[i : i + CHUNK] for i in range(0, len(x), CHUNK))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by group and bucket, the group's sample text first."""
    at, sample = None, b""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            part = batch.slice(k, SLICE)
            docs, shas, keys, firsts = (part.column(c).to_pylist() for c in ("doc_id", "text_sha256", "bucket_key", "is_sample"))
            out: list[list] = [[], [], []]
            for doc, sha, key, first, text in zip(docs, shas, keys, firsts, raw(part, "text")):
                text = text.lower()
                if first:
                    if key != at:
                        at, sample = key, text
                    continue
                out[0].append(doc)
                out[1].append(sha)
                out[2].append(key == at and same(sample, text))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.bool_())], ["doc_id", "text_sha256", "same"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest ``doc_id`` stays. A null text
    equals the empty one. A null id counts as the smallest. Of rows repeated
    with one id and text, one stays and all count in ``group_size``; different
    texts under one id, or without one, are rows of their own. Long texts are
    hashed and compared in chunks. An empty table gives no rows; other columns
    are not read."""
    docs = id_text(docs, id_col, text_col)
    mark = ["h1", "h2", "n_bytes"]
    key = F.coalesce("doc_id", F.lit(LOWEST))
    prints = cut_lineage(fingerprints(docs).withColumn("id_key", key))
    done, todo, collided = None, prints, False
    while True:
        groups = todo.groupBy(*mark).agg(F.count("*").alias("group_size"), F.max(F.struct("id_key", "row_id", "text_sha256")).alias("top"))
        # stored, so that the join is between two plain shuffles and a large group may be split
        rows = todo.join(cut_lineage(groups.select(*mark, "group_size", "top")), mark)
        alone = rows.filter("group_size = 1").withColumn("same", F.lit(True))
        members = rows.filter("group_size > 1")
        # the texts of the members, once per id and fingerprint
        # (which one id and digest determine; the shuffle is by those, so a large group is spread)
        wanted = members.groupBy("id_key", "text_sha256").agg(*[F.any_value(c).alias(c) for c in (*mark, "top", "group_size")])
        # by digest, so each text meets its own group's row only, whatever shares its id
        texts = docs.select("doc_id", "text", key.alias("id_key"), F.sha2(ascii_lower("text"), 256).alias("text_sha256"))
        found = texts.join(wanted, ["id_key", "text_sha256"]).withColumn("n_buckets", F.ceil(F.col("group_size") / BUCKET).cast("int"))
        is_top = (F.col("id_key") == F.col("top.id_key")) & (F.col("text_sha256") == F.col("top.text_sha256"))
        bucket = F.pmod(F.xxhash64("id_key", "text_sha256"), F.col("n_buckets")).cast("int")
        copies = F.when(is_top, F.concat(F.array(F.struct(bucket.alias("b"), F.lit(False).alias("f"))), F.transform(F.sequence(F.lit(0), F.col("n_buckets") - 1), lambda b: F.struct(b.alias("b"), F.lit(True).alias("f"))))).otherwise(
            F.array(F.struct(bucket.alias("b"), F.lit(False).alias("f")))
        )
        dealt = found.select("doc_id", "text", "text_sha256", *mark, F.explode(copies).alias("c")).select(
            "doc_id", "text", "text_sha256", F.col("c.f").alias("is_sample"), F.concat_ws(":", *mark, "c.b").alias("bucket_key")
        )
        compared = (
            dealt.repartition("bucket_key").sortWithinPartitions("bucket_key", F.desc("is_sample"))
            .mapInArrow(_compare, "doc_id long, text_sha256 string, same boolean")
            .groupBy(key.alias("id_key"), "text_sha256").agg(F.max("same").alias("same"))
        )
        checked = cut_lineage(members.join(compared, ["id_key", "text_sha256"], "left").withColumn("same", F.coalesce("same", F.lit(False))))
        proved = alone.unionByName(checked.filter("same"))
        done = proved if done is None else done.unionByName(proved)
        differ = checked.filter("NOT same").select(*prints.columns)
        if differ.isEmpty():
            break
        todo, collided = cut_lineage(differ), True
    if collided:  # the sizes so far counted rows that differ
        sizes = done.groupBy("top").agg(F.count("*").alias("group_size"))
        done = done.drop("group_size").join(sizes, "top")
    return done.select(
        "doc_id", F.when(F.col("top.id_key") != LOWEST, F.col("top.id_key")).alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("row_id") == F.col("top.row_id")).alias("kept"), "text_sha256",
    )
