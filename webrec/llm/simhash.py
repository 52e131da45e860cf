"""SimHash near-duplicates over a byte-position inverted index with count
filtering.

A fingerprint has 8 bytes. Two fingerprints that differ in at most 4 bits
differ in at most 4 bytes, so they share at least 4 positional bytes: the
guaranteed minimum. Postings of single bytes would hold 1/256 of all
fingerprints each and their pairs grow with the square of the table, so the
index posts *triples* of positional bytes, 24 bits each. Twenty of the 56
triples are enough: any 4 of 8 positions contain one of them (Turan's
construction, ``triples``). Pairs that meet in a posting have their shared
positional bytes tallied; those below the minimum go, the rest is verified by
counting differing bits.

Equal fingerprints are one entry, so groups of copies are no hot postings.
Within a posting only the links of a spanning forest leave the task. Postings
of more than ``POSTING`` entries are not paired at all: all their entries go
through an exact way that is linear in their number. Two fingerprints within 4
bits have a word within 2 bits of both, so each entry is linked with the least
entry around each of its 2,081 words of that kind. That keeps every link's
component, and adds none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrec.llm.base import cut_lineage, id_text, map_slices, raw
from webrec.llm.components import components

WIDTH = 4
MAX_BITS = 4
SEED = 42
POSTING = 4096
#: Shingles whose bits are counted at once; bounds the memory of a long text.
BLOCK = 1 << 14


def shingles(text: bytes, width: int) -> list[bytes]:
    """Word shingles of a text lower-cased in A-Z; ``bytes.split`` parts at
    just the characters \\x20 and \\x09-\\x0D."""
    words = text.lower().split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(width)))))


def simhash(parts: list[bytes], seed: int = SEED) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(parts), BLOCK):
        h = np.array([xxhash.xxh64_intdigest(p, seed) for p in parts[at : at + BLOCK]], ">u8")
        counts += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(parts)).view(">i8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """``doc_id, fp long`` per row of ``doc_id, text``; other columns, all of
    type long, stay."""
    others = [c for c in docs.columns if c != "text"]

    def make():
        def work(batch):
            fps = [simhash(shingles(t, width), seed) for t in raw(batch, "text")]
            return pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(fps, pa.int64())], [*others, "fp"])

        return work

    return map_slices(docs, make, ", ".join(f"{c} long" for c in [*others, "fp"]))


def triples() -> list[tuple[int, int, int]]:
    """20 triples of byte positions so that any 4 positions contain one: the
    positions in three parts; three of one part, or two of one and one of the
    next."""
    part = [0, 0, 0, 1, 1, 1, 2, 2]
    good = ([3, 0, 0], [2, 1, 0], [0, 2, 1], [1, 0, 2], [0, 3, 0], [0, 0, 3])
    return [t for t in combinations(range(8), 3) if [sum(part[p] == k for p in t) for k in range(3)] in [list(g) for g in good]]


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """Tally of the positional bytes that two fingerprints share, from their xor."""
    return (x.view(np.uint8).reshape(-1, 8) == 0).sum(1)


def _links_of(fps: np.ndarray, runs: np.ndarray, max_bits: int, posting: int) -> tuple[list, list, list]:
    """Links within runs of equal posting (``runs``: its start for each
    entry), as a forest, and the entries of postings too long to pair."""
    order = np.arange(len(fps))
    size = np.bincount(runs, minlength=len(fps))[runs]
    long = size > posting
    root = {}

    def find(i):
        while (p := root.get(i, i)) != i:
            root[i] = root.get(p, p)
            i = p
        return i

    a, b, lag = [], [], 0
    live = order[~long]
    while True:
        lag += 1
        live = live[(live + lag < len(fps))]
        live = live[runs[np.minimum(live + lag, len(fps) - 1)] == runs[live]]
        if not len(live):
            break
        x = fps[live] ^ fps[live + lag]
        met = live[shared_bytes(x) >= 8 - max_bits]
        met = met[np.bitwise_count((fps[met] ^ fps[met + lag]).view(np.uint64)) <= max_bits]
        for i in met.tolist():
            p, q = find(i), find(i + lag)
            if p != q:
                root[max(p, q)] = min(p, q)
                a.append(int(fps[i]))
                b.append(int(fps[i + lag]))
    return a, b, fps[long].tolist()


def _pair(max_bits: int, posting: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, over = np.empty(0, np.int32), np.empty(0, np.int64), None

        def out(k, f):
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            runs = np.repeat(starts, np.diff(np.r_[starts, len(k)]))
            a, b, rest = _links_of(f, runs, max_bits, posting)
            return pa.RecordBatch.from_arrays([pa.array(a + rest, pa.int64()), pa.array(b + [None] * len(rest), pa.int64())], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, batch.column("posting").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy()])
            if over is not None:  # the rest of a posting that was too long
                n = int(np.searchsorted(keys, over, side="right"))
                yield pa.RecordBatch.from_arrays([pa.array(fps[:n], pa.int64()), pa.nulls(n, pa.int64())], ["a", "b"])
                keys, fps = keys[n:], fps[n:]
                if not len(keys):
                    continue
                over = None
            last = int(np.flatnonzero(keys == keys[-1])[0])  # may go on in the next batch
            if last:
                yield out(keys[:last], fps[:last])
                keys, fps = keys[last:], fps[last:]
            if len(keys) > posting:
                over = keys[-1]
                yield out(keys, fps)
                keys, fps = keys[:0], fps[:0]
        if len(keys):
            yield out(keys, fps)

    return run


def balls(entries: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links of entries ``a`` within ``max_bits`` through shared words half
    way; linear in the number of entries."""
    masks = [0] + [1 << i for i in range(64)] if max_bits >= 2 else [0]
    if max_bits >= 4:
        masks += [(1 << i) | (1 << j) for i, j in combinations(range(64), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    words = entries.select(F.col("a"), F.explode(F.transform(F.array(*map(F.lit, signed)), lambda m: F.col("a").bitwiseXOR(m))).alias("word"))
    least = words.groupBy("word").agg(F.min("a").alias("b"), F.max("a").alias("top")).filter("b < top").select("word", "b")
    return words.join(least, "word").filter("a <> b").select("a", "b").distinct()


def links(fps: DataFrame, max_bits: int = MAX_BITS, posting: int = POSTING) -> DataFrame:
    """``a, b``: links between different fingerprints of ``fp`` (distinct)
    that differ in at most ``max_bits`` bits: not all of them, but enough for
    the same components."""
    if max_bits not in (2, 4):
        raise ValueError("the index guarantees its triples for at most 4 bits; half of max_bits must be whole")
    byte = [F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(255) for p in range(8)]
    keys = F.array(*[
        (F.lit(n << 24) + F.shiftleft(byte[p], 16) + F.shiftleft(byte[q], 8) + byte[r]).cast("int") for n, (p, q, r) in enumerate(triples())
    ])
    posted = fps.select("fp", F.explode(keys).alias("posting"))
    met = cut_lineage(posted.repartition("posting").sortWithinPartitions("posting", "fp").mapInArrow(_pair(max_bits, posting), "a long, b long"))
    found = met.filter("b IS NOT NULL").distinct()
    long = met.filter("b IS NULL").select("a").distinct()
    return found if long.isEmpty() else found.unionByName(balls(long, max_bits)).distinct()


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS, seed: int = SEED, posting: int = POSTING, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row: ``doc_id, fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links.

    A null text is empty; a text without words has fingerprint zero, linked
    like any other. Repeated rows stay. Null ids take part but are no
    component's id unless it has no other. Other columns are not read."""
    prints = cut_lineage(fingerprints(id_text(docs, id_col, text_col), width, seed))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(links(distinct.select("fp"), max_bits, posting))
    # only fingerprints with links have a root; their least ids, per component
    linked = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "least")
    owner = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = linked.select("fp", "root").join(owner, "root").select("fp", "component_id")
    whole = distinct.join(of_fp, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    # stored, so that the join is between two plain shuffles and a large group of copies may be split
    return prints.join(cut_lineage(whole), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_copies(docs: DataFrame, keys: list[str], width: int = WIDTH, max_bits: int = MAX_BITS, seed: int = SEED, posting: int = POSTING) -> DataFrame:
    """One row per row of ``docs`` (``doc_id, text`` without nulls, and
    ``keys``, longs that tell its rows apart): ``keys`` and ``top``, whether the
    row is the one of its component that stays: of the smallest id, null ids
    last, then of the least keys. Rows equal in id and keys are all top or none."""
    prints = cut_lineage(fingerprints(docs, width, seed))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", *keys)
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min(rank).alias("best")))
    roots = components(links(distinct.select("fp"), max_bits, posting))
    linked = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "best")
    owner = linked.groupBy("root").agg(F.min("best").alias("owner"))
    of_fp = linked.select("fp", "root").join(owner, "root").select("fp", "owner")
    whole = distinct.join(of_fp, "fp", "left").select("fp", F.coalesce("owner", "best").alias("best"))
    return prints.join(cut_lineage(whole), "fp").select(*keys, (rank == F.col("best")).alias("top"))
