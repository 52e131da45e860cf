"""Phrase collocations by Rabin-Karp fingerprints.

Every n-gram gets a 64-bit fingerprint from prefix polynomials in numpy: one
over the bytes of a block gives the words', one over the words' values gives
all n-grams', each by one subtraction. The texts are read in turn to

1. count fingerprints, of words and pairs, then of n-grams whose two parts one
   word shorter may be frequent. A bitmap of fixed size marks where a frequent
   one stands (``SLOT_BITS``): it may mark too many, never too few.
2. count those marked again with a second polynomial, modulo a prime, as check,
   and with pointers (hash of language and text, byte offset) to their first
   and last occurrence in hash order. Both polynomials and the number of words
   are the key, so a collision of fingerprints counts apart. A task adds up what
   it reads before it sends it on.
3. materialise the frequent ones: pointers meet the texts, both occurrences are
   read, hashed again and compared. Two texts under one pointer are told apart
   by this; two phrases under one key fail the job (another seed parts them),
   they never add up.

What follows joins frequent phrases only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrec.llm.base import map_slices, raw, stored

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
SEED = 42
UNKNOWN = "und"
#: In place of the check, for the phrase of no words.
WHOLE = -1
#: The bitmap has two to this power bits: 8 MB, however many phrases there are.
SLOT_BITS = 26
#: Bits of the fingerprints that are counted for it; sums of several only mark
#: more. The first of them are a bucket, the unit that is shuffled; the other 32
#: travel as arrays of integers, several times shorter than rows of their own.
BUCKET_BITS = 12
COUNTED_BITS = BUCKET_BITS + 32
#: Distinct counted fingerprints that a task holds before they go on.
PACKED = 1 << 20
#: The same of fingerprints with pointers, of 40 bytes: with fewer, a task would
#: send on the same ones several times.
POINTS = 1 << 21
#: What a task holds lies apart by so many first bits of the fingerprints and is
#: sorted and added up one such part at a time, so that only a part is copied.
PART_BITS = 4
#: Bits of a text's pointer, an integer; texts that share one are all read.
KEY_BITS = 32
#: Bytes hashed at once, and n-grams held before they are counted and go on.
BLOCK = 1 << 16
HELD = 1 << 17

PRIME = np.int64((1 << 31) - 1)
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
KIND = np.zeros(256, np.uint8)
KIND[list(SPACES)] = 1
KIND[list(BREAKS)] = 2
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
WORD = rb"[^ \t.,;:!?\n\x0b\x0c\r]+"
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _modulo(x: np.ndarray) -> np.ndarray:
    """Below 2**32, equal to x modulo the prime, for x below 2**63."""
    return (x & PRIME) + (x >> np.int64(31))


class Polynomials:
    """Fingerprint and check of n-grams. ``bits`` shortens the fingerprints,
    so that tests can make them collide."""

    def __init__(self, seed: int = SEED, bits: int = 64):
        rng = np.random.default_rng(seed)
        self.letter = rng.integers(0, 2**64, 256, dtype=U, endpoint=False)
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self.letter_check = rng.integers(1, PRIME, 256)
        self.base_check = int(rng.integers(2**20, PRIME))
        self.drop = U(64 - bits)
        self.size = 0
        self._reach(1 << 16)

    def _reach(self, n: int) -> None:
        if n <= self.size:
            return
        self.size = n = max(n, 2 * self.size)

        def powers(base: int, modulus: int, kind) -> np.ndarray:
            out, filled, step = np.ones(n, kind), 1, base
            while filled < n:  # doubles what is there
                more = min(filled, n - filled)
                out[filled : filled + more] = out[:more] * kind(step) if modulus == 1 << 64 else out[:more] * kind(step) % kind(modulus)
                filled, step = filled + more, step * step % modulus
            return out

        p = int(PRIME)
        self.power, self.inverse = powers(self.base, 1 << 64, U), powers(pow(self.base, -1, 1 << 64), 1 << 64, U)
        self.power_check, self.inverse_check = powers(self.base_check, p, np.int64), powers(pow(self.base_check, -1, p), p, np.int64)

    def words(self, block: np.ndarray):
        """Starts, ends and piece numbers of the words of lower-cased bytes."""
        kind = KIND[block]
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (kind == 0).view(np.int8), [0]]).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        return starts, ends, np.searchsorted(np.flatnonzero(kind == 2), starts)

    def _prefix(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, U), np.cumsum(values * self.power[: len(values)])])

    def _prefix_check(self, values: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.int64), np.cumsum(_modulo(values * self.power_check[: len(values)]))])

    def values(self, block: np.ndarray, starts: np.ndarray, ends: np.ndarray, check: bool):
        """Prefix polynomials over the words of a block."""
        self._reach(len(block) + 1)
        s = self._prefix(self.letter[block])
        out = [self._prefix(_mix((s[ends] - s[starts]) * self.inverse[starts] + (ends - starts).astype(U)))]
        if check:
            s = self._prefix_check(self.letter_check[block])
            out.append(self._prefix_check((s[ends] - s[starts]) % PRIME * self.inverse_check[starts] % PRIME + 1))
        return out

    def grams(self, prefixes: list[np.ndarray], n: int, at: np.ndarray, salt: np.ndarray) -> list[np.ndarray]:
        """Fingerprint, and check where its prefix is given, of the n words from ``at`` on."""
        q = prefixes[0]
        out = [_mix((q[at + n] - q[at]) * self.inverse[at] ^ salt + U(n)) >> self.drop]
        out[0] = out[0] << self.drop
        if len(prefixes) > 1:
            q = prefixes[1]
            out.append((q[at + n] - q[at]) % PRIME * self.inverse_check[at] % PRIME)
        return out


def _blocks(texts: list[bytes], max_words: int) -> Iterator[tuple[bytes, list[int], list[int], int]]:
    """Bytes to hash at once; the texts in them, where each begins, and from
    where words are new. Short texts are put together; a long one is cut
    between words, each part with the words before it that an n-gram may need."""
    held, which, begins, size = [], [], [], 0
    for k, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield b"\n".join(held), which, begins, 0
            held, which, begins, size = [], [], [], 0
        if len(text) <= BLOCK:
            held.append(text)
            which.append(k)
            begins.append(size)
            size += len(text) + 1
            continue
        at = new = 0
        while new < len(text):
            cut = new + BLOCK
            if cut < len(text) and (end := re.compile(rb"[ \t.,;:!?\n\x0b\x0c\r]").search(text, cut)):
                cut = end.start()
            else:
                cut = len(text)
            yield text[at:cut], [k], [-at], new - at
            new, at = cut, cut
            for _ in range(max_words - 1):  # back over the words before
                at = _word_before(text, at)
    if held:
        yield b"\n".join(held), which, begins, 0


def _word_before(text: bytes, at: int) -> int:
    """Start of the last word that ends before ``at``."""
    while at and KIND[text[at - 1]]:
        at -= 1
    while at and not KIND[text[at - 1]]:
        at -= 1
    return at


def _grams(poly: Polynomials, texts: list[bytes], salts: np.ndarray, widths: list[int], max_words: int, check: bool):
    """Per block, and how many words it has; by n, for every n-gram: its first
    word, whether its last word is new in this block, text number, offset in
    the text, fingerprint, and check."""
    for block, which, begins, new in _blocks(texts, max_words):
        b = np.frombuffer(block.translate(LOWER), np.uint8)
        starts, ends, piece = poly.words(b)
        if not len(starts):
            continue
        prefixes = poly.values(b, starts, ends, check)
        nth = np.searchsorted(begins, starts, side="right") - 1 if len(begins) > 1 else np.zeros(len(starts), np.int64)
        text, offset = np.asarray(which)[nth], starts - np.asarray(begins)[nth]
        found = {}
        for n in widths:
            first, last = np.arange(max(len(starts) - n + 1, 0)), np.arange(n - 1, max(len(starts), n - 1))
            at = first[piece[first] == piece[last]]
            found[n] = (at, starts[at + n - 1] >= new, text[at], offset[at], *poly.grams(prefixes, n, at, salts[text[at]]))
        yield found, len(starts)


class Marks:
    """Bitmap of fingerprints by their first bits."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.shift = words, U(64 - bits)

    def has(self, fp: np.ndarray) -> np.ndarray:
        slot = fp >> self.shift
        return (self.words[(slot >> U(6)).astype(np.int64)] >> (slot & U(63)) & U(1)).astype(bool)


def _counted(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints and how often each occurs."""
    if not len(fp):
        return fp, np.empty(0, np.int64)
    fp = np.sort(fp)
    first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
    return fp[first], np.diff(np.append(first, len(fp)))


def _summed(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One run of distinct fingerprints, sorted, with the sums of their counts."""
    fp, count = (np.concatenate(x) for x in zip(*runs))
    order = np.argsort(fp, kind="stable")
    fp, count = fp[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]]))
    return fp[first], np.add.reduceat(count, first)


def _pointed(runs: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One run of distinct (fingerprint, tag), sorted, with the sums of their
    counts, the first pointer (text, offset) and the last."""
    fp, tag, n, key_0, at_0, key_1, at_1 = (np.concatenate(x) for x in zip(*runs))
    if not len(fp):
        return [fp, tag, n, key_0, at_0, key_1, at_1]
    order = np.argsort(fp, kind="stable")
    f, t = fp[order], tag[order]
    if np.any((f[1:] == f[:-1]) & (t[1:] != t[:-1])):  # fingerprints collide
        order = np.lexsort((tag, fp))
        f, t = fp[order], tag[order]
    new = np.concatenate([[True], (f[1:] != f[:-1]) | (t[1:] != t[:-1])])
    first, group = np.flatnonzero(new), np.cumsum(new) - 1
    out = [f[first], t[first], np.add.reduceat(n[order], first)]
    for key, at, least in ((key_0[order], at_0[order], np.minimum), (key_1[order], at_1[order], np.maximum)):
        best = least.reduceat(key, first)
        hit = np.flatnonzero(key == best[group])
        # of several in that text, the one that stands first
        out += [best, at[hit[np.concatenate([[True], group[hit[1:]] != group[hit[:-1]]])]]]
    return out


class Runs:
    """Runs of fingerprints of so many bits, sorted, and what goes with them;
    ``add_up`` makes one run of several."""

    def __init__(self, add_up, bits: int):
        self.add_up, self.parts = add_up, [[] for _ in range(1 << PART_BITS)]
        self.edges = np.arange(1, 1 << PART_BITS, dtype=U) << U(bits - PART_BITS)

    def __len__(self) -> int:
        return sum(len(run[0]) for runs in self.parts for run in runs)

    def add(self, run) -> None:
        cuts = [0, *np.searchsorted(run[0], self.edges).tolist(), len(run[0])]
        for runs, start, end in zip(self.parts, cuts, cuts[1:]):
            if start < end:
                runs.append([x[start:end].copy() for x in run])  # a view would hold the whole run

    def flush(self, least: int):
        """The sums, a run for each part, where they have so many fingerprints; else they stay."""
        for runs in self.parts:
            if len(runs) > 1:
                runs[:] = [self.add_up(runs)]
        if len(self) >= least:
            for runs in self.parts:
                if runs:
                    yield runs.pop()


def _packed(bucket: np.ndarray, cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    """One row per bucket, with the columns as arrays; sorted by bucket."""
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    cuts = pa.array(np.append(first, len(bucket)), pa.int32())
    arrays = [pa.array(bucket[first], pa.int32()), *(pa.ListArray.from_arrays(cuts, pa.array(c)) for c in cols.values())]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *cols])


def _fingerprints(poly_of, max_words: int, n: int, marks_of):
    """(first bits of the fingerprint, count) of words and pairs, or of n-grams
    that the marks of their parts leave."""
    widths = [k for k in (1, 2) if k <= max_words] if n == 2 else [n - 1, n]

    def make():
        poly, marks, held, runs = poly_of(), marks_of() if n > 2 else None, [], Runs(_summed, COUNTED_BITS)

        def count():
            runs.add(_counted(np.concatenate(held) >> U(64 - COUNTED_BITS)))
            held.clear()

        def flush(least: int):
            for fp, times in runs.flush(least):
                yield _packed((fp >> U(32)).astype(np.int32), {"low": fp.astype(np.uint32).view(np.int32), "n": times})

        def work(batch):
            salts = batch.column("salt").to_numpy().view(U)
            for found, n_words in _grams(poly, raw(batch, "text"), salts, widths, max_words, False):
                if n == 2:
                    held.extend(fp[new] for _, new, _, _, fp in found.values())
                else:
                    may = np.zeros(n_words + 1, bool)
                    may[found[n - 1][0]] = marks.has(found[n - 1][4])
                    at, new, _, _, fp = found[n]
                    held.append(fp[new & may[at] & may[at + 1]])
                if sum(map(len, held)) >= HELD:
                    count()
                    if len(runs) >= PACKED:
                        yield from flush(PACKED // 2)

        def end():
            if held:
                count()
            if runs:
                yield from flush(1)

        return work, end

    return make


#: What travels of each fingerprint that is marked, by bucket.
POINTED = {"fp": "long", "checked": "int", "words": "smallint", "n": "long", "key_0": "int", "at_0": "int", "key_1": "int", "at_1": "int"}


def _pointers(poly_of, max_words: int, marks_of):
    """Counts, checks and pointers of what is marked."""

    def make():
        poly, marks, held, runs, total = poly_of(), marks_of(), [], Runs(_pointed, 64), {}

        def count():
            fp, tag, key, at = (np.concatenate(x) for x in zip(*held))
            held.clear()
            runs.add(_pointed([[fp, tag, np.ones(len(fp), np.int64), key, at, key, at]]))

        def pack(fp, tag, n, *pointers):
            check, words = np.divmod(tag, max_words + 1)
            cols = [fp.view(np.int64), check.astype(np.int32), words.astype(np.int16), n, *(p.astype(np.int32) for p in pointers)]
            return _packed((fp >> U(64 - BUCKET_BITS)).astype(np.int32), dict(zip(POINTED, cols)))

        def flush(least: int):
            for run in runs.flush(least):
                yield pack(*run)

        def work(batch):
            salts, keys = batch.column("salt").to_numpy(), batch.column("text_key").to_numpy()
            for found, _ in _grams(poly, raw(batch, "text"), salts.view(U), list(range(1, max_words + 1)), max_words, True):
                for n, (_, new, text, offset, fp, check) in found.items():
                    if n == 1:
                        size = np.bincount(text[new], minlength=len(keys))
                        for k in np.flatnonzero(size).tolist():
                            words, key = total.get(salts[k], (0, 0))
                            total[salts[k]] = words + int(size[k]), int(keys[k])
                    good = new & marks.has(fp)
                    held.append((fp[good], check[good] * (max_words + 1) + n, keys[text[good]], offset[good].astype(np.int32)))
                if sum(len(x[0]) for x in held) >= HELD:
                    count()
                    if len(runs) >= POINTS:
                        yield from flush(POINTS * 3 // 4)

        def end():
            if held:
                count()
            if runs:
                yield from flush(1)
            if total:
                # all words of a language: the count of the phrase of no words
                fp = np.sort(np.array([*total], np.int64).view(U))
                words, key = (np.array([total[s][k] for s in fp.view(np.int64)], np.int64) for k in (0, 1))
                yield pack(fp, np.full(len(fp), WHOLE * (max_words + 1)), words, key, 0 * key, key, 0 * key)

        return work, end

    return make


def _stream(df: DataFrame, make, schema: str) -> DataFrame:
    """``make()`` once per task gives a generator function over slices, and
    another for what is held at the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, end = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                yield from work(batch.slice(at, 512))
            batch = None  # freed before the next one is read
        yield from end()

    return df.mapInArrow(run, schema)


def _materialise(rows: DataFrame, poly_of, max_words: int) -> DataFrame:
    """Phrases at the pointers of each text, where they hash to their key."""

    def make():
        poly, patterns = poly_of(), {}

        def work(batch):
            out = {c: [] for c in ("lang", "words", "fp", "checked", "n", "salt")}
            lines = []
            for lang, salt, text, pointers in zip(*(batch.column(c).to_pylist() for c in ("lang", "salt")), raw(batch, "text"), batch.column("pointers").to_pylist()):
                text = text.translate(LOWER)
                for p in pointers:
                    at, n = p["at"], p["words"]
                    if n not in patterns:
                        patterns[n] = re.compile(WORD + rb"(?:[ \t]+" + WORD + rb"){%d}" % (n - 1) if n else b"")
                    if hit := patterns[n].match(text, at):
                        lines.append(b" ".join(re.findall(WORD, hit[0])))
                        for c, v in zip(out, (lang, n, p["fp"], p["checked"], p["n"], salt)):
                            out[c].append(v)
            if not lines:
                return None
            b = np.frombuffer(b"\n".join(lines), np.uint8)
            starts, ends, _ = poly.words(b)
            prefixes = poly.values(b, starts, ends, True)
            words, fp, checked, salt = np.array(out["words"]), *(np.array(out[c], np.int64) for c in ("fp", "checked", "salt"))
            first, same = np.concatenate([[0], np.cumsum(words)[:-1]]), (checked == WHOLE) & (fp == salt)
            for n in np.unique(words[words > 0]):
                of = np.flatnonzero(words == n)
                f, c = poly.grams(prefixes, int(n), first[of], salt[of].view(U))
                same[of] = (f.view(np.int64) == fp[of]) & (c == checked[of])
            cols = [pa.array(out["lang"], pa.string()), pa.array(words, pa.int32()), *(pa.array(out[c], pa.int64()) for c in ("fp", "checked", "n")), pa.array(lines, pa.binary())]
            cols = [c.filter(pa.array(same)) for c in cols]
            # what another text has there may begin within a character
            return pa.RecordBatch.from_arrays([*cols[:-1], cols[-1].cast(pa.string())], ["lang", "words", "fp", "checked", "n", "phrase"])

        return work

    return map_slices(rows, make, "lang string, words int, fp long, checked long, n long, phrase string")


def _marked(counted: DataFrame, min_count: int, bitmap: np.ndarray, slot_bits: int) -> None:
    """Marks what is frequent; 2 ** (slot_bits - 6) rows at most reach the driver."""
    # a partition has whole buckets, so the sums need no second shuffle
    rows = counted.repartition("bucket").select("bucket", F.inline(F.arrays_zip("low", "n")))
    often = rows.groupBy("bucket", "low").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)
    slot = f"shiftrightunsigned(shiftleft(CAST(bucket AS BIGINT), 32) | (CAST(low AS BIGINT) & 4294967295L), {COUNTED_BITS - slot_bits})"
    words = often.groupBy(F.expr(f"shiftright({slot}, 6)").alias("word")).agg(F.expr(f"bit_or(shiftleft(1L, CAST({slot} & 63 AS INT)))").alias("bit")).toArrow()
    bitmap[words["word"].to_numpy()] |= words["bit"].to_numpy().view(U)


def frequent_phrases(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, seed: int = SEED, bits: int = 64, slot_bits: int = SLOT_BITS,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """``lang, words, phrase, n``: phrases of 1 to ``max_words`` words that
    occur at least ``min_count`` times in texts of a language; the phrase of no
    words has the number of all words. Memory: blocks of ``BLOCK`` bytes, a
    longest word, and the pointers into one text, which are fewer than its words."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang")
    rows = docs.select(lang, text).select("lang", "text", F.xxhash64("lang").alias("salt"), F.shiftright(F.xxhash64("lang", "text"), 64 - KEY_BITS).cast("int").alias("text_key"))

    def poly_of():
        return Polynomials(seed, bits)

    bitmap = np.zeros(1 << (slot_bits - 6), U)
    for n in range(2, max(max_words, 2) + 1):
        shared = spark.sparkContext.broadcast(bitmap)  # of fixed size
        _marked(_stream(rows.select("text", "salt"), _fingerprints(poly_of, max_words, n, lambda s=shared: Marks(s.value, slot_bits)), "bucket int, low array<int>, n array<long>"), min_count, bitmap, slot_bits)
    shared = spark.sparkContext.broadcast(bitmap)
    found = _stream(
        rows.select("text", "salt", "text_key"), _pointers(poly_of, max_words, lambda: Marks(shared.value, slot_bits)),
        ", ".join(["bucket int", *(f"{c} array<{t}>" for c, t in POINTED.items())]),
    ).repartition("bucket").select("bucket", F.inline(F.arrays_zip(*POINTED)))
    # a partition has whole buckets here too
    found = found.groupBy("bucket", "fp", F.col("checked").cast("long").alias("checked"), F.col("words").cast("int").alias("words")).agg(
        F.sum("n").alias("n"),
        F.min("key_0").alias("key_0"), F.min_by("at_0", "key_0").alias("at_0"), F.max("key_1").alias("key_1"), F.max_by("at_1", "key_1").alias("at_1"),
    )
    often = stored(found.drop("bucket").filter((F.col("checked") == WHOLE) | (F.col("n") >= min_count)))
    both = F.array(*[F.struct(F.col(f"key_{k}").alias("text_key"), F.col(f"at_{k}").alias("at")) for k in (0, 1)])
    pointer = F.struct("fp", "checked", "words", "n", "at").alias("pointer")
    wanted = often.select("fp", "checked", "words", "n", F.inline(F.array_distinct(both))).groupBy("text_key").agg(F.collect_list(pointer).alias("pointers"))
    # copies become one before they travel
    once = rows.groupBy("text_key").agg(F.collect_set(F.struct("lang", "salt", "text")).alias("texts"))
    read = _materialise(once.join(wanted, "text_key").select(F.inline("texts"), "pointers"), poly_of, max_words)
    phrases = read.groupBy("fp", "checked", "lang", "words", "n").agg(F.min("phrase").alias("phrase"), F.max("phrase").alias("other"))
    one = F.when(F.col("phrase") == F.col("other"), F.col("phrase")).otherwise(
        F.raise_error(F.format_string("two phrases have one fingerprint and check: %s, %s; pass another seed", "phrase", "other"))
    )
    return stored(phrases.select("lang", "words", one.alias("phrase"), "n"))


def _part(start: Column, size: Column) -> Column:
    return F.array_join(F.slice("word", start, size), " ")


def collocations(
    docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int | None = TOP, absorb_percent: int = 50, seed: int = SEED, bits: int = 64,
    slot_bits: int = SLOT_BITS, text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: phrases of two words and more
    that occur at least ``min_count`` times, by how much oftener than by chance.

    Texts are lower-cased in A-Z and cut at ``.,;:!?`` and line ends; words end
    at spaces and tabs. Of the ways to cut a phrase in two, the one of the least
    ``floor(1000000 a a / (l r))`` counts, of equal ones the earliest cut; ``l``
    and ``r`` are the parts' counts, ``a`` the phrase's. A phrase goes if a
    longer candidate contains it and has ``absorb_percent`` or more of its
    count. Order: score and ``a`` descending, phrase by its bytes; ``top`` per
    language, all where it is None.

    A null text is empty, a null language ``und``; repeated rows count each
    time; an empty table gives no rows; other columns are not read. Products
    are decimals of 38 digits, enough for counts up to 10**15."""
    phrases = frequent_phrases(docs, max_words, min_count, seed, bits, slot_bits, text_col, lang_col)
    totals = phrases.filter("words = 0").select("lang", "n")
    counts = phrases.select("lang", "phrase", "n")
    word = F.split("phrase", " ")
    candidates = phrases.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), word.alias("word"))
    size = F.size("word")
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("left"), _part(F.col("k") + 1, size - F.col("k")).alias("right")
    )
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    score = F.expr("(1000000 * CAST(a AS DECIMAL(15, 0)) * CAST(a AS DECIMAL(15, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(18, 0)))")
    scored = cuts.select("lang", "phrase", "a", F.struct(score.cast("long").alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    # the phrases of two words and more within a longer candidate
    width = F.explode(F.sequence(F.lit(2), size - 1)).alias("width")
    inner = candidates.filter("words > 2").select("word", "lang", "a", width).select(
        "lang", "a", F.explode(F.transform(F.sequence(F.lit(1), size - F.col("width") + 1), lambda s: _part(s, F.col("width")))).alias("phrase")
    )
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("held"))
    left = best.join(held, ["lang", "phrase"], "left").filter(f"held IS NULL OR 100 * held < {int(absorb_percent)} * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
