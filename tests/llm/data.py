"""Dirty rows for every operator, and brute-force helpers."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h1 string, fp string, row_id int, kept string, word string"


def dirty(spark, seed: int = 7):
    """Nulls, empty and very long texts, ties, repeated rows, clashing columns."""
    r = random.Random(seed)
    words = "the of and to in storm river glass paper stone light über élan niño Straße".split()
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    long = prose(30_000)
    texts = [
        None, "", "   \n\t ", "a", "A", "Same Text here now", "same text HERE now", "same text here now", prose(60), long, long + " end",
        "x" * 100_000, "É é", "é É", "line one\nline two\nline one", "<|endoftext|> tail<|im_end|>", "123 456 !!! ###", "日本語 テキスト", prose(700),
    ]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 5 == 0 else f"src{i % 3}", len(t or ""), "x", "y", 1, "z", None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "same text here now", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
