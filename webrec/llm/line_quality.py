"""Quality rules with cross-document line frequency, in Spark's own functions.

Base rules look at one text: its words (``[^\\x20\\x09-\\x0D]+``), symbols,
repeated lines and repeated three-word windows. The method looks across texts:
lines are normalised and hashed, the distinct documents of each line are
counted per host, lines on more than ``max_docs`` documents of a host are
removed, and a document that keeps less than ``min_left`` of its words is
rejected as depleted.

Counts are pre-aggregated before the shuffle, one row per line and document,
so a line or host with a third of all rows is no large task; what joins back
are frequent lines only, one row each, and the adaptive planner may split the
other side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrec.llm.base import by_word

BLANK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_DOCS = 50
MIN_LEFT = 0.5


def _repeated_words(df: DataFrame) -> DataFrame:
    """``n_repeat_words``: words in three-word windows that occur twice or
    more. Windows are compared by a 64-bit hash over the three words; only
    texts that do repeat one sort theirs."""
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(F.sequence(F.lit(0), F.col("n_words") - 3), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(3)])),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("windows", windows)
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(repeats, placed))

    def twin(p: Column, k: Column) -> Column:
        near = [F.coalesce(F.get("placed", k + d)["h"] == p["h"], F.lit(False)) for d in (-1, 1)]
        return F.when(near[0] | near[1], F.array(p["i"], p["i"] + 1, p["i"] + 2)).otherwise(F.array().cast("array<int>"))

    covered = F.array_distinct(F.flatten(F.transform("placed", twin)))
    return df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("placed").isNotNull(), F.size(covered)), F.lit(0)))


def base_rules(docs: DataFrame, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """``doc_id, text_key, host, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed`` of ``doc_id, host, text``."""
    df = docs.withColumn("words", by_word(F.col("text"))).withColumn("n_words", F.size("words"))
    df = df.withColumn("worded", F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = _repeated_words(df)
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * F.lit(100).cast("long") > F.col("n_words") * F.lit(max_repeat_percent).cast("long"))
    return df.select(
        "doc_id", "text_key", "host", F.col("n_words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"), failed.alias("base_failed"),
    )


def normal_line(line: Column) -> Column:
    """Lower case, one space between words, none outside."""
    return F.trim(F.lower(F.regexp_replace(line, BLANK, " ")))


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per document and distinct line: its hash and the words that
    the document has in it."""
    lines = docs.select("doc_id", "text_key", "host", F.explode(F.split("text", "\n")).alias("line")).select(
        "doc_id", "text_key", "host", normal_line(F.col("line")).alias("line")
    ).filter("line <> ''")
    # words of a normalised line: its single spaces and one
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return lines.select("doc_id", "text_key", F.xxhash64("host", "line").alias("line_key"), n.alias("n")).groupBy(
        "doc_id", "text_key", "line_key"
    ).agg(F.sum("n").alias("n"))


def line_quality(
    docs: DataFrame, max_docs: int = MAX_DOCS, min_left: float = MIN_LEFT, min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT,
    id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
) -> DataFrame:
    """One row per row: ``doc_id``, the base counts, ``base_failed``,
    ``kept``, and ``n_removed_words``, the words in lines above the limit.

    A null text has no words and fails; rows without a host count as one host;
    rows repeated with one id and text are one document in the line counts and
    stay in the result. Other columns are not read."""
    docs = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
    ).withColumn("text_key", F.xxhash64("text", "host"))
    rows = line_rows(docs)
    # counts a column that the join needs too, so both read one shuffle
    frequent = rows.groupBy("line_key").agg(F.count("n").alias("n_docs")).filter(F.col("n_docs") > max_docs).select("line_key")
    removed = rows.join(frequent, "line_key").groupBy("doc_id", "text_key").agg(F.sum("n").alias("n_removed_words"))
    base = base_rules(docs, min_words, max_repeat_percent)
    both = base.join(
        removed.withColumnsRenamed({"doc_id": "of_id", "text_key": "of_text"}),
        F.expr("doc_id <=> of_id AND text_key = of_text"), "left",
    )
    gone = F.coalesce("n_removed_words", F.lit(0)).cast("long")
    depleted = (F.col("n_words") - gone) < F.col("n_words") * F.lit(min_left)
    return both.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"), gone.alias("n_removed_words"),
    )
