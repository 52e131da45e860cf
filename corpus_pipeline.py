"""Documents to training sequences: five stages, each a table for the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame that is written as Parquet and read as the next one's
``docs``. All but the last return the columns of ``documents``.

Rows with nulls anywhere, repeated rows and empty tables pass through every
stage; columns of the input beyond those of ``documents`` are dropped.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webrec.llm import exact, langid, packing, secrets, simhash
from webrec.llm.base import map_slices, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _documents(docs: DataFrame) -> DataFrame:
    kinds = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}
    return docs.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter and texts between two languages go; ``lang``
    becomes the language found."""
    docs = _documents(docs)
    model = langid.fit(docs)

    def make():
        tag = langid.tagger(model)

        def work(batch):
            names, _, unsure = tag(batch.column("text").to_pylist())
            keep = pa.array([n != langid.UNKNOWN and not u for n, u in zip(names, unsure)])
            at = batch.schema.get_field_index("lang")
            return batch.set_column(at, "lang", pa.array(names, pa.string())).filter(keep)

        return work

    return map_slices(docs, make, SCHEMA)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, and of repeated rows, one stays."""
    docs = _documents(docs)
    out = exact.exact_duplicates(docs)
    # a kept row is the only one of its id and text, but where rows repeat
    kept = stored(out.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("copies")).filter("kept"))
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    kept = kept.select(F.col("doc_id").alias("kept_id"), "text_sha256", "copies")
    rows = docs.withColumn("text_sha256", sha).join(kept.withColumnRenamed("text_sha256", "kept_sha"), F.expr("doc_id <=> kept_id AND text_sha256 = kept_sha"))
    if kept.filter("copies > 1").isEmpty():  # no row is repeated under one id and text
        return rows.select(*COLUMNS)
    one = F.min(F.struct(*COLUMNS[1:])).alias("row")
    return rows.groupBy("doc_id", "text_sha256").agg(one).select("doc_id", "row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, of the smallest id; ids
    that are null come last. Rows count one by one, also where ids repeat."""
    docs = _documents(docs)
    text = F.coalesce("text", F.lit("")).alias("text")
    # 128 bits of id and text; a null id adds nothing to a hash
    has_id = F.col("doc_id").isNotNull()
    keys = {"key_a": F.xxhash64(has_id, "doc_id", text), "key_b": F.xxhash64(F.lit("b"), has_id, "doc_id", text)}
    out = stored(simhash.near_copies(docs.select("doc_id", text, *[k.alias(c) for c, k in keys.items()]), [*keys]))
    gone = out.filter("NOT top").select(*keys).distinct()
    docs = docs.withColumns(keys)
    # rows of one id and text, where that is what stays
    again = out.filter("top").groupBy(*keys).count().filter("count > 1").select(*keys)
    rows = docs.join(gone, [*keys], "left_anti")
    if again.isEmpty():
        return rows.select(*COLUMNS)
    one = docs.join(again, [*keys], "left_semi").groupBy(*keys).agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return rows.join(again, [*keys], "left_anti").select(*COLUMNS).unionByName(one.select("row.*"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by ``[SECRET]``; no document goes."""
    docs = _documents(docs)
    field = secrets.fit(docs)

    def make():
        tagger = secrets.Tagger(field)

        def work(batch):
            texts, sizes = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
            for k, t in enumerate(texts):
                if t and (spans := secrets.all_spans(t, tagger)[1]):
                    texts[k] = secrets.masked(t, spans)
                    sizes[k] = len(texts[k])
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(sizes, pa.int64())}
            return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in COLUMNS], COLUMNS)

        return work

    return map_slices(docs, make, SCHEMA)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mask_secrets", mask_secrets), ("pack", pack)]

#: SQL cannot express language ID, fingerprints, tagging or tokenizing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is stored and read."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
