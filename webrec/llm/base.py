"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrec.session import cut_lineage, scratch

__all__ = ["ascii_lower", "by_word", "cut_lineage", "id_text", "map_slices", "raw", "stored"]

SLICE = 512


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id long, text string`` and nothing else, so no column of the
    caller can clash with an operator's own. A null text is empty."""
    return df.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )


def map_slices(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """Arrow batches through the function that ``make()`` builds once per
    task; it sees at most ``SLICE`` rows at a time, so Python objects exist
    only for those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                out = work(batch.slice(at, SLICE))
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def stored(df: DataFrame, **options: str | int) -> DataFrame:
    """The rows as a table in the shared folder: for wide or many rows, where
    columns compress and later passes read few of them. Deleted at the end of
    the session. Options are those of the Parquet writer."""
    spark = df.sparkSession
    path = scratch(spark, "rows")
    df.write.options(**options).parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.parquet(path)


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8 bytes, without decoding."""
    return batch.column(name).cast(pa.binary()).to_pylist()


def ascii_lower(c: Column | str) -> Column:
    """Lower case in A-Z alone."""
    return F.translate(F.col(c) if isinstance(c, str) else c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_word(c: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")
