"""Writers. The run id is a partition, so a rerun replaces only itself."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrec.functions.common import filled
from webrec.functions.contacts import flatten_record


def sink_records(records: DataFrame, base: str, run_id: str, formats=("parquet", "json", "csv")) -> dict[str, str]:
    """The same rows in each format under ``base/<format>/run_id=<id>``.
    Nested columns become text in CSV."""
    paths = {}
    for f in formats:
        path = f"{base.rstrip('/')}/{f}/run_id={run_id}"
        df = flatten_record(records) if f == "csv" else records
        w = df.write.mode("overwrite")
        (w.option("header", True).option("escape", '"').csv(path) if f == "csv" else w.format(f).save(path))
        paths[f] = path
    return paths


def sink_report_sheets(sheets: Mapping[str, DataFrame], base: str, fmt: str = "parquet") -> dict[str, str]:
    """One named output per analysis."""
    paths = {}
    for name, df in sheets.items():
        paths[name] = f"{base.rstrip('/')}/{name}"
        df.write.mode("overwrite").format(fmt).save(paths[name])
    return paths


def category_rows(articles: DataFrame, categories: str = "categories_list") -> DataFrame:
    """An article once under each of its categories, or ``uncategorized``."""
    cats = F.when(filled(categories), F.array_distinct(F.transform(F.split(categories, ","), lambda x: F.trim(x)))).otherwise(F.array(F.lit("uncategorized")))
    return articles.select("*", F.explode(cats).alias("category"))


def sink_category_partition(articles: DataFrame, path: str) -> str:
    """Partitioned by category. The rebalance hint lets the adaptive planner
    split a busy category over many writers and merge small ones."""
    category_rows(articles).hint("rebalance", "category").write.mode("overwrite").partitionBy("category").parquet(path)
    return path
