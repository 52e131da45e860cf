"""Top-k per group, caps, cascades, fallbacks, rankings and subsets."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrec.functions.common import filled
from webrec.functions.urls import score_business_url, score_link_priority
from webrec.operators.dedup import first_per_key, top_per_key
from webrec.operators.reports import exploded_categories


def topk_per_category(articles: DataFrame, k: int = 5, order: Sequence[Column] | None = None) -> DataFrame:
    order = order or [F.desc("published_at"), F.asc("id")]
    return top_per_key(exploded_categories(articles), ["category"], order, k)


def source_cap(limit: int, n_sources: int) -> int:
    return max(1, min(3, math.ceil(limit / max(1, n_sources))))


def cap_per_source(links: DataFrame, cap: int, order: Sequence[Column], source: str = "source") -> DataFrame:
    return top_per_key(links, [source], order, cap)


def priority_cascade(*tiers: DataFrame, key: str = "url", order: str = "id") -> DataFrame:
    """The first parser (tier) that has a record for a URL wins."""
    out = None
    for i, df in enumerate(tiers):
        t = df.withColumn("_prio", F.lit(i))
        out = t if out is None else out.unionByName(t)
    return first_per_key(out, key, [F.asc("_prio"), F.asc(order)]).drop("_prio")


def fallback_if_empty(rows: DataFrame, keep: Column, order: Sequence[Column], n: int = 30) -> DataFrame:
    """Rows that pass; if none does, the first n of all. The test is a scalar
    subquery that stops at one row, not a driver branch."""
    passed = rows.where(keep)
    none = passed.limit(1).agg(F.count("*")).scalar() == 0
    return passed.unionByName(rows.orderBy(*order).limit(n).where(none))


def rank_business_urls(urls: DataFrame, pos: str = "page_id") -> DataFrame:
    return urls.withColumn("score", score_business_url("url")).orderBy(F.desc("score"), pos)


def rank_links(links: DataFrame, pos: str = "page_id") -> DataFrame:
    """Distinct URLs (first one stays) by priority."""
    once = first_per_key(links.where(filled("url")), "url", [F.asc(pos)])
    return once.withColumn("priority", score_link_priority("title", "description", "page_no")).orderBy(F.desc("priority"), pos)


def rank_by_quality(records: DataFrame, by: Sequence[str], limit: int, row_id: str = "id") -> DataFrame:
    return records.orderBy(*[F.desc_nulls_last(c) for c in by], row_id).limit(limit)


def rank_with_contact_first(records: DataFrame, row_id: str = "id") -> DataFrame:
    return records.withColumn("has_phone", filled("phone")).orderBy(F.desc("has_phone"), row_id)


def high_quality_subset(records: DataFrame, more_than: int = 70) -> DataFrame:
    return records.where(F.col("quality") > more_than)


def top_quality_report(records: DataFrame, more_than: int = 50, n: int = 10) -> DataFrame:
    return records.where(F.col("completeness") > more_than).orderBy(F.desc("completeness"), "id").limit(n)


def latest_limit(articles: DataFrame, n: int) -> DataFrame:
    """First n unprocessed articles, oldest scrape first."""
    return articles.where("not is_processed").orderBy("scraped_at", "id").limit(n)


def ready_for_publication(articles: DataFrame) -> DataFrame:
    return articles.where(F.col("is_processed") & F.col("rewritten_content").isNotNull() & ~F.col("is_published"))
