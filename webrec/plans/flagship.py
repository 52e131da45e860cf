"""Flagship: which hosts publish most content pages, and their best page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webrec.functions.html import html_to_text
from webrec.functions.urls import filter_valid_host, score_business_url, url_host
from webrec.plans.inputs import table
from webrec.plans.registry import query
from webrec.plans.url_queries import HOST_DENY

_TXT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', ' ', 'gs'), '<(?:script|style|nav|header|footer|aside)\b.*?</(?:script|style|nav|header|footer|aside)\s*>', ' ', 'gsi'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


def best_page_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan, and one slim row per page in the one exchange."""
    pages = (
        table(spark, sf_dir, "pages")
        .where(filter_valid_host("url", invalid=HOST_DENY))
        .select(
            "page_id", "url", url_host("url", strip_www=True).alias("host"),
            F.length(html_to_text("html")).cast("bigint").alias("text_chars"),
            score_business_url("url").cast("bigint").alias("score"),
        )
    )
    best = F.max_by(F.struct("page_id", "url", "score"), F.struct("score", "text_chars", -F.col("page_id")))
    hosts = pages.groupBy("host").agg(
        F.count("*").alias("pages"), F.sum("text_chars").cast("bigint").alias("total_chars"), best.alias("best")
    )
    return hosts.select("host", "pages", "total_chars", "best.*").orderBy(F.desc("pages"), "host")


def _text_length():
    t = _TXT
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{char}')"
    return t


query(
    "best_page_per_host",
    f"""WITH p AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1)), '^www[.]', '') AS host,
        length({_text_length()}) AS n,
        CASE WHEN regexp_matches(lower(url), 'about|contact|services|materials|prices|recycling|scrap') THEN 3 ELSE 0 END
        + CASE WHEN regexp_matches(lower(url), 'directory|listings|companies|business') THEN 2 ELSE 0 END
        + CASE WHEN regexp_matches(lower(url), 'yelp[.]com|yellowpages|superpages|merchantcircle|cylex') THEN 5 ELSE 0 END
        + greatest(0, 50 - length(url)) // 10 AS score FROM pages),
     r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, n DESC, page_id) AS rn,
        count(*) OVER (PARTITION BY host) AS c, sum(n) OVER (PARTITION BY host) AS s FROM p)
     SELECT host, CAST(c AS BIGINT) AS pages, CAST(s AS BIGINT) AS total_chars, page_id, url, CAST(score AS BIGINT) AS score FROM r WHERE rn = 1""",
)(best_page_per_host)
