"""Queries for top-k, caps, cascades, rankings, subsets and digests."""

from pyspark.sql import functions as F

from webrec.functions.common import filled
from webrec.functions.urls import filter_business_website
from webrec.operators import digests as G
from webrec.operators import joins as J
from webrec.operators import ranking as K
from webrec.operators.records import profile_records, score_records, with_contact
from webrec.plans import quality_queries as QQ
from webrec.plans import url_queries as UQ
from webrec.plans.inputs import view, with_views
from webrec.plans.join_queries import LOC, _locations
from webrec.plans.registry import query

CO = with_views("companies")
A = with_views("articles")
CR = with_views("crawl")
U = with_views("urls")


def _co(spark, sf_dir):
    return view(spark, sf_dir, "companies")


def _art(spark, sf_dir):
    return view(spark, sf_dir, "articles")


_EX = "(SELECT id, title, published_at, trim(unnest(string_split(categories_list, ','))) AS category FROM articles)"
query("topk_per_category", f"{A} SELECT category, id, title FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY published_at DESC, id) AS rn FROM {_EX}) WHERE rn <= 5")(
    lambda spark, sf_dir: K.topk_per_category(_art(spark, sf_dir)).select("category", "id", "title")
)
query("cap_per_source", f"{CR} SELECT source, event_id, url FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts, event_id) AS rn FROM crawl) WHERE rn <= 3")(
    lambda spark, sf_dir: K.cap_per_source(view(spark, sf_dir, "crawl"), K.source_cap(50, 5), [F.asc("ts"), F.asc("event_id")]).select("source", "event_id", "url")
)
query(
    "cap_by_priority",
    f"""{LOC}, q AS (SELECT state, id % 4 + 1 AS priority, id FROM loc), r AS (SELECT *, row_number() OVER (PARTITION BY state, priority ORDER BY id) AS rn FROM q)
        SELECT state, CAST(priority AS BIGINT) AS priority, id FROM r WHERE rn <= CASE priority WHEN 1 THEN 20 WHEN 2 THEN 15 WHEN 3 THEN 10 ELSE 5 END""",
)(
    lambda spark, sf_dir: J.cap_by_priority(_locations(spark, sf_dir).select("state", (F.col("id") % 4 + 1).alias("priority"), "id"), ["state"], [F.asc("id")])
    .select("state", F.col("priority").cast("bigint").alias("priority"), "id")
)
query(
    "priority_cascade",
    f"""{A}, u AS (SELECT *, source || '/' || (id % 100) AS page FROM articles), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY parser_prio, id) AS rn FROM u WHERE parser_prio < 3) SELECT page, id, parser FROM r WHERE rn = 1""",
)(
    lambda spark, sf_dir: (lambda a: K.priority_cascade(*[a.where(F.col("parser_prio") == p) for p in (0, 1, 2)], key="page"))(
        _art(spark, sf_dir).select(F.concat_ws("/", "source", (F.col("id") % 100).cast("string")).alias("page"), "id", "parser", "parser_prio")
    ).select("page", "id", "parser")
)
query("fallback_if_empty", f"{U} SELECT page_id, url FROM urls WHERE url IS NOT NULL AND url <> '' ORDER BY page_id LIMIT 30")(
    lambda spark, sf_dir: K.fallback_if_empty(
        view(spark, sf_dir, "urls").where(filled("url")).select("page_id", "url"), filter_business_website("url", words=["no-such-word"], directories=["no-such-host"]), [F.asc("page_id")])
)
query("fallback_not_needed", f"{U} SELECT page_id, url FROM urls WHERE url IS NOT NULL AND contains(lower(url), 'scrap')")(
    lambda spark, sf_dir: K.fallback_if_empty(view(spark, sf_dir, "urls").where(filled("url")).select("page_id", "url"), F.lower("url").contains("scrap"), [F.asc("page_id")])
)
query("rank_business_urls", f"{U} SELECT page_id, CAST({UQ._BIZ} AS BIGINT) AS score FROM urls")(
    lambda spark, sf_dir: K.rank_business_urls(view(spark, sf_dir, "urls")).select("page_id", F.col("score").cast("bigint").alias("score"))
)
query(
    "rank_links",
    f"{U}, f AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM urls WHERE coalesce(url, '') <> '') SELECT page_id, url, CAST({UQ.LINK_PRIORITY} AS BIGINT) AS priority FROM f WHERE rn = 1",
)(lambda spark, sf_dir: K.rank_links(view(spark, sf_dir, "urls")).select("page_id", "url", F.col("priority").cast("bigint").alias("priority")))
query(
    "rank_by_quality",
    f"{CO} SELECT id, relevance, CAST({QQ.QUALITY} AS BIGINT) AS quality FROM companies ORDER BY quality DESC, relevance DESC, id LIMIT 50",
)(lambda spark, sf_dir: K.rank_by_quality(score_records(_co(spark, sf_dir)), ["quality", "relevance"], 50).select("id", "relevance", F.col("quality").cast("bigint").alias("quality")))
query("rank_with_contact_first", f"{CO} SELECT id, coalesce(phone, '') <> '' AS has_phone FROM companies")(
    lambda spark, sf_dir: K.rank_with_contact_first(_co(spark, sf_dir)).select("id", "has_phone")
)
query("split_by_contact", f"{CO} SELECT id, 'with' AS part FROM companies WHERE coalesce(phone, '') <> '' UNION ALL SELECT id, 'without' FROM companies WHERE coalesce(phone, '') = ''")(
    lambda spark, sf_dir: (lambda ab: ab[0].select("id", F.lit("with").alias("part")).unionByName(ab[1].select("id", F.lit("without").alias("part"))))(with_contact(_co(spark, sf_dir)))
)
query("high_quality_subset", f"{CO} SELECT id, 'quality' AS rule FROM companies WHERE {QQ.QUALITY} > 70 UNION ALL SELECT id, 'outreach' FROM companies WHERE {QQ.PRIORITY} = 'High'")(
    lambda spark, sf_dir: K.high_quality_subset(score_records(_co(spark, sf_dir))).select("id", F.lit("quality").alias("rule")).unionByName(
        profile_records(_co(spark, sf_dir)).where("outreach_priority = 'High'").select("id", F.lit("outreach").alias("rule")))
)
query("top_quality_report", f"{CO} SELECT id, {QQ.COMPLETENESS} AS completeness FROM companies WHERE {QQ.COMPLETENESS} > 50 ORDER BY completeness DESC, id LIMIT 10")(
    lambda spark, sf_dir: K.top_quality_report(score_records(_co(spark, sf_dir))).select("id", F.col("completeness").cast("bigint").alias("completeness"))
)
query("latest_limit", f"{A} SELECT id, url FROM articles WHERE NOT is_processed ORDER BY scraped_at, id LIMIT 100")(
    lambda spark, sf_dir: K.latest_limit(_art(spark, sf_dir), 100).select("id", "url")
)
query("ready_for_publication", f"{A} SELECT id, title FROM articles WHERE is_processed AND rewritten_content IS NOT NULL AND NOT is_published")(
    lambda spark, sf_dir: K.ready_for_publication(_art(spark, sf_dir)).select("id", "title")
)

# -- digests ------------------------------------------------------------------
_TI = "coalesce(translated_title, title)"
_ENTRY = "'- **' || {t} || '**' || chr(10) || CASE WHEN coalesce(summary, '') <> '' THEN '  ' || summary[1:100] || '...' || chr(10) ELSE '' END || '  [{r}](' || url || ')' || chr(10) || chr(10)"


def _digest_sql(src, keys, k, read, heading):
    kk = "".join(f"{x}, " for x in keys)
    return f"""e AS (SELECT {kk} id, published_at, trim(unnest(coalesce(string_split(categories_list, ','), ['other']))) AS category, {_ENTRY.format(t=_TI, r=read)} AS entry FROM {src}),
     t AS (SELECT *, row_number() OVER (PARTITION BY {kk} category ORDER BY published_at, id) AS rn FROM e),
     s AS (SELECT {kk} category, '## ' || {heading} || chr(10) || chr(10) || string_agg(entry, '' ORDER BY published_at, id) AS body, count(*) AS n FROM t WHERE rn <= {k} GROUP BY {kk} category)"""


def _cap(expr):
    """Words of a label with a capital first letter."""
    return f"array_to_string([upper(w[1]) || w[2:] for w in string_split({expr}, ' ')], ' ')"


query(
    "digest_period",
    f"""{A}, p AS (SELECT * FROM articles WHERE is_processed AND published_at BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-05 21:00:00'),
        {_digest_sql('p', [], 5, 'Читать далее', _cap("category"))}
        SELECT 'daily' AS digest_type, '# Daily дайджест новостей металлургической отрасли' || chr(10) || chr(10) || 'Период: 03.01.2024 - 05.01.2024' || chr(10) || chr(10) || string_agg(body, '' ORDER BY category) AS content,
        CAST(sum(n) AS BIGINT) AS article_count, string_agg(category, ', ' ORDER BY category) AS categories FROM s""",
)(lambda spark, sf_dir: G.digest_period(_art(spark, sf_dir), "2024-01-03 00:00:00", "2024-01-05 21:00:00"))
query(
    "digest_simple",
    f"""{A}, {_digest_sql('articles', [], 3, 'Читать', _cap("replace(category, ':', ' ')"))}
        SELECT '# Daily дайджест металлургической отрасли' || chr(10) || chr(10) || string_agg(body, '' ORDER BY category) AS content, (SELECT count(*) FROM articles) AS article_count,
        string_agg(category, ', ' ORDER BY category) AS categories, 'daily' AS frequency FROM s""",
)(lambda spark, sf_dir: G.digest_simple(_art(spark, sf_dir)))
query(
    "digest_by_frequency",
    f"""{A}, w AS (SELECT *, date_trunc('week', published_at) AS period FROM articles WHERE is_processed), p AS (SELECT * FROM w),
        {_digest_sql('p', ['period'], 5, 'Читать далее', _cap("category"))}
        SELECT CAST(period AS TIMESTAMP) AS period, 'weekly' AS digest_type, string_agg(body, '' ORDER BY category) AS sections, CAST(sum(n) AS BIGINT) AS article_count, string_agg(category, ', ' ORDER BY category) AS categories FROM s GROUP BY period""",
)(lambda spark, sf_dir: G.digest_by_frequency(_art(spark, sf_dir)))
