"""Queries for reports and aggregations."""

from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.operators import reports as R
from webrec.operators.records import profile_records, score_records
from webrec.plans import quality_queries as QQ
from webrec.plans import sqltext as S
from webrec.plans.inputs import table, view, with_views
from webrec.plans.registry import query

CO = with_views("companies")
A = with_views("articles")
CR = with_views("crawl")


def _co(spark, sf_dir):
    return view(spark, sf_dir, "companies")


def _art(spark, sf_dir):
    return view(spark, sf_dir, "articles")


def _prof(spark, sf_dir):
    return profile_records(_co(spark, sf_dir))


PROF = (
    f"{CO}, prof AS (SELECT *, {QQ.COMPLETENESS} AS completeness, {QQ.CONTACT_QUALITY} AS contact_quality, {QQ.SIZE} AS business_size_estimate, "
    f"{QQ.TIER} AS market_tier, {QQ.PRIORITY} AS outreach_priority FROM companies) "
)
N = "CAST(count(*) AS BIGINT)"


def _pct(n, total):
    return f"round({n} * 100.0 / {total}, 1)"


query(
    "agg_validation_issues",
    f"""{CO}, i AS (SELECT {QQ.ISSUE_LIST} AS issues FROM companies) SELECT issue, {N} AS n, (SELECT {N} FROM i) AS total, (SELECT {N} FROM i WHERE len(issues) = 0) AS valid
        FROM (SELECT unnest(issues) AS issue FROM i) GROUP BY issue""",
)(lambda spark, sf_dir: R.agg_validation_issues(_co(spark, sf_dir).select(QQ.issues().alias("issues"))))

_COV = {"phone": "coalesce(phone, '') <> ''", "email": "coalesce(email, '') <> ''", "website": "coalesce(website, '') <> ''", "address": "coalesce(address, '') <> ''", "coordinates": "latitude IS NOT NULL"}
query(
    "agg_contact_coverage",
    f"{CO} " + " UNION ALL ".join(f"SELECT '{k}' AS field, CAST(count(*) FILTER ({c}) AS BIGINT) AS n, {N} AS total, {_pct(f'count(*) FILTER ({c})', 'count(*)')} AS percent FROM companies" for k, c in _COV.items()),
)(lambda spark, sf_dir: R.agg_contact_coverage(_co(spark, sf_dir)))
query("agg_country_distribution", f"{CO} SELECT coalesce(country, 'Unknown') AS country, {N} AS n FROM companies GROUP BY 1")(
    lambda spark, sf_dir: R.agg_country_distribution(_co(spark, sf_dir))
)
query("agg_state_distribution", f"{CO} SELECT coalesce(state, 'Unknown') AS state, {N} AS n, {_pct('count(*)', '(SELECT count(*) FROM companies)')} AS percent FROM companies GROUP BY 1")(
    lambda spark, sf_dir: R.agg_state_distribution(_co(spark, sf_dir))
)
query(
    "agg_material_distribution",
    f"{CO} SELECT material, {N} AS n, {_pct('count(*)', '(SELECT count(*) FROM companies)')} AS percent FROM (SELECT unnest(materials) AS material FROM companies) GROUP BY 1 ORDER BY n DESC, material LIMIT 20",
)(lambda spark, sf_dir: R.agg_material_distribution(_co(spark, sf_dir)))
query(
    "agg_geo_market",
    f"""{PROF}, sz AS (SELECT state, business_size_estimate AS b, count(*) AS c FROM prof GROUP BY ALL), m AS (SELECT state, arg_min(b, (-c, b)) AS common_size FROM sz GROUP BY state)
        SELECT p.state, {N} AS businesses, round(sum(completeness) / count(*), 2) AS avg_completeness, round(sum(contact_quality) / count(*), 2) AS avg_contact_quality, any_value(common_size) AS common_size
        FROM prof p JOIN m ON p.state IS NOT DISTINCT FROM m.state GROUP BY p.state""",
)(lambda spark, sf_dir: R.agg_geo_market(_prof(spark, sf_dir))[0])
query(
    "agg_geo_market_tiers",
    f"{PROF} SELECT market_tier, {N} AS businesses, CAST(count(*) FILTER (outreach_priority = 'High') AS BIGINT) AS high_priority, round(avg(completeness), 2) AS avg_completeness FROM prof GROUP BY 1",
)(lambda spark, sf_dir: R.agg_geo_market(_prof(spark, sf_dir))[1])
query(
    "agg_size_analysis",
    f"{PROF} SELECT business_size_estimate, {N} AS businesses, round(avg(completeness), 2) AS avg_completeness, CAST(count(*) FILTER (outreach_priority = 'High') AS BIGINT) AS high_priority FROM prof GROUP BY 1",
)(lambda spark, sf_dir: R.agg_size_analysis(_prof(spark, sf_dir)))
_FLAGS = {"pickup_service": "contains(s, 'pickup')", "container_rental": "regexp_matches(s, 'container|rental|roll-off')", "demolition_service": "contains(s, 'demolition')",
          "processing_capabilities": "regexp_matches(s, 'processing|sorting|shredding')", "certified_scales": "contains(s, 'scale')"}
query(
    "agg_service_capability",
    f"{CO}, v AS (SELECT coalesce(array_to_string(services, ' '), '') AS s FROM companies) "
    + " UNION ALL ".join(f"SELECT '{k}' AS service, CAST(count(*) FILTER ({c}) AS BIGINT) AS n, {N} AS total, {_pct(f'count(*) FILTER ({c})', 'count(*)')} AS percent FROM v" for k, c in _FLAGS.items()),
)(lambda spark, sf_dir: R.agg_service_capability(_prof(spark, sf_dir), list(_FLAGS)))
query(
    "agg_factor_shares",
    f"{PROF} " + " UNION ALL ".join(
        f"SELECT '{label}' AS factor, {c} AS value, {N} AS n, {_pct('count(*)', '(SELECT count(*) FROM prof)')} AS percent FROM prof GROUP BY {c}"
        for c, label in (("market_tier", "Market tier"), ("outreach_priority", "Outreach"), ("source", "Source"))),
)(lambda spark, sf_dir: R.agg_factor_shares(_prof(spark, sf_dir), {"market_tier": "Market tier", "outreach_priority": "Outreach", "source": "Source"}))
_WP = "coalesce(phone, '') <> ''"
query("agg_source_quality", f"{CO} SELECT source, {N} AS n, CAST(count(*) FILTER ({_WP}) AS BIGINT) AS with_phone, {_pct(f'count(*) FILTER ({_WP})', 'count(*)')} AS percent FROM companies GROUP BY 1")(
    lambda spark, sf_dir: R.agg_source_quality(_co(spark, sf_dir))
)
query("agg_extraction_method", f"{CO} SELECT method, {N} AS n, {_pct('count(*)', f'(SELECT count(*) FROM companies WHERE {_WP})')} AS percent FROM companies WHERE {_WP} GROUP BY 1")(
    lambda spark, sf_dir: R.agg_extraction_method(_co(spark, sf_dir))
)
query("agg_search_page_distribution", f"{CO} SELECT page_no, {N} AS n, {_pct('count(*)', '(SELECT count(*) FROM companies)')} AS percent FROM companies GROUP BY 1")(
    lambda spark, sf_dir: R.agg_search_page_distribution(_co(spark, sf_dir))
)
_EXC = "(SELECT trim(unnest(string_split(categories_list, ','))) AS category FROM articles)"
query("agg_category_counts", f"{A} SELECT category, {N} AS n FROM {_EXC} GROUP BY 1")(lambda spark, sf_dir: R.agg_category_counts(_art(spark, sf_dir)))
query(
    "agg_category_stats",
    f"{A} SELECT category, {N} AS n, (SELECT {N} FROM articles) AS total, (SELECT count(*) FILTER (categories_list <> 'type:other') / count(*) FROM articles) AS coverage FROM {_EXC} GROUP BY 1 ORDER BY n DESC, category LIMIT 10",
)(lambda spark, sf_dir: R.agg_category_stats(_art(spark, sf_dir)))
query(
    "agg_article_status",
    f"""{A} SELECT {N} AS total, CAST(count(*) FILTER (is_processed) AS BIGINT) AS processed, CAST(count(*) FILTER (is_published) AS BIGINT) AS published, CAST(count(*) FILTER (is_processed AND NOT is_published) AS BIGINT) AS waiting,
        {_pct('count(*) FILTER (is_processed)', 'count(*)')} AS processed_percent, {_pct('count(*) FILTER (is_published)', 'count(*)')} AS published_percent, (SELECT count(DISTINCT date_trunc('week', published_at)) FROM articles) AS digests FROM articles""",
)(lambda spark, sf_dir: R.agg_article_status(_art(spark, sf_dir), _art(spark, sf_dir).select(F.date_trunc("week", "published_at")).distinct()))
query("agg_articles_by_source", f"{A} SELECT source, {N} AS n FROM articles WHERE source IS NOT NULL GROUP BY 1")(lambda spark, sf_dir: R.agg_articles_by_source(_art(spark, sf_dir)))
query(
    "agg_run_report",
    f"""{CR} SELECT run_id, {N} AS collected, count(DISTINCT url) AS distinct_urls, count(*) - count(DISTINCT url) AS duplicates_removed, CAST(count(*) FILTER (source = 'view') AS BIGINT) AS from_view,
        round(count(DISTINCT url) / greatest((epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6) / 60, 0.1), 4) AS urls_per_minute FROM crawl GROUP BY run_id""",
)(lambda spark, sf_dir: R.agg_run_report(view(spark, sf_dir, "crawl")).withColumn("from_view", F.col("sources")["view"]).drop("sources"))
query("agg_parsing_stats", f"{A} SELECT parser, {N} AS n FROM articles GROUP BY 1")(lambda spark, sf_dir: R.agg_parsing_stats(_art(spark, sf_dir)))
query(
    "agg_funnel",
    f"""{A} SELECT parser AS run_id, {N} AS collected, CAST(count(*) FILTER (is_processed) AS BIGINT) AS processed, CAST(count(*) FILTER (is_published) AS BIGINT) AS generated,
        {_pct('count(*) FILTER (is_processed)', 'count(*)')} AS processed_percent, {_pct('count(*) FILTER (is_published)', 'count(*) FILTER (is_processed)')} AS generated_percent FROM articles GROUP BY 1""",
)(
    lambda spark, sf_dir: (lambda a: R.agg_funnel(a, a.where("is_processed"), a.where("is_published")))(_art(spark, sf_dir).select(F.col("parser").alias("run_id"), "is_processed", "is_published"))
)
_STOP = [*L.SUGGESTION_STOPWORDS, "that", "from"]
query(
    "agg_keyword_suggestions",
    rf"SELECT word, {N} AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) WHERE length(word) > 3 AND word NOT IN ({', '.join(S.lit(w) for w in _STOP)}) GROUP BY 1 ORDER BY n DESC, word LIMIT 10",
)(lambda spark, sf_dir: R.agg_keyword_suggestions(table(spark, sf_dir, "documents"), _STOP))
query(
    "agg_metal_specialization",
    f"""{PROF} SELECT id, name, city, state, unnest(CASE WHEN materials IS NULL THEN [NULL] ELSE materials END) AS metal, CASE WHEN len(materials) > 0 THEN round(100.0 / len(materials), 1) END AS confidence, CAST(contact_quality AS BIGINT) AS contact_quality FROM prof""",
)(lambda spark, sf_dir: R.agg_metal_specialization(score_records(_co(spark, sf_dir))).withColumn("contact_quality", F.col("contact_quality").cast("bigint")))
query(
    "agg_quality_overview",
    f"""{PROF} SELECT {N} AS total, CAST(count(*) FILTER (len(materials) > 0) AS BIGINT) AS with_metals, CAST(count(*) FILTER (pricing <> '') AS BIGINT) AS with_pricing, CAST(count(*) FILTER (len(services) > 0) AS BIGINT) AS with_services,
        CAST(count(*) FILTER (website <> '') AS BIGINT) AS with_website, CAST(count(*) FILTER (phone <> '') AS BIGINT) AS with_phone, round(avg(completeness), 2) AS avg_completeness FROM prof""",
)(lambda spark, sf_dir: R.agg_quality_overview(score_records(_co(spark, sf_dir))))
query(
    "agg_llm_chunks",
    """WITH d AS (SELECT doc_id, source, text AS t, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)
       SELECT CAST(pos // 20 AS BIGINT) AS chunk, CAST(count(*) AS BIGINT) AS n_docs, string_agg('-- DOC ' || (pos % 20 + 1) || ' --' || chr(10) || 'URL: ' || source || chr(10) || 'TEXT:' || chr(10) || t, chr(10) || chr(10) ORDER BY pos) AS prompt FROM d GROUP BY pos // 20""",
)(lambda spark, sf_dir: R.agg_llm_chunks(table(spark, sf_dir, "documents"), "doc_id", url="source"))
