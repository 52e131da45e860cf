"""Queries for URL functions, URL predicates and URL scores."""

from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions import urls as U
from webrec.plans import sqltext as S
from webrec.plans.inputs import table, view, with_views
from webrec.plans.registry import query

# the given pages live on example.* hosts, so these lists leave that name out
HOST_DENY = [w for w in L.INVALID_HOST_PARTS if w != "example.com"]

W = with_views("urls")
N = S.netloc("coalesce(url, '')")
P = "lower(" + S.path("coalesce(url, '')") + ")"
Q = "lower(" + S.querystr("coalesce(url, '')") + ")"
LOW = "lower(coalesce(url, ''))"


def _flag(name, oracle_expr, fn):
    """A predicate query: every candidate link with its verdict."""
    oracle = f"{W} SELECT page_id, url, CAST({oracle_expr} AS BOOLEAN) AS passed FROM urls"

    @query(name, oracle)
    def run(spark, sf_dir):
        return view(spark, sf_dir, "urls").select("page_id", "url", fn().alias("passed"))


def _kept(name, oracle_cond, fn):
    """A filter query: the links that pass."""
    oracle = f"{W} SELECT page_id, url FROM urls WHERE {oracle_cond}"

    @query(name, oracle)
    def run(spark, sf_dir):
        return view(spark, sf_dir, "urls").where(fn()).select("page_id", "url")


_kept(
    "filter_allowed_url",
    f"{N} <> '' AND NOT {S.sub_of(N, L.BLACKLIST_DOMAINS)} AND NOT {S.sub_of(N, L.SEARCH_ENGINE_DOMAINS)} "
    f"AND starts_with(url, 'http') AND NOT {S.has_any(LOW, L.ALLOWED_URL_BAD_PARTS)}",
    lambda: U.filter_allowed_url("url"),
)
_kept(
    "filter_allowed_business_url",
    f"{N} <> '' AND ({S.sub_of(N, L.BUSINESS_DIRECTORIES)} OR (NOT {S.sub_of(N, L.BUSINESS_URL_DENY)} "
    f"AND NOT {S.sub_of(N, L.SEARCH_ENGINE_DOMAINS)} AND starts_with(url, 'http') AND NOT {S.has_any(LOW, L.BUSINESS_URL_BAD_PARTS)}))",
    lambda: U.filter_allowed_business_url("url"),
)
_flag(
    "filter_business_website",
    f"CASE WHEN {S.has_any(N, L.SITE_DENY_SUBSTRINGS)} THEN false "
    f"WHEN NOT {S.has_any(N, L.SITE_DIRECTORY_DOMAINS)} AND {S.has_any(P, L.SITE_DIRECTORY_PATHS)} THEN false "
    f"ELSE {S.has_any(N, L.SITE_BUSINESS_WORDS)} OR {S.has_any(P, L.SITE_BUSINESS_WORDS)} OR {S.has_any(N, L.SITE_DIRECTORY_DOMAINS)} END",
    lambda: U.filter_business_website("url"),
)
_kept(
    "filter_topic_token_url",
    f"NOT {S.has_any(N, L.BLACKLIST_DOMAINS)} AND {S.has_any(LOW, L.TOPIC_URL_TOKENS)}",
    lambda: U.filter_topic_token_url("url"),
)
_kept(
    "filter_valid_host",
    f"{N} <> '' AND NOT {S.has_any(N, HOST_DENY)}",
    lambda: U.filter_valid_host("url", invalid=HOST_DENY),
)
_flag(
    "filter_website_valid",
    f"NOT {S.has_any(LOW, L.WEBSITE_SKIP_DOMAINS)} AND regexp_matches(coalesce(url, ''), '^https?://') AND contains(coalesce(url, ''), '.')",
    lambda: U.filter_website_valid("url"),
)
_kept(
    "filter_article_url",
    f"NOT ({S.has_any(N, L.PAYWALLED_DOMAINS)} OR {S.has_any(P, L.ARTICLE_BAD_PATHS)} OR {S.has_any(Q, L.ARTICLE_BAD_QUERIES)}) "
    f"AND ({S.has_any(P, L.ARTICLE_GOOD_PATHS)} OR regexp_matches({P}, '[0-9]') OR len([p for p in string_split({P}, '/') if p <> '']) > 1)",
    lambda: U.filter_article_url("url"),
)
_kept(
    "filter_article_like_url",
    f"length(coalesce(url, '')) >= 10 AND NOT ({S.has_any(P, L.ARTICLE_LIKE_EXCLUDE)} OR {S.has_any(Q, L.ARTICLE_LIKE_EXCLUDE)}) "
    f"AND ({S.has_any(P, L.ARTICLE_LIKE_INCLUDE)} OR regexp_matches(string_split({P}, '/')[-1], '[0-9]'))",
    lambda: U.filter_article_like_url("url"),
)
_flag(
    "filter_article_url_permissive",
    f"NOT ({S.has_any(N, L.PAYWALLED_DOMAINS)} OR {S.has_any(P, L.ARTICLE_PERMISSIVE_BAD_PATHS)} OR {S.has_any(Q, L.ARTICLE_PERMISSIVE_BAD_QUERIES)})",
    lambda: U.filter_article_url_permissive("url"),
)
_flag(
    "filter_news_link",
    f"{LOW} <> '' AND NOT {S.has_any(LOW, L.NEWS_LINK_EXCLUDE)} AND ({S.has_any(LOW, L.NEWS_LINK_PATTERNS)} "
    f"OR {S.has_any('lower(coalesce(title, chr(32)))', L.NEWS_LINK_TERMS)})",
    lambda: U.filter_news_link("url", "title"),
)
_flag(
    "filter_source_url",
    f"coalesce(source_category IN ('business', 'economy', 'markets'), false) OR {S.has_any(LOW, L.SOURCE_URL_WORDS)}",
    lambda: U.filter_source_url("url", "source_category"),
)

_SCORE = " + ".join(f"CASE WHEN contains({LOW}, {S.lit(k)}) THEN {v} ELSE 0 END" for k, v in L.TOPIC_WEIGHTS.items())
_FULL = (
    f"greatest(0, {_SCORE} + CASE WHEN {S.has_any(N, L.TOPIC_DOMAINS)} THEN 15 ELSE 0 END "
    f"+ CASE WHEN {S.has_any(LOW, L.TOPIC_ARTICLE_PARTS)} THEN 5 ELSE 0 END "
    f"- CASE WHEN {S.has_any(LOW, L.TOPIC_OFF_TERMS)} THEN 10 ELSE 0 END)"
)


def _limit(thresholds):
    whens = " ".join(f"WHEN {S.lit(k)} THEN {v}" for k, v in thresholds.items())
    return f"CASE source_type {whens} ELSE 15 END"


_REL = f"({_FULL} >= {_limit(L.TOPIC_THRESHOLDS)} OR {S.has_any(LOW, L.TOPIC_REQUIRED)})"


@query(
    "score_topic_url",
    f"{W} SELECT page_id, url, CAST({_FULL} AS BIGINT) AS score, CAST({_SCORE} AS BIGINT) AS simple_score FROM urls",
)
def score_topic_url(spark, sf_dir):
    return view(spark, sf_dir, "urls").select(
        "page_id", "url",
        U.score_topic_url("url").cast("bigint").alias("score"),
        U.score_topic_url("url", simple=True).cast("bigint").alias("simple_score"),
    )


@query(
    "topic_url_relevant",
    f"{W} SELECT page_id, url, {_REL} AS relevant, "
    f"({_SCORE}) >= {_limit(L.TOPIC_THRESHOLDS_PERMISSIVE)} OR {S.has_any(LOW, [*L.TOPIC_REQUIRED_PERMISSIVE, 'news', 'article'])} AS relevant_permissive FROM urls",
)
def topic_url_relevant(spark, sf_dir):
    return view(spark, sf_dir, "urls").select(
        "page_id", "url",
        U.topic_url_relevant("url", F.col("source_type")).alias("relevant"),
        U.topic_url_relevant("url", F.col("source_type"), permissive=True).alias("relevant_permissive"),
    )


@query(
    "filter_entry_relevant",
    f"{W} SELECT page_id, url FROM urls WHERE ({_FULL} >= 12 OR {S.has_any(LOW, L.TOPIC_REQUIRED)}) "
    f"OR {S.has_any('lower(concat_ws(chr(32), coalesce(title, chr(32)), description))', L.ENTRY_TERMS)}",
)
def filter_entry_relevant(spark, sf_dir):
    return view(spark, sf_dir, "urls").where(U.filter_entry_relevant("url", "title", "description")).select("page_id", "url")


@query(
    "filter_official_url",
    f"{W} SELECT DISTINCT trim(url) AS url FROM urls WHERE starts_with(trim(url), 'http') "
    f"AND NOT {S.sub_of(S.netloc('trim(url)'), L.SEARCH_ENGINE_DOMAINS)} AND NOT {S.has_any(LOW, L.OFFICIAL_URL_BAD_PARTS)}",
)
def filter_official_url(spark, sf_dir):
    u = view(spark, sf_dir, "urls")
    return u.where(U.filter_official_url("url")).select(F.trim("url").alias("url")).distinct()


@query(
    "geo_token_match",
    f"""{W} SELECT page_id, url, coalesce(city <> '' AND state <> '' AND (
        contains({LOW}, replace(replace(lower(city), ' ', ''), '-', '')) OR contains({LOW}, replace(lower(state), ' ', ''))
        OR contains({LOW}, lower(city)) OR contains({LOW}, lower(state))), false) AS geo_hit FROM urls""",
)
def geo_token_match(spark, sf_dir):
    return view(spark, sf_dir, "urls").select("page_id", "url", U.geo_token_match("url", "city", "state").alias("geo_hit"))


@query(
    "url_host",
    f"""{W} SELECT page_id, nullif({S.netloc('url')}, '') AS netloc,
        nullif(regexp_replace(regexp_replace({S.netloc('url')}, ':[0-9]*$', ''), '^www[.]', ''), '') AS bare_host FROM urls""",
)
def url_host(spark, sf_dir):
    return view(spark, sf_dir, "urls").select(
        "page_id", U.url_host("url").alias("netloc"),
        U.url_host("url", strip_www=True, strip_port=True).alias("bare_host"),
    )


@query(
    "unwrap_redirect_url",
    f"""{W} SELECT page_id, CASE page_id % 26
          WHEN 3 THEN url WHEN 6 THEN 'https://site' || page_id || '.org/x y' WHEN 7 THEN 'https://example.org/x'
          WHEN 19 THEN 'https://yard' || page_id || '.com/contact' WHEN 16 THEN NULL WHEN 17 THEN NULL WHEN 11 THEN NULL
          ELSE trim(url) END AS target FROM urls""",
)
def unwrap_redirect_url(spark, sf_dir):
    return view(spark, sf_dir, "urls").select("page_id", U.unwrap_redirect_url("url").alias("target"))


@query(
    "resolve_news_redirect",
    f"{W} SELECT page_id, CASE page_id % 26 WHEN 25 THEN 'https://metalinfo.ru/article/' || page_id END AS target FROM urls",
)
def resolve_news_redirect(spark, sf_dir):
    return view(spark, sf_dir, "urls").select("page_id", U.resolve_news_redirect("url").alias("target"))


_HREFS = """CASE page_id % 10 WHEN 0 THEN '/abs/x' WHEN 1 THEN 'rel/y' WHEN 2 THEN '../up' WHEN 3 THEN '//cdn.org/z'
 WHEN 4 THEN '?q=1' WHEN 5 THEN '#frag' WHEN 6 THEN 'https://other.org/a' WHEN 7 THEN 'mailto:a@b.org' WHEN 8 THEN '' ELSE './here' END"""
_ROOT = "regexp_extract(url, '^[a-z]+://[^/?#]+')"
_BARE = "split_part(split_part(url, '#', 1), '?', 1)"
_DIR = f"regexp_replace({_BARE}, '[^/]*$', '')"


@query(
    "absolute_url",
    f"""SELECT page_id, CASE page_id % 10 WHEN 0 THEN {_ROOT} || '/abs/x' WHEN 1 THEN {_DIR} || 'rel/y'
        WHEN 2 THEN regexp_replace(rtrim({_DIR}, '/'), '[^/]*$', '') || 'up'
        WHEN 3 THEN split_part(url, ':', 1) || '://cdn.org/z' WHEN 4 THEN {_BARE} || '?q=1'
        WHEN 5 THEN split_part(url, '#', 1) || '#frag' WHEN 6 THEN 'https://other.org/a' WHEN 7 THEN 'mailto:a@b.org'
        WHEN 8 THEN url ELSE {_DIR} || 'here' END AS absolute FROM pages""",
)
def absolute_url(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.expr(_HREFS).alias("href"))
    return p.select("page_id", U.absolute_url("url", "href").alias("absolute"))


@query(
    "ensure_scheme",
    with_views("companies") + "SELECT id, CASE WHEN website IS NULL OR website = '' THEN website "
    "WHEN starts_with(website, 'http://') OR starts_with(website, 'https://') THEN website ELSE 'https://' || website END AS website FROM companies",
)
def ensure_scheme(spark, sf_dir):
    return view(spark, sf_dir, "companies").select("id", U.ensure_scheme("website").alias("website"))


_BIZ = (
    f"CASE WHEN {S.has_any(LOW, ['yelp.com', 'yellowpages', 'superpages', 'merchantcircle', 'cylex'])} THEN 5 ELSE 0 END "
    f"+ CASE WHEN {S.has_any(LOW, ['about', 'contact', 'services', 'materials', 'prices', 'recycling', 'scrap'])} THEN 3 ELSE 0 END "
    f"+ CASE WHEN {S.has_any(LOW, ['directory', 'listings', 'companies', 'business'])} THEN 2 ELSE 0 END "
    f"+ greatest(0, 50 - length({LOW})) // 10"
)


@query("score_business_url", f"{W} SELECT page_id, CAST({_BIZ} AS BIGINT) AS score FROM urls")
def score_business_url(spark, sf_dir):
    return view(spark, sf_dir, "urls").select("page_id", U.score_business_url("url").cast("bigint").alias("score"))


_TD = "lower(concat_ws(' ', coalesce(title, ''), description))"
LINK_PRIORITY = (
    f"CASE WHEN {S.has_any(_TD, ['phone', 'call', 'contact'])} THEN 10 ELSE 0 END "
    f"+ CASE WHEN contains({_TD}, 'scrap metal') THEN 8 WHEN {S.has_any(_TD, ['scrap', 'recycling', 'salvage'])} THEN 5 ELSE 0 END "
    "+ CASE WHEN page_no IN (2, 3) THEN 3 WHEN page_no IN (4, 5) THEN 1 ELSE 0 END"
)


@query("score_link_priority", f"{W} SELECT page_id, CAST({LINK_PRIORITY} AS BIGINT) AS priority FROM urls")
def score_link_priority(spark, sf_dir):
    return view(spark, sf_dir, "urls").select(
        "page_id", U.score_link_priority("title", "description", "page_no").cast("bigint").alias("priority")
    )


# page text of the given pages, through the words that occur in it
DIR_WORDS = ["onthanen", "cheap-pills", "thshretion"]


@query(
    "classify_directory_page",
    f"SELECT page_id, {S.has_any(S.netloc('url'), ['casino-win', 'cheap-pills'])} OR {S.has_any('lower(html)', DIR_WORDS)} AS is_directory FROM pages",
)
def classify_directory_page(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(
        "page_id",
        U.classify_directory_page("url", "html", domains=["casino-win", "cheap-pills"], phrases=DIR_WORDS).alias("is_directory"),
    )
