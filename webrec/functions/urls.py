"""URL parts, URL predicates and URL scores. All are Column -> Column and run
inside code generation; put them in a filter before any page is parsed."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions.common import any_of, blank_to_null, contains_any, col, in_domains, let, text, text_has_any, weighted_contains

_NETLOC = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


# -- parts --------------------------------------------------------------------
def url_netloc(url: Column | str) -> Column:
    """Authority part, lower case, port kept. The pattern accepts what a
    tolerant parser accepts (bad escapes, non-ASCII paths); null when absent."""
    return blank_to_null(F.lower(F.regexp_extract(col(url), _NETLOC, 1)))


def url_host(url: Column | str, *, strip_www: bool = False, strip_port: bool = False) -> Column:
    host = url_netloc(url)
    if strip_port:
        host = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    if strip_www:
        host = F.regexp_replace(host, r"^www\.", "")
    return host


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(col(url), _PATH, 1)


def url_query(url: Column | str) -> Column:
    return F.regexp_extract(col(url), _QUERY, 1)


def query_value(url: Column | str, key: str) -> Column:
    raw = F.regexp_extract(url_query(url), rf"(?:^|&){key}=([^&]*)", 1)
    return blank_to_null(F.try_url_decode(raw))


def ensure_scheme(url: Column | str) -> Column:
    u = col(url)
    return F.when(u == "", u).when(u.rlike(r"^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def absolute_url(base: Column | str, href: Column | str) -> Column:
    """Resolve an href against its page URL."""
    b, h = col(base), col(href)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    bare = F.regexp_replace(b, r"[?#].*$", "")
    folder = F.when(bare == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    joined = F.when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat(folder, h))
    # remove dot segments of the path; each pass takes every second "x/../"
    tidy = F.regexp_replace(joined, r"/\./", "/")
    for _ in range(4):
        tidy = F.regexp_replace(tidy, r"(://[^/?#]*(?:/[^?#]*?)?)/(?!\.\.?/)[^/?#]+/\.\./", "$1/")
    tidy = F.regexp_replace(tidy, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)/(?:\.\./)+", "$1/")
    return (
        F.when(h.isNull() | (h == ""), b)
        .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
        .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
        .when(h.startswith("?"), F.concat(bare, h))
        .when(h.startswith("#"), F.concat(F.regexp_replace(b, r"#.*$", ""), h))
        .otherwise(tidy)
    )


def _from_base64_url(value: Column) -> Column:
    """URL-safe base64 text; null when it does not decode."""
    std = F.translate(value, "-_", "+/")
    padded = F.rpad(std, (F.ceil(F.length(std) / 4) * 4).cast("int"), "=")
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def unwrap_redirect_url(url: Column | str) -> Column:
    """Target of a search-engine redirect link; other http links unchanged;
    null for empty or non-http input."""
    u = F.trim(col(url))
    host, path = url_netloc(u), url_path(u)
    ddg = F.when(host.endswith("duckduckgo.com") & path.startswith("/l/"), query_value(u, "uddg"))

    def http(c: Column) -> Column:
        return F.when(c.startswith("http"), c)

    bing_raw = F.try_url_decode(query_value(u, "u"))
    bing = F.when(
        host.endswith("bing.com") & (path.startswith("/ck/") | path.startswith("/aclick")),
        F.coalesce(http(bing_raw), http(_from_base64_url(F.regexp_replace(bing_raw, "^a1", "")))),
    )
    msn_values = [F.try_url_decode(query_value(u, k)) for k in ("url", "target", "u")]
    msn = F.when(
        any_of([host.endswith(h) for h in ("r.msn.com", "r.bing.com", "c.bing.com")]),
        F.coalesce(*[x for v in msn_values for x in (http(v), http(_from_base64_url(v)))]),
    )
    return F.when(u.startswith("http") & host.isNotNull(), F.coalesce(ddg, bing, msn, u))


def resolve_news_redirect(url: Column | str, aggregator: str = "news.google.com") -> Column:
    """``url=`` target of an aggregator link, kept if it is a valid article."""
    target = F.try_url_decode(query_value(url, "url"))
    return F.when(~target.contains(aggregator) & filter_article_url(target), target)


# -- predicates ---------------------------------------------------------------
def _parts(url, rule) -> Column:
    """``rule`` on the parts of a URL, each taken out once per row."""
    u = text(url)
    parts = F.struct(
        u.alias("url"), F.lower(u).alias("low"), F.coalesce(url_netloc(u), F.lit("")).alias("host"),
        F.lower(url_path(u)).alias("path"), F.lower(url_query(u)).alias("query"))
    return let(parts, rule)


def filter_allowed_url(url, *, deny=L.BLACKLIST_DOMAINS, search=L.SEARCH_ENGINE_DOMAINS, bad_parts=L.ALLOWED_URL_BAD_PARTS) -> Column:
    def rule(p):
        return (
            (p["host"] != "") & ~in_domains(p["host"], [*deny, *search])
            & p["url"].startswith("http") & ~contains_any(p["low"], bad_parts))
    return _parts(url, rule)


def filter_allowed_business_url(url, *, directories=L.BUSINESS_DIRECTORIES, deny=L.BUSINESS_URL_DENY, search=L.SEARCH_ENGINE_DOMAINS, bad_parts=L.BUSINESS_URL_BAD_PARTS) -> Column:
    def rule(p):
        return (
            F.when(p["host"] == "", False)
            .when(in_domains(p["host"], directories), True)
            .when(in_domains(p["host"], [*deny, *search]), False)
            .otherwise(p["url"].startswith("http") & ~contains_any(p["low"], bad_parts)))
    return _parts(url, rule)


def filter_business_website(url, *, deny=L.SITE_DENY_SUBSTRINGS, directories=L.SITE_DIRECTORY_DOMAINS, bad_paths=L.SITE_DIRECTORY_PATHS, words=L.SITE_BUSINESS_WORDS) -> Column:
    def rule(p):
        directory = contains_any(p["host"], directories)
        return (
            F.when(contains_any(p["host"], deny), False)
            .when(~directory & contains_any(p["path"], bad_paths), False)
            .otherwise(contains_any(p["host"], words) | contains_any(p["path"], words) | directory))
    return _parts(url, rule)


def filter_topic_token_url(url, *, deny=L.BLACKLIST_DOMAINS, tokens=L.TOPIC_URL_TOKENS) -> Column:
    host = F.coalesce(url_netloc(url), F.lit(""))
    return ~contains_any(host, deny) & contains_any(F.lower(text(url)), tokens)


def filter_valid_host(url, *, invalid=L.INVALID_HOST_PARTS) -> Column:
    host = url_netloc(url)
    return F.coalesce(~contains_any(host, invalid), F.lit(False))


def filter_official_url(url, *, search=L.SEARCH_ENGINE_DOMAINS, bad_parts=L.OFFICIAL_URL_BAD_PARTS) -> Column:
    u = F.trim(text(url))
    host = F.coalesce(url_netloc(u), F.lit(""))
    return u.startswith("http") & ~in_domains(host, search) & ~contains_any(F.lower(u), bad_parts)


def filter_website_valid(url, *, skip=L.WEBSITE_SKIP_DOMAINS) -> Column:
    u = text(url)
    return ~contains_any(F.lower(u), skip) & u.rlike(r"^https?://") & u.contains(".")


def classify_directory_page(url, page_text, *, domains=L.DIRECTORY_PAGE_DOMAINS, phrases=L.DIRECTORY_PAGE_PHRASES) -> Column:
    host = F.coalesce(url_netloc(F.lower(text(url))), F.lit(""))
    return contains_any(host, domains) | text_has_any(F.lower(text(page_text)), phrases)


def filter_article_url(url, *, paywalled=L.PAYWALLED_DOMAINS, bad_paths=L.ARTICLE_BAD_PATHS, bad_queries=L.ARTICLE_BAD_QUERIES, good_paths=L.ARTICLE_GOOD_PATHS) -> Column:
    def rule(p):
        bad = contains_any(p["host"], paywalled) | contains_any(p["path"], bad_paths) | contains_any(p["query"], bad_queries)
        several = p["path"].rlike(r"(?<![^/])[^/]++/++[^/]")
        return ~bad & (contains_any(p["path"], good_paths) | p["path"].rlike(r"\d") | several)
    return _parts(url, rule)


def filter_article_like_url(url, *, exclude=L.ARTICLE_LIKE_EXCLUDE, include=L.ARTICLE_LIKE_INCLUDE) -> Column:
    def rule(p):
        bad = contains_any(p["path"], exclude) | contains_any(p["query"], exclude)
        return (F.length(p["url"]) >= 10) & ~bad & (contains_any(p["path"], include) | p["path"].rlike(r"\d[^/]*$"))
    return _parts(url, rule)


def filter_article_url_permissive(url, *, paywalled=L.PAYWALLED_DOMAINS, bad_paths=L.ARTICLE_PERMISSIVE_BAD_PATHS, bad_queries=L.ARTICLE_PERMISSIVE_BAD_QUERIES) -> Column:
    return _parts(url, lambda p: ~(
        contains_any(p["host"], paywalled) | contains_any(p["path"], bad_paths) | contains_any(p["query"], bad_queries)))


def filter_news_link(href, anchor, *, exclude=L.NEWS_LINK_EXCLUDE, patterns=L.NEWS_LINK_PATTERNS, terms=L.NEWS_LINK_TERMS) -> Column:
    h = F.lower(text(href))
    return (
        F.when((h == "") | contains_any(h, exclude), False)
        .otherwise(contains_any(h, patterns) | contains_any(F.lower(text(anchor)), terms))
    )


def filter_source_url(url, source_category, *, categories=L.SOURCE_CATEGORIES, words=L.SOURCE_URL_WORDS) -> Column:
    known = F.coalesce(col(source_category).isin(*categories), F.lit(False))
    return known | contains_any(F.lower(text(url)), words)


def filter_entry_relevant(url, title, summary, source_type="rss", *, terms=L.ENTRY_TERMS) -> Column:
    body = F.lower(F.concat_ws(" ", text(title), text(summary)))
    return topic_url_relevant(url, F.lit(source_type)) | contains_any(body, terms)


def geo_token_match(url, city, state) -> Column:
    """Flag: the city or the state appears in the URL, raw or squeezed."""
    u = F.lower(text(url))
    c, s = F.lower(col(city)), F.lower(col(state))
    hit = (
        u.contains(F.regexp_replace(c, "[ -]", "")) | u.contains(F.replace(s, F.lit(" "), F.lit("")))
        | u.contains(c) | u.contains(s)
    )
    return F.coalesce(hit & (c != "") & (s != ""), F.lit(False))


# -- scores -------------------------------------------------------------------
def _points(cond: Column, n: int) -> Column:
    return F.when(cond, F.lit(n)).otherwise(F.lit(0))


def score_business_url(url) -> Column:
    low = F.lower(text(url))
    return (
        _points(contains_any(low, ["yelp.com", "yellowpages", "superpages", "merchantcircle", "cylex"]), 5)
        + _points(contains_any(low, ["about", "contact", "services", "materials", "prices", "recycling", "scrap"]), 3)
        + _points(contains_any(low, ["directory", "listings", "companies", "business"]), 2)
        + F.floor(F.greatest(F.lit(0), F.lit(50) - F.length(low)) / 10).cast("int")
    )


def score_topic_url(url, weights: Mapping[str, int] = L.TOPIC_WEIGHTS, *, simple: bool = False, domains: Sequence[str] = L.TOPIC_DOMAINS) -> Column:
    low = F.lower(text(url))
    total = weighted_contains(low, list(weights.items()))
    if simple:
        return total
    host = F.coalesce(url_netloc(url), F.lit(""))
    total = (
        total + _points(contains_any(host, domains), 15)
        + _points(contains_any(low, L.TOPIC_ARTICLE_PARTS), 5)
        - _points(contains_any(low, L.TOPIC_OFF_TERMS), 10)
    )
    return F.greatest(F.lit(0), total)


def threshold_for(source_type: Column, thresholds: Mapping[str, int] = L.TOPIC_THRESHOLDS, default: int = L.TOPIC_DEFAULT_THRESHOLD) -> Column:
    out = F.lit(default)
    for name, value in thresholds.items():
        out = F.when(source_type == name, F.lit(value)).otherwise(out)
    return out


def topic_url_relevant(url, source_type: Column, *, permissive: bool = False) -> Column:
    low = F.lower(text(url))
    if permissive:
        score = score_topic_url(url, simple=True)
        terms = [*L.TOPIC_REQUIRED_PERMISSIVE, "news", "article"]
        limit = threshold_for(source_type, L.TOPIC_THRESHOLDS_PERMISSIVE)
    else:
        score, terms, limit = score_topic_url(url), L.TOPIC_REQUIRED, threshold_for(source_type)
    return (score >= limit) | contains_any(low, terms)


def score_link_priority(title, description, page) -> Column:
    t = F.lower(F.concat_ws(" ", text(title), text(description)))
    p = col(page)
    return (
        _points(contains_any(t, ["phone", "call", "contact"]), 10)
        + F.when(t.contains("scrap metal"), 8).otherwise(_points(contains_any(t, ["scrap", "recycling", "salvage"]), 5))
        + F.when(p.isin(2, 3), 3).otherwise(_points(p.isin(4, 5), 1))
    )
