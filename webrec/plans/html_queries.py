"""Queries for HTML extraction."""

from pyspark.sql import functions as F

from webrec.functions import html as H
from webrec.functions.html_select import first_text, html_select_all
from webrec.operators import extraction as X
from webrec.plans import sqltext as S
from webrec.plans.inputs import customers, table, view, with_views
from webrec.plans.registry import query

DROP = "script|style|nav|header|footer|aside"
CP = with_views("company_pages")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


query("scan_pages", "SELECT page_id, url, CAST(length(html) AS BIGINT) AS html_chars FROM pages WHERE html IS NOT NULL AND html <> ''")(
    lambda spark, sf_dir: X.scan_pages(_pages(spark, sf_dir)).select("page_id", "url", F.length("html").cast("bigint").alias("html_chars"))
)

query("html_to_text", f"SELECT page_id, {S.plain(S.without('html', DROP))} AS page_text FROM pages")(
    lambda spark, sf_dir: _pages(spark, sf_dir).select("page_id", H.html_to_text("html").alias("page_text"))
)

_BARE = S.without("html", DROP)
# an unclosed body reaches to the end
_BODY = S.plain(f"regexp_extract({_BARE}, '(?is)<body\\b[^>]*>(.*)', 1)")
_ARTICLE = S.plain(S.inner(_BARE, "article"))
query(
    "html_main_text",
    f"SELECT page_id, CASE WHEN length({_ARTICLE}) > 1500 THEN {_ARTICLE} ELSE {_BODY} END AS main_text FROM pages",
)(lambda spark, sf_dir: _pages(spark, sf_dir).select("page_id", H.html_main_text("html", 1500).alias("main_text")))

_NC = "regexp_replace(html, '<!--.*?-->', ' ', 'gs')"


def _texts(tag):
    return f"array_to_string([t for t in [{S.plain('x')} for x in regexp_extract_all({_NC}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)] if t <> ''], ' ')"


_A = (
    f"array_to_string([{S.plain('x')} || ' (' || regexp_extract(x, 'href=\"([^\"]*)', 1) || ')' "
    f"for x in regexp_extract_all({_NC}, '(?is)<a\\b[^>]*>.*?</a\\s*>')], ' ')"
)
query(
    "html_tag_texts",
    f"SELECT page_id, trim(regexp_replace(concat_ws(' ', {_texts('h1')}, {_texts('div')}, {_texts('p')}, {_A}), ' +', ' ', 'g')) AS tag_texts FROM pages",
)(lambda spark, sf_dir: _pages(spark, sf_dir).select("page_id", H.html_tag_texts("html", ["h1", "div", "p", "a"]).alias("tag_texts")))

_LINKS = """SELECT page_id, CAST(pos AS BIGINT) AS pos,
 CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href ELSE href END AS link_url, anchor
 FROM (SELECT page_id, url, unnest(range(len(h))) AS pos, unnest(h) AS href, unnest(a) AS anchor FROM (
   SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS h, regexp_extract_all(html, '<a href="[^"]*">(.*?)</a>', 1) AS a FROM pages))"""
query("html_links", _LINKS)(
    lambda spark, sf_dir: X.html_links(_pages(spark, sf_dir)).withColumn("pos", F.col("pos").cast("bigint"))
)


@query("html_links_udtf", _LINKS.replace("CASE WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]+') || href ELSE href END AS link_url", "href"))
def html_links_udtf(spark, sf_dir):
    X.register_links_udtf(spark)
    return spark.sql(
        "SELECT p.page_id, CAST(l.pos AS BIGINT) AS pos, l.href, l.anchor FROM {pages} p, LATERAL html_links(p.html) l",
        pages=_pages(spark, sf_dir).select("page_id", "html"),
    )


query("html_name", f"SELECT page_id, {S.plain(S.inner('html', 'h1'))} AS page_name FROM pages")(
    lambda spark, sf_dir: _pages(spark, sf_dir).select("page_id", H.html_name("html").alias("page_name"))
)

# a third of the pages lose their h1, a third h1 and title
_NAMED = """CASE page_id % 3 WHEN 1 THEN replace(replace(replace(html, '<h1>', '<h5>'), '</h1>', '</h5>'), '</title>', ' - Contact us today</title>')
 WHEN 2 THEN replace(replace(replace(html, '<h1>', '<h5>'), '<title>', '<x>'), '</title>', '</x>') ELSE html END"""


def _sized(x):
    return f"(SELECT CASE WHEN length(v) BETWEEN 3 AND 100 AND length(u) BETWEEN 3 AND 100 THEN v END FROM (SELECT {x} AS u, trim(regexp_replace(regexp_replace({x}, '(?i)\\b(?:Home Page|Homepage|Welcome to|About Us|Contact Us|Privacy Policy|Terms of Service|Site Map|Sitemap)\\b', '', 'g'), '\\s+', ' ', 'g')) AS v))"


query(
    "html_company_name",
    f"""SELECT page_id, coalesce({_sized(S.plain(S.inner('h', 'h1')))}, {_sized(S.plain(S.inner('h', 'title')))},
        CASE WHEN length(b) BETWEEN 3 AND 50 THEN upper(b[1]) || b[2:] END) AS company
        FROM (SELECT page_id, {_NAMED} AS h, split_part(regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), 'www[.]', ''), '.', 1) AS b0,
        CASE WHEN contains(b0, '-') THEN array_to_string([upper(w[1]) || w[2:] for w in string_split(b0, '-')], ' ') ELSE b0 END AS b FROM pages)""",
)(lambda spark, sf_dir: _pages(spark, sf_dir).select("page_id", H.html_company_name(F.expr(_NAMED), "url").alias("company")))

query(
    "clean_company_name",
    f"SELECT page_id, {_sized('x')} AS company FROM (SELECT page_id, 'Welcome to ' || regexp_extract(html, '<title>(.*?)</title>', 1) || ' homepage' AS x FROM pages)",
)(
    lambda spark, sf_dir: _pages(spark, sf_dir).select(
        "page_id",
        H.clean_company_name(F.concat(F.lit("Welcome to "), F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit(" homepage"))).alias("company"),
    )
)

_DESC = "CASE WHEN page_id % 2 = 0 THEN replace(html, '<head>', '<head><meta name=\"description\" content=\"Page ' || CAST(page_id AS STRING) || ' of bits &amp; bobs\">') ELSE html END"
query(
    "html_description",
    f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id || ' of bits & bobs' ELSE {S.plain(S.without('html', 'script|style'))} END AS description,
        CASE WHEN page_id % 2 = 0 THEN 'Page ' || page_id || ' of bits & bobs' ELSE {S.plain(S.inner('html', 'div'))} END AS strict_description FROM pages""",
)(
    lambda spark, sf_dir: _pages(spark, sf_dir).select("page_id", F.expr(_DESC).alias("html")).select(
        "page_id", H.html_description("html").alias("description"),
        H.html_description_strict("html", F.rpad(H.tag_text(F.col("html"), "div"), F.greatest(F.length(H.tag_text(F.col("html"), "div")), F.lit(20)), F.lit(" "))).alias("strict_description"),
    ).withColumn("strict_description", F.rtrim("strict_description"))
)

_SOC = """replace(html, '</footer>', '<a href="https://twitter.com/y' || CAST(page_id AS STRING) || '">t</a><a href="//wa.me/' || CAST(page_id AS STRING) || '">w</a><a href="https://twitter.com/y' || CAST(page_id AS STRING) || '">again</a></footer>')"""
query(
    "html_social_links",
    "SELECT page_id, 'https://twitter.com/y' || page_id || '|' || split_part(url, ':', 1) || '://wa.me/' || page_id AS social, split_part(url, ':', 1) || '://wa.me/' || page_id AS whatsapp FROM pages",
)(
    lambda spark, sf_dir: _pages(spark, sf_dir).select("page_id", H.social_links(F.expr(_SOC), "url").alias("s")).select(
        "page_id", F.array_join("s", "|").alias("social"), F.array_join(H.whatsapp_links(F.col("s")), "|").alias("whatsapp"))
)

_DIR = """CASE page_id % 3 WHEN 0 THEN replace(html, '</footer>', '<a href="https://facebook.com/a">f</a><a href="https://plain.org/">p</a><a href="https://scrap' || CAST(page_id AS STRING) || '.com/">s</a></footer>')
 WHEN 1 THEN replace(html, '</footer>', '<a href="https://plain' || CAST(page_id AS STRING) || '.org/">p</a><a href="https://other.org/">o</a></footer>') ELSE html END"""
query(
    "directory_company_site",
    "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://scrap' || page_id || '.com/' WHEN 1 THEN 'https://plain' || page_id || '.org/' END AS site FROM pages",
)(lambda spark, sf_dir: _pages(spark, sf_dir).select("page_id", H.directory_company_site(F.expr(_DIR), "url").alias("site")))

# -- extraction with selectors ------------------------------------------------
query(
    "html_select",
    """SELECT page_id, CAST(len(regexp_extract_all(html, '<li><a href="/')) AS BIGINT) AS nav_links,
       regexp_extract(html, '<li><a href="([^"]*)', 1) AS first_href,
       trim(regexp_replace(replace(replace(regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1), '&amp;', '&'), '&middot;', '·'), '\\s+', ' ', 'g')) AS ad_text FROM pages""",
)(
    lambda spark, sf_dir: _pages(spark, sf_dir).select(
        "page_id", html_select_all("html", {"links": 'nav li a[href^="/"]', "ad": "div.ad"}, ("text", "attrs")).alias("s")
    ).select(
        "page_id", F.size("s.links").cast("bigint").alias("nav_links"),
        F.get(F.col("s.links"), F.lit(0))["attrs"]["href"].alias("first_href"), first_text(F.col("s.ad")).alias("ad_text"),
    )
)

_SERP = """'<ol><li class="b_algo"><h2><a href="https://yard' || CAST(c_custkey AS STRING) || '.com/">Yard &amp; Co ' || CAST(c_custkey AS STRING)
 || '</a></h2><p>Buys <b>' || lower(c_mktsegment) || '</b> scrap</p></li><li class="b_algo"><h2><a href="/rel">no</a></h2></li><li class="ad"><h2><a href="https://ad.com">ad</a></h2></li><li class="x b_algo"><h2><a href="http://two.org/' || CAST(c_custkey AS STRING) || '">Two</a></h2></li></ol>'"""
query(
    "html_serp_items",
    """SELECT c_custkey AS page_id, CAST(0 AS BIGINT) AS pos, 'Yard & Co ' || c_custkey AS title, 'https://yard' || c_custkey || '.com/' AS url,
       'Yard & Co ' || c_custkey || ' Buys ' || lower(c_mktsegment) || ' scrap' AS snippet FROM customer
       UNION ALL SELECT c_custkey, 2, 'Two', 'http://two.org/' || c_custkey, 'Two' FROM customer""",
)(
    lambda spark, sf_dir: X.html_serp_items(
        customers(spark, sf_dir).select(F.col("c_custkey").alias("page_id"), F.expr(_SERP).alias("html"))
    ).withColumn("pos", F.col("pos").cast("bigint"))
)

_CARDS = """'<div class="company big"><h3>' || c_mktsegment || ' Yard ' || CAST(c_custkey AS STRING) || '</h3><p class="address">12 Main St, Houston</p><span class="phone">Tel 713-868-' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0')
 || '</span><span class="rating">4.5 Star rating</span><a class="category">Metal</a><a class="category">Scrap</a><i class="price">$$</i></div><div class="company"><h3>XYZ Scrap Yard</h3></div><div class="company"><p>none</p></div><div class="other"><h3>No</h3></div>'"""
query(
    "html_listing_cards",
    """SELECT c_custkey AS page_id, CAST(0 AS BIGINT) AS pos, c_mktsegment || ' Yard ' || c_custkey AS name, '12 Main St, Houston' AS address,
       '(713) 868-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone, CAST(4.5 AS DOUBLE) AS rating, 'Metal|Scrap' AS categories, '$$' AS price_range FROM customer
       UNION ALL SELECT c_custkey, 1, 'XYZ Scrap Yard', '', NULL, NULL, '', NULL FROM customer""",
)(
    lambda spark, sf_dir: X.html_listing_cards(
        customers(spark, sf_dir).select(F.col("c_custkey").alias("page_id"), F.lit("").alias("url"), F.expr(_CARDS).alias("html"))
    ).withColumn("pos", F.col("pos").cast("bigint")).withColumn("categories", F.array_join("categories", "|"))
)

_META = """'<article><h1>Title ' || CAST(doc_id AS STRING) || '</h1><span class="byline">By ' || source || '</span><time datetime="2024-01-0' || CAST(doc_id % 9 + 1 AS STRING) || 'T10:00:00Z">x</time><meta name="description" content="About ' || lang || '"></article>'"""
query(
    "html_article_meta",
    """SELECT doc_id, 'Title ' || doc_id AS title, 'By ' || source AS author, TIMESTAMP '2024-01-01 10:00:00' + CAST(doc_id % 9 AS INT) * INTERVAL 1 DAY AS published_at,
       'About ' || lang AS description FROM documents""",
)(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", F.expr(_META).alias("html"))
    .select("doc_id", X.html_article_meta("html").alias("m")).select("doc_id", "m.*")
)

# -- JSON-LD and company pages ------------------------------------------------
query(
    "parse_json_ld",
    f"""{CP} SELECT p.page_id, CASE page_id % 5 WHEN 0 THEN 'LD Yard ' || page_id WHEN 1 THEN 'Org ' || page_id END AS name,
        CASE WHEN page_id % 5 = 0 THEN '713-868-' || n4 END AS telephone, CASE WHEN page_id % 5 = 1 THEN 'org' || page_id || '@ld.org' END AS email,
        CASE WHEN page_id % 5 = 0 THEN '77008' END AS postal, CASE WHEN page_id % 5 = 1 THEN 'Canada' END AS country FROM company_pages p""",
)(
    lambda spark, sf_dir: view(spark, sf_dir, "company_pages").select("page_id", H.parse_json_ld("html").alias("ld")).select(
        "page_id", "ld.name", "ld.telephone", "ld.email", F.col("ld.postalCode").alias("postal"), F.col("ld.addressCountry").alias("country"))
)
query(
    "json_ld_deep_phone",
    f"""{CP} SELECT page_id, CASE WHEN page_id % 5 IN (0, 3) THEN '713-868-' || n4 END AS phone,
        CASE WHEN page_id % 5 = 0 THEN '77008' END AS zip FROM company_pages""",
)(
    lambda spark, sf_dir: view(spark, sf_dir, "company_pages").select(
        "page_id", H.json_ld_deep_phone("html").alias("phone"), H.json_ld_deep_value("html", ["postalCode", "zip"]).alias("zip"))
)
query(
    "html_opening_hours",
    f"""{CP} SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'Monday,Tuesday: 08:00-17:00; Friday: 09:00-12:00' WHEN 2 THEN 'Mon-Fri 8-5; Sat 9-1' END AS hours FROM company_pages""",
)(
    lambda spark, sf_dir: view(spark, sf_dir, "company_pages").select("page_id", H.parse_json_ld("html").alias("ld"), "html")
    .select("page_id", H.html_opening_hours("html", F.col("ld.hours")).alias("hours"))
)
query(
    "html_address",
    f"""{CP} SELECT page_id, CASE page_id % 5 WHEN 0 THEN '1 Main St' WHEN 2 THEN 'Houston , TX 77008' END AS street,
        CASE page_id % 5 WHEN 0 THEN nullif(city, '') WHEN 2 THEN 'Houston' END AS city, CASE WHEN page_id % 5 IN (0, 2) THEN 'TX' END AS region,
        CASE WHEN page_id % 5 IN (0, 2) THEN '77008' END AS postal, CASE page_id % 5 WHEN 1 THEN 'Canada' ELSE 'United States' END AS country
        FROM (SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'Houston' WHEN 1 THEN 'Dallas' WHEN 2 THEN 'Chicago' WHEN 3 THEN 'New York'
          WHEN 4 THEN 'Fresno' WHEN 5 THEN 'Miami' WHEN 6 THEN 'Erie' WHEN 7 THEN 'Boise' END AS city FROM company_pages)""",
)(
    lambda spark, sf_dir: view(spark, sf_dir, "company_pages").select("page_id", H.parse_json_ld("html").alias("ld"), "html")
    .select("page_id", H.html_address("html", F.col("ld"), "United States").alias("a")).select("page_id", "a.*")
)
query(
    "html_price_rows",
    f"{CP} SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Copper $' || (page_id % 9 + 1) || '.50/lb' ELSE '' END AS price_rows FROM company_pages",
)(
    lambda spark, sf_dir: view(spark, sf_dir, "company_pages").select("page_id", F.array_join(H.html_price_rows("html"), "|").alias("price_rows"))
)
_PH = S.distinct("""list_filter([CASE WHEN page_id % 5 IN (0, 3) THEN '(713) 868-' || n4 END, CASE WHEN page_id % 2 = 0 THEN '(713) ' || (200 + page_id % 700) || '-' || n4 END,
 CASE WHEN page_id % 7 = 0 THEN '(713) 681-' || n4 END], lambda v: v IS NOT NULL)""")
_EM = "list_filter([CASE WHEN page_id % 5 = 1 THEN 'org' || page_id || '@ld.org' END, CASE WHEN page_id % 6 = 1 THEN 'Info' || page_id || '@yard.org' END], lambda v: v IS NOT NULL)"
query(
    "extract_company",
    f"""{CP} SELECT * FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'LD Yard ' || page_id WHEN 1 THEN 'Org ' || page_id ELSE coalesce(name, '| Home of scrap') END AS name,
        array_to_string({_PH}, '|') AS phones, array_to_string({_EM}, '|') AS emails,
        'https://facebook.com/yard' || page_id || '|https://wa.me/1' || page_id AS social_links,
        CASE page_id % 5 WHEN 0 THEN 'Monday,Tuesday: 08:00-17:00; Friday: 09:00-12:00' WHEN 2 THEN 'Mon-Fri 8-5; Sat 9-1' END AS opening_hours,
        CASE WHEN page_id % 3 = 0 THEN 'Copper $' || (page_id % 9 + 1) || '.50/lb' END AS table_price
        FROM company_pages) WHERE phones <> '' OR emails <> ''""",
)(
    lambda spark, sf_dir: X.extract_company(view(spark, sf_dir, "company_pages")).select(
        "page_id", "name", F.array_join("phones", "|").alias("phones"), F.array_join("emails", "|").alias("emails"),
        F.array_join("social_links", "|").alias("social_links"), "opening_hours",
        F.when(F.col("page_id") % 3 == 0, F.array_join("material_prices", "|")).alias("table_price"))
)
query(
    "extract_article",
    f"""SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS source, regexp_extract(html, 'lang="([^"]*)', 1) AS language,
        {S.plain(S.inner('html', 'h1'))} AS title, content FROM (SELECT *, CASE WHEN length({_ARTICLE}) > 100 THEN {_ARTICLE} ELSE {_BODY} END AS content FROM pages)
        WHERE length(content) >= 100""",
)(
    lambda spark, sf_dir: X.extract_article(X.scan_pages(_pages(spark, sf_dir))).select("page_id", "url", "source", "language", "title", "content")
)


@query(
    "register_extractor",
    """SELECT page_id, CASE WHEN contains(regexp_extract(url, '://([^/?#]*)', 1), '.example.com') THEN 'titles' ELSE 'langs' END AS extractor,
       CASE WHEN contains(regexp_extract(url, '://([^/?#]*)', 1), '.example.com') THEN regexp_extract(html, '<title>(.*?)</title>', 1) ELSE regexp_extract(html, 'lang="([^"]*)', 1) END AS value FROM pages
       WHERE regexp_matches(url, '://[^/]*[.]example[.](com|net)')""",
)
def register_extractor(spark, sf_dir):
    import re

    table = X.register_extractor({}, "titles", lambda url, html: {"value": re.search("<title>(.*?)</title>", html).group(1)}, ("example.com",))
    table = X.register_extractor(table, "langs", lambda url, html: {"value": re.search('lang="([^"]*)', html).group(1)}, ("example.net",))
    return X.run_extractors(_pages(spark, sf_dir), table, ["value"])


