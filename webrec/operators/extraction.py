"""Whole-record extraction over a page table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions import company_blocks as B
from webrec.functions import contacts as C
from webrec.functions import html as H
from webrec.functions.common import blank_to_null, cut, filled, filled_array, in_domains, let
from webrec.functions.html_select import compile_selector, first_text, html_select, html_select_all, select_html
from webrec.functions.phone_plans import page_phones, region_of
from webrec.functions.text import extract_inline_prices, materials_string
from webrec.functions.urls import absolute_url, url_host, url_netloc
from webrec.operators.contact_pages import contact_links, fill_from_contact_pages


def scan_pages(pages: DataFrame) -> DataFrame:
    """Page table without empty pages."""
    return pages.where(filled("html"))


def html_links(pages: DataFrame, *keep: str) -> DataFrame:
    """One row per link of a page, resolved against the page URL."""
    keep = keep or ("page_id",)
    links = pages.select(*keep, "url", F.posexplode(H.link_array("html")).alias("pos", "link"))
    return links.select(*keep, "pos", absolute_url("url", F.col("link.href")).alias("link_url"), F.col("link.anchor").alias("anchor"))


def html_serp_items(pages: DataFrame, block: str = "li.b_algo", link: str = "h2 a", snippet_chars: int | None = None) -> DataFrame:
    """Result blocks of a saved search page: title, url, snippet."""
    hits = pages.select("page_id", F.posexplode(html_select("html", block)).alias("pos", "hit"))
    links = F.filter(F.slice(html_select("hit.html", link, ("text", "attrs")), 1, 1), lambda a: a["attrs"]["href"].startswith("http"))
    item = F.transform(links, lambda a: F.struct(a["text"].alias("title"), a["attrs"]["href"].alias("url")))
    return hits.select("page_id", "pos", F.inline(item), cut(F.col("hit.text"), snippet_chars).alias("snippet"))


# fixed values: selectors of listing pages by site
LISTING_SELECTORS = {
    "yelp": {"card": '[data-testid="serp-ia-card"], .businessCard', "name": "h3 a span, .businessName span, h4 a span", "address": '[data-testid="address"], .address',
             "phone": '[data-testid="phone"], .phone, .biz-phone', "rating": '.rating, [aria-label*="star"]', "categories": ".category-str-list a, .categories a", "price": ".price-range, .priceRange"},
    "yellowpages": {"card": ".result, .listing", "name": ".business-name a, .listing-title a, h3 a, .n a", "address": ".adr, .address, .street-address, .locality",
                    "phone": ".phones, .phone", "rating": ".rating, .result-rating", "categories": ".categories a", "price": ".price-range"},
    "default": {"card": "div.business, div.listing, div.result, div.place, div.company", "name": "h3, h2, .name, a", "address": ".address",
                "phone": ".phone", "rating": ".rating", "categories": ".category", "price": ".price"},
}


def html_listing_cards(pages: DataFrame, site: str = "default", selectors=None) -> DataFrame:
    """Repeated listing blocks as rows; blocks without a name are dropped."""
    s = dict((selectors or LISTING_SELECTORS)[site])
    cards = pages.select("page_id", "url", F.posexplode(html_select("html", s.pop("card"), ("html",))).alias("pos", "card"))
    named = F.filter(F.array(html_select_all(F.col("card.html"), s, ("text", "attrs"))), lambda p: filled(first_text(p["name"])))
    parts = cards.select("page_id", "pos", F.inline(named))
    rating_text = F.concat_ws(" ", first_text(F.col("rating")), F.get(F.col("rating"), F.lit(0))["attrs"]["aria-label"])
    return parts.select(
        "page_id", "pos",
        C.clean_text(first_text(F.col("name"))).alias("name"),
        C.clean_text(first_text(F.col("address"))).alias("address"),
        F.get(C.extract_phones(first_text(F.col("phone"))), F.lit(0)).alias("phone"),
        F.regexp_extract(F.lower(rating_text), r"(\d+\.?\d*)\s*star", 1).try_cast("double").alias("rating"),
        F.transform("categories", lambda h: h["text"]).alias("categories"),
        first_text(F.col("price")).alias("price_range"),
    )


# fixed values: selectors of article metadata
ARTICLE_META = {
    "title": "h1, .article-title, .post-title, .entry-title, title",
    "author": '.author, .byline, [rel="author"], .article-author',
    "date": "time, .published, .date, .article-date, [datetime]",
    "description": 'meta[name="description"], .article-summary, .excerpt',
}


def html_article_meta(html: Column | str, selectors=ARTICLE_META) -> Column:
    """Struct title, author, published_at, description. Within a list the
    first selector with a hit decides, so each alternative is asked apart."""
    asked = {f"{k}{i}": alt.strip() for k, alts in selectors.items() for i, alt in enumerate(alts.split(","))}
    names = {k: [n for n in asked if n.rstrip("0123456789") == k] for k in selectors}
    found = html_select_all(html, asked, ("text", "attrs"))

    def build(f):
        hit = {k: F.coalesce(*[F.get(f[n], F.lit(0)) for n in ns]) for k, ns in names.items()}
        stamp = F.coalesce(F.nullif(hit["date"]["attrs"]["datetime"], F.lit("")), hit["date"]["text"])
        return F.struct(
            hit["title"]["text"].alias("title"), hit["author"]["text"].alias("author"),
            F.try_to_timestamp(stamp).alias("published_at"),
            F.coalesce(F.nullif(hit["description"]["attrs"]["content"], F.lit("")), hit["description"]["text"]).alias("description"),
        )

    return let(found, build)


def extract_article(pages: DataFrame, min_chars: int = L.MIN_ARTICLE_LENGTH, language: str | None = None) -> DataFrame:
    """Article rows from pages by native expressions; kept iff there is a title
    and enough text. The html column ends here."""
    lang = F.lit(language) if language else F.nullif(F.regexp_extract("html", r"(?i)<html\b[^<>]*\blang\s*=\s*[\"']([^\"']*)", 1), F.lit(""))
    body = F.struct(
        F.coalesce(H.tag_text(F.col("html"), "h1"), H.tag_text(F.col("html"), "title")).alias("title"),
        H.html_main_text("html", min_chars).alias("content"),
    )
    # a filter after the projection would be pushed below it and repeat the
    # text work; inside the generator each page is worked on once
    good = F.filter(F.array(body), lambda x: filled(x["title"]) & (F.length(x["content"]) >= min_chars))
    return pages.select(
        "page_id", "url", url_netloc("url").alias("source"), lang.alias("language"),
        H.meta_content("html", "description").alias("summary"), F.inline(good),
    ).select("*", F.lit(False).alias("is_processed"), F.lit(False).alias("is_published"))


def extract_company(pages: DataFrame, fallback_country: str = "", country: Column | None = None, contact_pages: bool = False, blocks: bool = False) -> DataFrame:
    """Company rows from pages, kept iff a phone or an e-mail is there.

    ``country`` (a column; else ``fallback_country``) chooses the plan by which
    phones are read. Name, address and hours come from JSON-LD, then from the
    page's marked-up blocks where ``blocks`` is set (one more pass in Python). With ``contact_pages`` a
    page without phones or e-mails takes those of the contact pages it links
    to, if they are in the table; then rows without html meet."""
    country = F.lit(fallback_country) if country is None else country
    contacts = F.struct(page_phones("html", region_of(country)).alias("phones"), C.extract_emails("html").alias("emails"))
    good = F.array(contacts)
    if not contact_pages:
        # pages without a contact end here, before the rest of the work
        good = F.filter(good, lambda x: filled_array(x["phones"]) | filled_array(x["emails"]))
    kept = pages.select("page_id", "url", "html", country.alias("_country"), F.inline(good))
    kept = kept.withColumn("_ld", H.parse_json_ld("html")).withColumn("_social", H.social_links("html", "url"))
    name = H.html_name("html", F.col("_ld.name"))
    address = H.html_address("html", F.col("_ld"), F.col("_country"))
    hours = H.html_opening_hours("html", F.col("_ld.hours"))
    if blocks:
        kept = kept.withColumn("_blocks", B.company_blocks("html")).withColumn("_text", H.plain_text("html"))
        found = F.col("_blocks")
        name = F.coalesce(blank_to_null(F.col("_ld.name")), B.blocks_company_name(found, "html", "url"))
        parsed = B.blocks_address(found, F.col("_text"), F.col("_country"))
        address = let(F.struct(address.alias("a"), parsed.alias("b")), lambda v: F.when(H.has_address(v["a"]), v["a"]).otherwise(v["b"]))
        hours = F.coalesce(H.json_ld_hours(F.col("_ld.hours")), B.blocks_hours(found), hours)
    out = kept.select(
        "page_id", "url", "phones", "emails", name.alias("name"), address.alias("_a"),
        H.whatsapp_links(F.col("_social")).alias("whatsapp"), F.col("_social").alias("social_links"), hours.alias("opening_hours"),
        materials_string("html").alias("materials"),
        H.html_price_rows("html").alias("_rows"), "html",
        H.html_description("html").alias("description"),
    ).select(
        "page_id", "url", "name", F.col("_a.street").alias("street_address"), F.col("_a.city").alias("city"),
        F.col("_a.region").alias("region"), F.col("_a.postal").alias("postal_code"), F.col("_a.country").alias("country"),
        "phones", "emails", "whatsapp", "social_links", "opening_hours", "materials",
        F.when(F.size("_rows") > 0, F.col("_rows")).otherwise(extract_inline_prices("html")).alias("material_prices"),
        "description", *([contact_links("html", "url").alias("contact_urls")] if contact_pages else []),
    )
    if contact_pages:
        filled_in = fill_from_contact_pages(out).drop("contact_urls", "from_contact_page")
        out = filled_in.where(filled_array("phones") | filled_array("emails"))
    return out.withColumnRenamed("url", "website")


# -- named extractors ---------------------------------------------------------
Extractor = Callable[[str, str], dict]
Extractors = dict[str, tuple[Extractor, tuple[str, ...]]]


def register_extractor(table: Extractors, name: str, fn: Extractor, hosts: tuple[str, ...]) -> Extractors:
    """The table with a page parser for hosts (equal to or below the listed names) added."""
    return table | {name: (fn, hosts)}


def run_extractors(pages: DataFrame, extractors: Extractors, fields: list[str], default: str | None = None) -> DataFrame:
    """Each page goes to the extractor of its host; one Arrow-batched pass."""
    table = dict(extractors)
    host = url_host("url", strip_port=True)
    chosen = F.lit(default)
    for name, (_, hosts) in table.items():
        chosen = F.when(F.coalesce(in_domains(host, list(hosts)), F.lit(False)), F.lit(name)).otherwise(chosen)
    slim = pages.select("page_id", "url", "html", chosen.alias("extractor")).where("extractor is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [table[e][0](u, h or "") for e, u, h in zip(b["extractor"], b["url"], b["html"])]
            yield pd.DataFrame({
                "page_id": b["page_id"], "extractor": b["extractor"],
                **{f: pd.Series([r.get(f) for r in rows], index=b.index, dtype="object") for f in fields},
            })

    schema = "page_id bigint, extractor string, " + ", ".join(f"{f} string" for f in fields)
    return slim.mapInPandas(run, schema)


def register_links_udtf(spark, name: str = "html_links") -> None:
    """Table function form for SQL: ``FROM pages, LATERAL html_links(html)``."""
    wanted = compile_selector("a[href]")

    @F.udtf(returnType="pos int, href string, anchor string")
    class Links:
        def eval(self, html: str):
            for i, hit in enumerate(select_html(html or "", {"a": wanted}, ("text", "attrs"))["a"]):
                yield i, hit["attrs"]["href"], hit["text"]

    spark.udtf.register(name, Links)
