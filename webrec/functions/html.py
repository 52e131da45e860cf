"""Fields of HTML pages by native pattern expressions. Flat tags only: nested
containers and class selectors go through ``html_select``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions.common import (
    all_matches, any_of, at_most, blank_to_null, col, contains_any, cut, filled, first_match, first_of, let, squeeze, text,
)
from webrec.functions.html_select import main_text, page_text
from webrec.functions.urls import absolute_url, url_netloc

# fixed values: named characters decoded by text extraction ("&amp;" last)
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"),
    ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"), ("&bull;", "•"), ("&ndash;", "–"),
    ("&mdash;", "—"), ("&hellip;", "…"), ("&laquo;", "«"), ("&raquo;", "»"),
]


def unescape(c: Column) -> Column:
    """Decode numeric and the common named character references."""
    def numeric(t: Column, pattern: str, base: int) -> Column:
        def decode(x):
            refs = F.array_distinct(F.regexp_extract_all(x, F.lit(pattern), F.lit(0)))
            def step(acc, ref):
                code = F.lpad(F.conv(F.regexp_extract(ref, pattern, 1), base, 16), 8, "0")
                return F.replace(acc, ref, F.decode(F.unhex(code), "UTF-32"))
            return F.aggregate(refs, x, step)
        return let(t, decode)

    def named(x):
        out = F.when(x.contains("&#"), numeric(numeric(x, r"&#(\d{1,6});", 10), r"&#[xX]([0-9A-Fa-f]{1,5});", 16)).otherwise(x)
        for name, char in ENTITIES:
            out = F.replace(out, F.lit(name), F.lit(char))
        return F.replace(out, F.lit("&amp;"), F.lit("&"))

    # most strings have no reference at all
    return let(c, lambda x: F.when(x.contains("&"), named(x)).otherwise(x))


def up_to_last(c: Column, end: str, fn) -> Column:
    """``fn`` of the part up to the last match of ``end``, and the rest as it
    is. An opening without an end behind it matches nothing, and trying each
    of them to the end of the page would cost its length squared."""
    def parts(x):
        return let(F.regexp_extract(x, rf"(?is)^.*{end}", 0), lambda h: F.concat(fn(h), F.substr(x, F.length(h) + 1)))

    return let(c, parts)


def without_comments(html: Column) -> Column:
    return F.when(html.contains("<!--"), up_to_last(html, "-->", lambda h: F.regexp_replace(h, r"(?s)<!--.*?-->", " "))).otherwise(html)


def drop_raw(html: Column) -> Column:
    """Comments, scripts and styles out."""
    out = without_comments(html)
    for tag in ("script", "style"):
        out = up_to_last(out, rf"</{tag}\s*>", lambda h, t=tag: F.regexp_replace(h, rf"(?is)<{t}\b.*?</{t}\s*>", " "))
    return out


def _tags_to_text(fragment: Column) -> Column:
    return unescape(squeeze(F.regexp_replace(fragment, r"<[^<>]*>", " ")))


def html_to_text(html: Column | str, drop: Sequence[str] = L.DROP_TAGS) -> Column:
    """Visible text: dropped elements out, tags to space, one space between.
    Elements that nest (a menu in a header) need the tree."""
    return page_text(html, drop)


def elements(html: Column, tag: str, group: int = 0) -> Column:
    """All flat elements of a tag, whole (0) or inner (1). The text behind the
    last end tag is cut off first: open tags there match nothing, and trying
    each of them to the end of the page costs its length squared."""
    upto = F.regexp_extract(html, rf"(?is)^.*</{tag}\s*>", 0)
    return all_matches(upto, rf"(?is)<{tag}\b[^<>]*>(.*?)</{tag}\s*>", group)


def tag_inner(html: Column, tag: str) -> Column:
    """Inner HTML of the first such element."""
    upto = F.regexp_extract(html, rf"(?is)^.*</{tag}\s*>", 0)
    return first_match(upto, rf"(?is)<{tag}\b[^<>]*>(.*?)</{tag}\s*>")


def tag_text(html: Column, tag: str) -> Column:
    return blank_to_null(_tags_to_text(tag_inner(html, tag)))


def html_main_text(html: Column | str, min_chars: int = L.MIN_ARTICLE_LENGTH) -> Column:
    """Text of the first content container that is long enough, else of the
    body; of a page without body tags all behind the head."""
    return main_text(html, L.CONTENT_SELECTORS, L.DROP_TAGS, min_chars)


def html_tag_texts(html: Column | str, tags: Sequence[str] = L.CONTENT_TAGS) -> Column:
    """Texts of the listed tags in list order; ``a`` as ``text (href)``."""
    h = without_comments(text(html))
    parts = []
    for tag in tags:
        texts = F.transform(elements(h, tag, 1), lambda x: _tags_to_text(x))
        if tag == "a":
            whole = elements(h, "a")
            def one(a):
                t, href = _anchor(a), _href(a)
                return F.when((t != "") & (href != ""), F.concat(t, F.lit(" ("), unescape(href), F.lit(")"))).otherwise(t)
            texts = F.transform(whole, one)
        parts.append(F.array_join(F.filter(texts, lambda t: t != ""), " "))
    return F.trim(F.regexp_replace(F.concat_ws(" ", *parts), " +", " "))


def _href(a: Column) -> Column:
    """Link of a whole anchor, quoted or not; empty where it has none."""
    found = F.regexp_extract(a, r"""(?is)^<a\b[^<>]*?\bhref\s*=\s*("[^"<>]*"|'[^'<>]*'|[^\s"'<>]+)""", 1)
    return F.regexp_replace(found, r"^[\"']|[\"']$", "")


def _anchor(a: Column) -> Column:
    return _tags_to_text(F.regexp_replace(a, r"(?is)^<a\b[^<>]*>|</a\s*>$", ""))


def link_array(html: Column | str) -> Column:
    """Array of {href, anchor} in page order: whole anchors in one pass, their
    parts from the short hits."""
    links = F.transform(elements(without_comments(text(html)), "a"), lambda a: F.struct(unescape(_href(a)).alias("href"), _anchor(a).alias("anchor")))
    return F.filter(links, lambda x: x["href"] != "")


def social_links(html: Column | str, base: Column | str, providers=L.SOCIAL_PROVIDERS, limit: int | None = None) -> Column:
    """Distinct resolved links to social providers, first ones in page order."""
    full = F.transform(link_array(html), lambda x: absolute_url(base, x["href"]))
    return at_most(F.array_distinct(F.filter(full, lambda u: contains_any(u, providers))), limit)


def whatsapp_links(links: Column, limit: int | None = None) -> Column:
    return at_most(F.filter(links, lambda u: contains_any(u, ["wa.me", "whatsapp.com"])), limit)


def directory_company_site(html: Column | str, page_url: Column | str, deny=L.DIRECTORY_LINK_DENY, words=L.DIRECTORY_LINK_WORDS) -> Column:
    """First external link with a topic word in its host, else first external."""
    prefix = F.substring(col(page_url), 1, 20)
    ext = F.filter(
        F.transform(link_array(html), lambda x: x["href"]),
        lambda h: h.startswith("http") & ~h.startswith(prefix) & ~contains_any(F.lower(h), deny),
    )
    topical = F.filter(ext, lambda h: contains_any(F.coalesce(url_netloc(h), F.lit("")), words))
    return F.coalesce(F.get(topical, F.lit(0)), F.get(ext, F.lit(0)))


# -- meta tags ----------------------------------------------------------------
def _meta_raw(html: Column | str, key: str) -> Column:
    """content of <meta name|property=key>, either attribute order."""
    h = text(html)
    k = key.replace(":", "[:]")
    a = first_match(h, rf"(?is)<meta\b[^<>]*?(?:name|property)\s*=\s*[\"']{k}[\"'][^<>]*?content\s*=\s*[\"']([^\"']*)")
    b = first_match(h, rf"(?is)<meta\b[^<>]*?content\s*=\s*[\"']([^\"']*)[\"'][^<>]*?(?:name|property)\s*=\s*[\"']{k}[\"']")
    return F.coalesce(a, b)


def meta_content(html: Column | str, key: str) -> Column:
    return blank_to_null(F.trim(unescape(_meta_raw(html, key))))


def html_name(html: Column | str, json_ld_name: Column | None = None) -> Column:
    h = text(html)
    return F.coalesce(
        *([blank_to_null(json_ld_name)] if json_ld_name is not None else []),
        tag_text(h, "h1"), tag_text(h, "title"), meta_content(h, "og:site_name"), meta_content(h, "og:title"),
    )


def clean_company_name(name: Column | str) -> Column:
    """Boilerplate phrases out; null unless 3 to 100 characters remain."""
    n = squeeze(name)
    alt = "|".join(L.NAME_ARTIFACTS)
    n = squeeze(F.regexp_replace(n, rf"(?i)\b(?:{alt})\b", ""))
    return F.when(F.length(n).between(3, 100), n)


def title_company_name(title: Column) -> Column:
    t = F.regexp_replace(title, r"(?i)\s*[-|]\s*(?:Home|Welcome|About|Contact|Services).*$", "")
    t = F.regexp_replace(t, r"(?i)\s*[-|]\s*.*\b(?:LLC|Inc|Corp|Company|Ltd)\b.*$", "")
    t = clean_company_name(t)
    return F.when(F.length(t).between(3, 80), t)


def host_company_name(url: Column | str) -> Column:
    first = F.element_at(F.split(F.regexp_replace(url_netloc(url), r"www\.", ""), r"\."), 1)
    words = F.filter(F.split(F.regexp_replace(first, "[_-]", " "), r"\s+"), lambda w: w != "")
    named = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 100000)))), " ")
    return F.when(F.length(named).between(3, 50), named)


def html_company_name(html: Column | str, url: Column | str, selected: Column | None = None) -> Column:
    """Selector hits (h1 and title natively, class selectors passed in as
    ``selected``), then the title without suffix, meta tags, host label."""
    h = text(html)
    raw = F.array(
        tag_inner(h, "h1"), tag_inner(h, "title"), _meta_raw(h, "og:site_name"),
        _meta_raw(h, "twitter:site"), _meta_raw(h, "application-name"),
        *([selected] if selected is not None else []),
    )

    def choose(t):
        # one pass cleans all candidates; then the order decides
        fits = F.transform(t, lambda x: F.when(F.length(x).between(3, 100), clean_company_name(x)))
        metas = F.transform(F.slice(t, 3, 3), lambda x: clean_company_name(x))
        meta = F.get(F.filter(metas, lambda x: F.length(x).between(3, 80)), F.lit(0))
        at = lambda i: F.get(fits, F.lit(i))
        return F.coalesce(
            *([at(5)] if selected is not None else []),
            at(0), at(1), title_company_name(F.get(t, F.lit(1))), meta, host_company_name(url))

    return let(F.transform(raw, lambda x: _tags_to_text(x)), choose)


def html_description(html: Column | str, limit: int | None = None) -> Column:
    """Meta description, else the page text; its start where a limit is given."""
    return F.coalesce(blank_to_null(cut(meta_content(html, "description"), limit)), cut(_tags_to_text(drop_raw(text(html))), limit))


def html_description_strict(html: Column | str, about: Column | None = None) -> Column:
    """Meta description of 20 to 300 characters, else an about block of 20 to
    500 cut to 300."""
    meta = meta_content(html, "description")
    best = F.when(F.length(meta).between(20, 300), meta)
    if about is not None:
        best = F.coalesce(best, F.when(F.length(about).between(20, 500), cut(about, 300)))
    return best


# -- JSON-LD ------------------------------------------------------------------
_FIELDS = ["name", "telephone", "email"]
_ADDRESS = ["streetAddress", "addressLocality", "addressRegion", "postalCode"]


def ld_blocks(html: Column | str) -> Column:
    """Contents of the JSON-LD scripts."""
    whole = F.filter(elements(text(html), "script"), lambda s: s.rlike(r"(?is)^<script\b[^<>]*type\s*=\s*[\"'][^\"']*ld\+json"))
    return F.transform(whole, lambda s: F.regexp_replace(s, r"(?is)^<script\b[^<>]*>|</script\s*>$", ""))


def _variant_text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def json_ld_items(html: Column | str) -> Column:
    """Array of VARIANT items of all JSON-LD blocks, arrays flattened. A block
    that does not parse gives no items."""
    blocks = ld_blocks(html)

    def items(block):
        b = F.trim(block)
        as_array = F.when(b.startswith("["), b).otherwise(F.concat(F.lit("["), b, F.lit("]")))
        return F.coalesce(F.try_variant_get(F.try_parse_json(as_array), "$", "array<variant>"), F.array().cast("array<variant>"))

    return F.flatten(F.transform(blocks, items))


def parse_json_ld(html: Column | str, types: Sequence[str] = L.JSON_LD_TYPES) -> Column:
    """Struct of company fields, each the first non-null over the matching
    items of the page."""
    def type_of(v):
        many = F.try_variant_get(v, "$['@type']", "array<string>")
        return F.lower(F.coalesce(F.array_join(many, ","), _variant_text(v, "$['@type']"), F.lit("")))

    def build(good):
        def first(path, kind="string"):
            vals = F.filter(F.transform(good, lambda v: F.try_variant_get(v, path, kind)), lambda x: x.isNotNull())
            return F.get(vals, F.lit(0))

        return F.struct(
            *[first(f"$.{f}").alias(f) for f in _FIELDS],
            *[first(f"$.address.{f}").alias(f) for f in _ADDRESS],
            F.coalesce(
                first("$.address.addressCountry.name"), first("$.address.addressCountry['@id']"), first("$.address.addressCountry")
            ).alias("addressCountry"),
            F.coalesce(first("$.sameAs", "array<string>"), F.array(first("$.sameAs"))).alias("sameAs"),
            first("$.openingHoursSpecification", "array<variant>").alias("hours"),
        )

    # built inside one lambda, so the blocks are parsed once for all fields
    return let(F.filter(json_ld_items(html), lambda v: contains_any(type_of(v), types)), build)


def json_ld_hours(spec: Column) -> Column:
    """``Day[,Day]: opens-closes; ...`` from an array of specifications."""
    def one(v):
        many = F.try_variant_get(v, "$.dayOfWeek", "array<string>")
        day = F.coalesce(
            F.array_join(F.transform(many, lambda d: F.element_at(F.split(d, "/"), -1)), ","),
            _variant_text(v, "$.dayOfWeek"),
        )
        return F.when(
            filled(day) & filled(_variant_text(v, "$.opens")) & filled(_variant_text(v, "$.closes")),
            F.concat(day, F.lit(": "), _variant_text(v, "$.opens"), F.lit("-"), _variant_text(v, "$.closes")),
        )

    return blank_to_null(F.array_join(F.filter(F.transform(spec, one), lambda x: x.isNotNull()), "; "))


def page_lines(html: Column | str) -> Column:
    """Text nodes, one per line."""
    t = unescape(F.regexp_replace(drop_raw(text(html)), r"<[^<>]*>", "\n"))
    lines = F.transform(F.split(t, "\n"), lambda x: squeeze(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def html_opening_hours(html: Column | str, spec: Column) -> Column:
    """JSON-LD hours, else up to seven lines naming a day around the earliest
    hours label."""
    def around_label(t):
        spots = F.filter(F.array(*[F.instr(F.lower(t), w) for w in L.HOURS_LABELS]), lambda i: i > 0)
        def lines(at):
            start = F.greatest(F.lit(1), at - 100)
            days = F.filter(
                F.transform(F.split(F.substring(t, start, at + 400 - start), "\n"), lambda x: F.trim(x)),
                lambda x: (x != "") & contains_any(F.lower(x), L.DAY_PREFIXES))
            return blank_to_null(F.array_join(F.slice(days, 1, 7), "; "))
        return let(F.array_min(spots), lines)

    return F.coalesce(json_ld_hours(spec), let(page_lines(html), around_label))


def _deep(blocks: Column, keys: Sequence[str]) -> Column:
    """First string under one of the keys, in the order of the text, with its
    escapes decoded."""
    good = F.filter(blocks, lambda b: F.try_parse_json(b).isNotNull())
    pattern = r"\"(?:" + "|".join(keys) + r")\"\s*:\s*\"([^\"\\]*+(?:\\.[^\"\\]*+)*+)\""
    decoded = F.transform(good, lambda b: F.get(F.from_json(F.concat(F.lit('["'), F.regexp_extract(b, pattern, 1), F.lit('"]')), "array<string>"), F.lit(0)))
    return F.get(F.filter(decoded, lambda x: filled(x)), F.lit(0))


def json_ld_deep_phone(html: Column | str) -> Column:
    """Phone of the JSON-LD blocks: an item's telephone, its phone, that of its
    contact point; else the first such value at any depth."""
    def own(v):
        at = lambda path: blank_to_null(_variant_text(v, path))
        return F.coalesce(at("$.telephone"), at("$.phone"), at("$.contactPoint.telephone"), at("$.contactPoint[0].telephone"))

    top = F.get(F.filter(F.transform(json_ld_items(html), own), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(top, _deep(ld_blocks(html), ["telephone", "phone"]))


def json_ld_deep_value(html: Column | str, keys: Sequence[str]) -> Column:
    """First string under one of the keys at any depth (address parts, hours,
    name, e-mail, description)."""
    return _deep(ld_blocks(html), keys)


# -- address and prices -------------------------------------------------------
ITEMPROP_ADDRESS = r"(?is)<(\w+)\b[^<>]*itemprop\s*=\s*[\"']address[\"'][^<>]*>(.*)$"


def itemprop_address(html: Column) -> Column:
    """Inner HTML of the first itemprop=address element, up to the first end
    tag of its kind; empty where it has none."""
    found = F.struct(F.lower(F.regexp_extract(html, ITEMPROP_ADDRESS, 1)).alias("tag"), F.regexp_extract(html, ITEMPROP_ADDRESS, 2).alias("rest"))
    at = lambda f: F.instr(F.lower(f["rest"]), F.concat(F.lit("</"), f["tag"]))
    return let(found, lambda f: F.when((f["tag"] != "") & (at(f) > 0), F.substr(f["rest"], F.lit(1), at(f) - 1)).otherwise(F.lit("")))


CITY_LINE = r"(.+?),\s*([A-Za-z .'\-]+)\s*(?:([A-Z]{2}))?\s*(\d{4,6})?"


def plain_text(html: Column | str) -> Column:
    """Text of the page without scripts and styles."""
    return _tags_to_text(drop_raw(text(html)))


def has_address(address: Column) -> Column:
    """More than a country."""
    return any_of([filled(address[f]) for f in ("street", "city", "region", "postal")])


def html_address(html: Column | str, ld: Column, fallback_country: Column | str = "") -> Column:
    """Struct street, city, region, postal, country: JSON-LD, else the first
    itemprop=address block split by a simple pattern, else the fallback."""
    full = _tags_to_text(itemprop_address(text(html)))
    country = F.lit(fallback_country) if isinstance(fallback_country, str) else fallback_country

    def build(v):
        d, line = v["ld"], v["line"]
        has_ld = any_of([filled(d[f]) for f in [*_ADDRESS, "addressCountry"]])
        m = [F.trim(F.regexp_extract(line, CITY_LINE, i)) for i in (1, 2, 3, 4)]

        def pick(f, alt):
            return blank_to_null(F.when(has_ld, d[f]).when(line != "", alt))

        return F.struct(
            pick("streetAddress", line).alias("street"),
            pick("addressLocality", m[0]).alias("city"),
            pick("addressRegion", F.coalesce(blank_to_null(m[2]), m[1])).alias("region"),
            pick("postalCode", m[3]).alias("postal"),
            first_of(d["addressCountry"], country).alias("country"),
        )

    return let(F.struct(ld.alias("ld"), full.alias("line")), build)


def html_price_rows(html: Column | str, materials: Sequence[str] = L.MATERIAL_KEYWORDS, patterns: Sequence[str] = L.PRICE_PATTERNS) -> Column:
    """Rows of price tables that hold a material and a price."""
    tables = F.filter(
        elements(text(html), "table"),
        lambda t: contains_any(F.lower(_tags_to_text(t)), ["price", "rate"]),
    )
    rows = F.flatten(F.transform(tables, lambda t: elements(t, "tr")))

    def cells(r):
        inner = F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^<>]*>(.*?)</t[dh]\s*>"), F.lit(1))
        return F.when(F.size(inner) >= 2, F.array_join(F.transform(inner, _tags_to_text), " "))

    price = "(?i)" + "|".join(f"(?:{p})" for p in patterns)
    return F.filter(
        F.transform(rows, cells),
        lambda t: t.isNotNull() & contains_any(F.lower(t), materials) & t.rlike(price),
    )
