"""Name, address and opening hours from the marked-up blocks of a company page.

All selectors are matched in one walk over the page (``company_blocks``, one
Arrow pass); what a block's text means is worked out by column expressions on
those short texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from webrec.functions.common import blank_to_null, filled, let
from webrec.functions.contacts import parse_us_address
from webrec.functions.hours import normalize_hours
from webrec.functions.html import clean_company_name, html_company_name
from webrec.functions.html_select import html_select_all

# fixed values: selectors in order of trust
NAME_SELECTORS = [
    "h1.company-name", "h1.business-name", ".company-name", ".business-name", "h1", "title", ".logo-text", ".site-title", ".company-title",
    "[data-company]", "[data-business]", ".header-title",
]
ADDRESS_SELECTORS = [
    ".address", ".contact-address", ".location", ".contact-info", '[itemtype*="PostalAddress"]', ".business-address", ".company-address",
]
HOURS_SELECTORS = [".hours", ".business-hours", ".operating-hours", ".open-hours", ".contact-hours", '[itemprop="openingHours"]']
ADDRESS_PROPS = {"street": "streetAddress", "city": "addressLocality", "region": "addressRegion", "postal": "postalCode", "country": "addressCountry"}


def company_blocks(
    html: Column | str, names: Sequence[str] = NAME_SELECTORS, addresses: Sequence[str] = ADDRESS_SELECTORS, hours: Sequence[str] = HOURS_SELECTORS
) -> Column:
    """Struct of texts: ``names`` (the first hit of each selector, null where
    there is none), ``addresses`` and ``hours`` (all hits, selectors in their
    order, then the page's), and the first hit of each address itemprop."""
    lists = {"n": names, "a": addresses, "h": hours}
    asked = {f"{k}{i}": s for k, many in lists.items() for i, s in enumerate(many)} | {f"p_{f}": f'[itemprop="{p}"]' for f, p in ADDRESS_PROPS.items()}
    found = html_select_all(html, asked, ("text",))

    def build(f):
        first = lambda k: F.get(f[k], F.lit(0))["text"]
        every = lambda k: F.transform(F.flatten(F.array(*[f[f"{k}{i}"] for i in range(len(lists[k]))])), lambda h: h["text"])
        return F.struct(
            F.array(*[first(f"n{i}") for i in range(len(names))]).alias("names"), every("a").alias("addresses"), every("h").alias("hours"),
            *[blank_to_null(first(f"p_{p}")).alias(p) for p in ADDRESS_PROPS],
        )

    return let(found, build)


def blocks_company_name(blocks: Column, html: Column | str, url: Column | str) -> Column:
    """The first selector's hit of 3 to 100 characters that leaves a name once
    cleaned; else title without suffix, meta tags, host."""
    cleaned = F.transform(blocks["names"], lambda n: F.when(F.length(n).between(3, 100), clean_company_name(n)))
    return F.coalesce(F.get(F.filter(cleaned, filled), F.lit(0)), html_company_name(html, url))


def blocks_address(blocks: Column, page: Column, fallback_country: Column | str = "United States") -> Column:
    """Struct street, city, region, postal, country: the first address block
    that parses to a street; else the itemprops where they name a street or a
    city; else what the page's text gives. ``page`` is that text."""
    country = F.lit(fallback_country) if isinstance(fallback_country, str) else fallback_country

    def shape(a):
        fields = {"street": a["street"], "city": a["city"], "region": a["state"], "postal": a["postal"], "country": F.coalesce(a["country"], country)}
        return F.struct(*[blank_to_null(v).alias(k) for k, v in fields.items()])

    props = F.struct(*[F.coalesce(blocks[f], country).alias(f) if f == "country" else blocks[f].alias(f) for f in ADDRESS_PROPS])
    # blocks first, then the page, through one parser: the expression is long
    texts = F.concat(F.filter(blocks["addresses"], lambda t: F.length(t) > 10), F.array(page))

    def choose(parsed):
        with_street = F.filter(F.slice(parsed, 1, F.size(parsed) - 1), lambda a: filled(a["street"]))
        whole = F.element_at(parsed, -1)
        named = filled(blocks["street"]) | filled(blocks["city"])
        nothing = F.struct(*[(country if f == "country" else F.lit(None).cast("string")).alias(f) for f in ADDRESS_PROPS])
        return (
            F.when(F.size(with_street) > 0, shape(F.get(with_street, F.lit(0)))).when(named, props)
            .when(whole.isNotNull(), shape(whole)).otherwise(nothing)
        )

    return let(F.transform(texts, parse_us_address), choose)


def blocks_hours(blocks: Column) -> Column:
    """Opening hours of the first hours block that names Monday or hours: as
    day sets where its text can be read, else as it stands."""
    good = F.filter(blocks["hours"], lambda t: F.lower(t).rlike("mon|hours"))
    return let(F.get(good, F.lit(0)), lambda t: F.coalesce(normalize_hours(t), blank_to_null(t)))
