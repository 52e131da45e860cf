"""Contacts of a site's contact pages, for pages that name none themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrec.functions import contacts as C
from webrec.functions import html as H
from webrec.functions.common import at_most, col, filled_array
from webrec.functions.phone_plans import page_phones
from webrec.functions.urls import absolute_url, url_netloc
from webrec.session import cut_lineage


def contact_links(html: Column | str, url: Column | str, word: str = "contact", limit: int | None = None) -> Column:
    """Distinct links, in page order, whose address or text names a contact
    page on the same host."""
    named = F.filter(H.link_array(html), lambda a: F.lower(a["href"]).contains(word) | F.lower(a["anchor"]).contains(word))
    full = F.transform(named, lambda a: F.regexp_replace(absolute_url(url, a["href"]), "#.*$", ""))
    host = url_netloc(url)
    return at_most(F.array_distinct(F.filter(full, lambda u: url_netloc(u) == host)), limit)


def page_contacts(pages: DataFrame, region: Column | str = "US", limit: int | None = None) -> DataFrame:
    """``page_id, url, phones, emails, contact_urls`` per page: all that the
    join below needs, so html stays where it was read."""
    region = F.lit(region) if isinstance(region, str) else region
    return pages.select(
        "page_id", "url", page_phones("html", region).alias("phones"), C.extract_emails("html").alias("emails"), contact_links("html", "url", limit=limit).alias("contact_urls")
    )


def fill_from_contact_pages(facts: DataFrame) -> DataFrame:
    """``facts`` (with ``page_id``, ``url``, ``phones``, ``emails``,
    ``contact_urls`` and any other columns) with empty phones, and empty
    e-mails, taken from the contact pages that the page links to, in the order
    of the links. ``from_contact_page`` tells whether something was taken.

    Links lead one step. Several rows of one URL count as the one of the least
    ``page_id``; a page's link to itself gives nothing. The link table holds
    only pages that lack something, the other side one row per URL and only
    contacts, so a contact page that a whole site links to meets rows without
    html, which the planner may split."""
    facts = cut_lineage(facts)  # narrow rows, read twice
    lacking = facts.where(~filled_array("phones") | ~filled_array("emails"))
    links = lacking.select("page_id", F.col("url").alias("own"), F.posexplode("contact_urls").alias("pos", "target")).where("target <> own")
    best = F.min_by(F.struct("phones", "emails"), "page_id").alias("there")
    targets = facts.where(filled_array("phones") | filled_array("emails")).groupBy(F.regexp_replace("url", "#.*$", "").alias("target")).agg(best)
    met = links.join(targets, "target").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "there"))).alias("met"))
    union = lambda f: F.array_distinct(F.flatten(F.transform("met", lambda m: F.coalesce(m["there"][f], F.array().cast("array<string>")))))
    found = met.select(F.col("page_id").alias("found_for"), union("phones").alias("found_phones"), union("emails").alias("found_emails"))
    joined = facts.join(found, F.col("page_id") == F.col("found_for"), "left")
    filled_in = {c: F.when(filled_array(c), F.col(c)).otherwise(F.coalesce(f"found_{c}", c)) for c in ("phones", "emails")}
    took = F.lit(False)
    for c in filled_in:
        took = took | (~F.coalesce(filled_array(c), F.lit(False)) & F.coalesce(filled_array(f"found_{c}"), F.lit(False)))
    return joined.withColumn("from_contact_page", took).withColumns(filled_in).drop("found_for", "found_phones", "found_emails")


def contact_page_fallback(pages: DataFrame, region: Column | str = "US", limit: int | None = None) -> DataFrame:
    """``page_id, url, phones, emails, from_contact_page``: each page's
    contacts, else those of its site's contact pages in the table."""
    return fill_from_contact_pages(page_contacts(pages, region, limit)).drop("contact_urls")
