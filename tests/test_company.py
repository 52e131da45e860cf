"""Company records: blocks, hours, phones by country, contact pages."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webrec.functions.company_blocks import blocks_address, blocks_company_name, blocks_hours, company_blocks
from webrec.functions.hours import normalize_hours
from webrec.functions.html import plain_text
from webrec.functions.html_select import _Matcher, compile_selector
from webrec.functions.html_tree import Tree
from webrec.functions.phone_plans import extract_phones_by_region, page_phones
from webrec.operators.contact_pages import contact_page_fallback, page_contacts
from webrec.operators.extraction import extract_company

WEEK = "Mon,Tue,Wed,Thu,Fri"
HOURS = {
    "Mon-Fri: 9.00-17.30": f"{WEEK}: 09:00-17:30",
    "Business hours Mon-Fri 8-5 Sat 8-12 Sun Closed": f"{WEEK}: 08:00-17:00; Sat: 08:00-12:00; Sun: closed",
    "Fri - Mon 10-2": "Mon,Fri,Sat,Sun: 10:00-14:00",
    "Sat 22:00-02:00": "Sat: 22:00-02:00",
    "Mon 12-1pm, Tue 12am-12pm": "Mon: 12:00-13:00; Tue: 00:00-12:00",
    "Thu 10am-2": "Thu: 10:00-14:00",
    "wednesdays and saturdays: from 7:15 a.m. until 3 p.m.": "Wed,Sat: 07:15-15:00",
    "Seven days a week 6-22": f"{WEEK},Sat,Sun: 06:00-22:00",
    "Mon-Fri 24 hours": f"{WEEK}: 00:00-24:00",
    "we are here 24/7": f"{WEEK},Sat,Sun: 00:00-24:00",
    "Mon 99-100": None, "Mon 8:75-9": None, "Monday": None, "8-5": None, "": None, None: None,
}


def test_hours(spark):
    df = spark.createDataFrame([(h,) for h in HOURS], "h string").select("h", normalize_hours("h").alias("n"))
    assert {r.h: r.n for r in df.collect()} == HOURS
    long = spark.createDataFrame([("Mon, " * 60_000,), ("monday to " * 30_000,), ("8-" * 80_000,), ("Mon 8-5, " * 20_000,)], "h string")
    t = time.time()
    got = [r.n for r in long.select(normalize_hours("h").alias("n")).collect()]
    assert got[:3] == [None] * 3 and got[3].startswith("Mon: 08:00-17:00; Mon:") and time.time() - t < 30


def test_phones(spark):
    rows = [
        ("+44 (0)20 7946 0958, 0044 20 7946 0959 and +44-20-7946-0958", "US", ["+44 2079460958", "+44 2079460959"]),
        ("(01) 677 1234 / 087 123 4567", "IE", ["+353 16771234", "+353 871234567"]),
        ("416-868-0199 2024-01-15 id=1234567890123456", "CA", ["(416) 868-0199"]),
        ("2024-01-15 00:12 12345.67 192.168.10.100", "GB", []),
        ("+99 123 456 789, +1 123 456 7890", "US", []),
        ("", "US", []), (None, "US", []), ("02 9374 4000", None, []),
    ]
    df = spark.createDataFrame(rows, "t string, r string, want array<string>").select("want", extract_phones_by_region("t", "r").alias("got"))
    assert all(r.got == r.want for r in df.collect())
    loose = spark.createDataFrame([("ring 713.868.1234", "GB"), ("ring 713.868.1234", "US")], "t string, r string")
    assert [r.p for r in loose.select(page_phones("t", F.col("r")).alias("p")).collect()] == [["(713) 868-1234"]] * 2
    t = time.time()
    long = spark.createDataFrame([("1 " * 100_000,), ("+" * 100_000,), ("(" * 50_000 + "1",), ("12-" * 60_000,)], "t string")
    long.select(extract_phones_by_region("t", F.lit("GB")).alias("p")).collect()
    assert time.time() - t < 30


def blocks(spark, html, url="https://acme-yard.com/x"):
    df = spark.createDataFrame([(html, url)], "html string, url string").withColumn("b", company_blocks("html"))
    return df.select(
        blocks_company_name(F.col("b"), "html", "url").alias("name"), blocks_address(F.col("b"), plain_text("html"), "Canada").alias("a"), blocks_hours(F.col("b")).alias("hours")
    ).first()


def test_address_cascade(spark):
    """First a block with a street, in the order of the selectors; then the itemprops; then the page."""
    props = '<i itemprop=streetAddress>9 Quay</i><i itemprop="addressLocality">Cork</i>'
    late = '<p class="company-address">12 Oak Avenue, Dallas, TX 75201</p>'
    early = '<p class="location">no street here, Erie, PA 16501</p><p class="location">7 Elm Street, Erie, PA 16501</p>'
    text = "<p>Visit: 34 Pine Road, Boise, ID 83702</p>"
    assert tuple(blocks(spark, text + props + late + early).a) == ("7 Elm Street", "Erie", "PA", "16501", "United States")
    assert tuple(blocks(spark, text + props + late).a) == ("12 Oak Avenue", "Dallas", "TX", "75201", "United States")
    assert tuple(blocks(spark, text + props).a) == ("9 Quay", "Cork", None, None, "Canada")
    assert tuple(blocks(spark, text).a) == ("34 Pine Road", "Boise", "ID", "83702", "United States")
    for nothing in ("", None, "<p>hello</p>", '<p class="address">short</p>'):
        assert tuple(blocks(spark, nothing).a) == (None, None, None, None, "Canada")


def test_names_and_hours_of_blocks(spark):
    assert blocks(spark, '<title>T shop</title><h1>Big one</h1><p class="business-name">Small one</p>').name == "Small one"
    assert blocks(spark, "<title>Iron Works | Home</title><h1>x</h1>").name == "Iron Works | Home"
    assert blocks(spark, "<h1>Welcome to</h1><p data-company>Deep Iron</p>").name == "Deep Iron"
    assert blocks(spark, "<p>nothing</p>").name == "Acme Yard"
    assert blocks(spark, '<p class="hours">call us</p><p class="hours">Mon 8-5</p><p class="hours">Monday 1-2</p>').hours == "Mon: 08:00-17:00"
    assert blocks(spark, '<p class="open-hours">Hours vary</p>').hours == "Hours vary"
    assert blocks(spark, "<p>Mon 8-5</p>").hours is None


SELECTORS = ["p", "*", ".a", "#i", "[x]", '[x="1"]', "div > .a", "div p", "p.a, .b p", ":first-child", "div *", "p:last-child", ".a .b", "[x] > p"]
NODES = ["<div>", "</div>", "<p>", "</p>", '<p class="a">', '<div class="b a" x=1>', "<i X='2'>", "</i>", "<p id=i>", "t", "<br>"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(NODES), max_size=30))
def test_one_walk_matches_each_selector(parts):
    """All selectors in one walk, against a plain test of every node and its ancestors."""
    tree = Tree("".join(parts))
    matcher = _Matcher(tree)
    compiled = {s: compile_selector(s) for s in SELECTORS}

    def fits(k, chain):
        *rest, (tests, link) = chain
        if not matcher.fits(k, tests):
            return False
        if not rest:
            return True
        up = tree.parent[k]
        if link == ">":
            return up >= 0 and fits(up, rest)
        while up >= 0:
            if fits(up, rest):
                return True
            up = tree.parent[up]
        return False

    want = {s: [k for k in range(len(tree.tag)) if any(fits(k, c) for c in chains)] for s, chains in compiled.items()}
    assert matcher.hits_all(compiled) == want


def sites(spark):
    page = lambda *links: "".join(f'<a href="{h}">{t}</a>' for h, t in links)
    rows = [
        (1, "https://a.com/", page(("/contact", "x"), ("https://b.com/contact", "y"), ("/help", "Contact desk"), ("/contact#top", "z"))),
        (2, "https://a.com/contact", "<p>one@a.com</p>" + page(("/contact/deep", "more"))),
        (3, "https://a.com/help", "<p>two@a.com 713-868-1234</p>"),
        (4, "https://b.com/contact", "<p>other@b.com 713-868-9999</p>"),
        (5, "https://c.com/", "<p>own@c.com</p>" + page(("/contact", "c"))),
        (6, "https://c.com/contact", "<p>713-868-5555 not@c.com</p>"),
        (7, "https://c.com/contact", "<p>713-868-6666</p>"),
        (8, "https://d.com/contact", page(("/contact", "myself"))),
        (9, "https://a.com/contact/deep", "<p>713-868-7777</p>"),
        (10, None, page(("/contact", "x"))), (11, "https://e.com/", None), (12, "https://e.com/x", ""),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_contact_pages(spark):
    got = {r.page_id: (r.phones, r.emails, r.from_contact_page) for r in contact_page_fallback(sites(spark)).collect()}
    assert len(got) == 12 and contact_page_fallback(sites(spark)).count() == 12
    assert got[1] == (["(713) 868-1234"], ["one@a.com", "two@a.com"], True)  # in the order of the links, other hosts apart
    assert got[2] == (["(713) 868-7777"], ["one@a.com"], True)  # one step: page 1 does not get this phone
    assert got[5] == (["(713) 868-5555"], ["own@c.com"], True)  # its own stay; of two rows of a URL the first counts
    assert got[8] == got[10] == got[11] == got[12] == ([], [], False)
    first = {r.page_id: r.emails for r in contact_page_fallback(sites(spark), limit=1).collect()}
    assert first[1] == ["one@a.com"]
    assert contact_page_fallback(sites(spark).limit(0)).count() == 0


def test_contact_pages_move_no_html(spark):
    plan = page_contacts(sites(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    joined = contact_page_fallback(sites(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"\bhtml#", joined)


def test_a_contact_page_of_a_whole_site(spark):
    """A third of all rows link to one page."""
    hub = spark.createDataFrame([(-1, "https://hub.com/contact", "<p>hub@hub.com 713-868-1234</p>")], "page_id long, url string, html string")
    many = spark.range(3000).selectExpr(
        "id AS page_id", "IF(id % 3 = 0, 'https://hub.com/p' || id, 'https://s' || id || '.com/') AS url", "'<a href=\"https://hub.com/contact\">c</a>' AS html")
    got = contact_page_fallback(many.unionByName(hub))
    assert got.where("from_contact_page").count() == 1000 and got.count() == 3001


def test_records_with_contact_pages(spark):
    got = {r.page_id: r for r in extract_company(sites(spark), contact_pages=True).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 9} and got[1].emails == ["one@a.com", "two@a.com"] and got[1].website == "https://a.com/"
    plain = {r.page_id for r in extract_company(sites(spark)).collect()}
    assert plain == {2, 3, 4, 5, 6, 7, 9}
    assert extract_company(sites(spark)).columns == extract_company(sites(spark), contact_pages=True).columns == extract_company(sites(spark), blocks=True).columns


@pytest.mark.parametrize("country, phones", [("Ireland", ["+353 16771234"]), ("USA", []), (None, [])])
def test_country_chooses_the_plan(spark, country, phones):
    page = [(1, "https://x.ie/", "<p>x@x.ie 01 677 1234</p>", country)]
    df = spark.createDataFrame(page, "page_id long, url string, html string, country string")
    assert extract_company(df, country=F.col("country")).first().phones == phones
