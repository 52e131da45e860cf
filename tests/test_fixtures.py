"""Hand-made rows with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions import contacts as C
from webrec.functions import html as H
from webrec.functions import quality as Q
from webrec.functions import text as T
from webrec.functions import urls as U
from webrec.functions.html_select import html_select, html_select_all
from webrec.operators import dedup as D
from webrec.operators import digests as G
from webrec.operators import extraction as X
from webrec.operators import joins as J
from webrec.sources import batch_payloads as B
from webrec.sources import readers as R
from webrec.streaming import jobs as S


def one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("r")).first()["r"]


def col(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", fn(F.col("x")).alias("r")).collect()
    return [r["r"] for r in sorted(rows)]


PHONES = [
    ("(800) 123-4567", None, False), ("888-555-1234", "(888) 555-1234", False), ("213.456.7890", "(213) 456-7890", False),
    ("1-800-123-4567", None, False), ("(555) 123-4567", None, False), ("(999) 999-9999", "(999) 999-9999", False),
    ("12345", None, False), ("invalid phone", None, False), ("(713) 868-4111", "(713) 868-4111", True),
    ("713-555-0123", "(713) 555-0123", False), ("+1 713 681 2000", "(713) 681-2000", True), (None, None, False), ("", None, False),
]


def test_phones(spark):
    raw = [p[0] for p in PHONES]
    assert col(spark, raw, lambda x: C.normalize_phone_us(x)) == [p[1] for p in PHONES]
    assert col(spark, raw, C.validate_phone_strict) == [p[2] for p in PHONES]


def test_phone_e164(spark):
    df = spark.createDataFrame([("713 868 4111", "usa"), ("+44 20 7946 0958", "usa"), ("020 7946 0958", "uk"), ("12", "us"), (None, None)], "p string, c string")
    assert [r[0] for r in df.select(C.normalize_phone_e164("p", "c")).collect()] == ["+17138684111", "+442079460958", "+442079460958", None, None]


def test_emails(spark):
    ok = ["contact@recycling.com", "info@metal-yard.net", "sales@scrap.business", "hello@world.co.uk"]
    bad = ["support@example.com", "test@test.com", "invalid-email", "", None]
    got = col(spark, ok + bad, lambda x: C.validate_email(x, test_domains=L.EMAIL_TEST_DOMAINS))
    assert got == [True] * 4 + [False] * 5
    assert one(spark, "Email: sales@metalco.org", lambda x: C.extract_emails(x)) == ["sales@metalco.org"]


PAGE = (
    "<title>ABC Metal Recycling</title><h1>ABC Metal Recycling</h1><p>Contact us at (555) 123-4567 or email info@abc-metal.com</p>"
    "<p>We buy scrap metal and aluminum.</p>"
)


def test_company_page(spark):
    pages = spark.createDataFrame([(1, "https://abc.org/", PAGE), (2, "https://no.org/", "<p>nothing</p>"), (3, "https://n.org", None)], "page_id bigint, url string, html string")
    rows = X.extract_company(X.scan_pages(pages)).collect()
    assert [r["page_id"] for r in rows] == [1]
    r = rows[0]
    assert (r["name"], r["emails"], r["materials"]) == ("ABC Metal Recycling", ["info@abc-metal.com"], "aluminum")
    assert r["phones"] == ["(555) 123-4567"] and not one(spark, r["phones"][0], C.validate_phone_strict)


def test_listing_cards(spark):
    html = '<div class="company"><h3>ABC Metal Recycling</h3><p>x<div class="company"><h3>XYZ Scrap Yard</h3></div>'
    pages = spark.createDataFrame([(1, "u", html.replace("<p>x", "</div>"))], "page_id bigint, url string, html string")
    assert sorted(r["name"] for r in X.html_listing_cards(pages).collect()) == ["ABC Metal Recycling", "XYZ Scrap Yard"]


def test_html_select(spark):
    html = '<ul id="a"><li class="x y">one<li>two &amp; 2</ul><a href="http://q.org" data-t="v">l</a><a href="/r">m</a><br><p>un<b>closed'
    s = one(spark, html, lambda x: html_select_all(x, {
        "li": "li", "cls": ".y", "id": "#a li", "pre": 'a[href^="http"]', "sub": "[href*=r]", "eq": '[data-t="v"], .nope', "b": "p b"}))
    assert [h["text"] for h in s["li"]] == ["one", "two & 2"]
    assert [len(s[k]) for k in ("cls", "id", "pre", "sub", "eq", "b")] == [1, 2, 1, 2, 1, 1]
    assert s["pre"][0]["attrs"] == {"href": "http://q.org", "data-t": "v"}
    assert one(spark, None, lambda x: html_select(x, "a")) == []


LD = {
    "@type": ["LocalBusiness"], "name": "A", "telephone": "713-868-4111",
    "address": {"addressLocality": "Houston", "addressRegion": "TX", "postalCode": "77008"},
    "openingHoursSpecification": [{"dayOfWeek": ["https://schema.org/Monday", "https://schema.org/Tuesday"], "opens": "08:00", "closes": "17:00"}],
}


def _ld(*blocks):
    return "".join(f'<script type="application/ld+json">{b}</script>' for b in blocks)


def test_json_ld(spark):
    good = json.dumps(LD)
    for html in (_ld(good), _ld(json.dumps([LD])), _ld("{oops", good), _ld(json.dumps({"@type": "Article", "name": "no"}), good)):
        r = one(spark, html, lambda x: H.parse_json_ld(x))
        assert (r["name"], r["telephone"], r["addressLocality"], r["postalCode"]) == ("A", "713-868-4111", "Houston", "77008")
        assert one(spark, html, lambda x: H.html_opening_hours(x, H.parse_json_ld(x)["hours"])) == "Monday,Tuesday: 08:00-17:00"
    none = one(spark, _ld(json.dumps({"@type": "Article", "name": "no"})), lambda x: H.parse_json_ld(x))
    assert none["name"] is None


@pytest.mark.parametrize("url,want", [
    ("https://duckduckgo.com/l/?uddg=https%3A%2F%2Fa.org%2Fx", "https://a.org/x"),
    ("https://www.bing.com/ck/a?u=a1aHR0cHM6Ly9leGFtcGxlLm9yZy94", "https://example.org/x"),
    ("ftp://a", None), ("", None), ("https://a.org/", "https://a.org/"), (None, None),
    ("https://r.msn.com/x?url=https%3A%2F%2Fb.org", "https://b.org"), ("https://www.bing.com/ck/a?u=%%%", "https://www.bing.com/ck/a?u=%%%"),
])
def test_redirects(spark, url, want):
    assert one(spark, url, U.unwrap_redirect_url) == want


@pytest.mark.parametrize("text,want", [
    ("11801 W Montgomery Road, Houston, TX 77086", ("11801 W Montgomery Road", "Houston", "TX", "77086")),
    ("8770 Hempstead Rd Houston, TX 77008", ("8770 Hempstead Rd", "Houston", "TX", "77008")),
    ("Houston, TX 77008", (None, "Houston", "TX", "77008")), ("Houston, QQ 77008", None), ("", None), (None, None),
])
def test_address(spark, text, want):
    r = one(spark, text, C.parse_us_address)
    assert (r and (r["street"], r["city"], r["state"], r["postal"])) == want


def greedy(spark, rows, keys=D.greedy_keys_name_or_site, cols="id int, name string, website string"):
    df = spark.createDataFrame(rows, cols)
    return sorted(r["id"] for r in D.dedup_greedy(df, keys(), "id").collect())


def test_greedy(spark):
    assert greedy(spark, [(1, "A", "x"), (2, "A", "y"), (3, "B", "y")]) == [1, 3]
    assert greedy(spark, [(1, "A", "x"), (2, "B", "x"), (3, "B", "y")]) == [1, 3]
    assert greedy(spark, [(1, "A", ""), (2, "B", ""), (3, "C", None)]) == [1, 2, 3]
    contact = "id int, phone string, email string, name string"
    assert greedy(spark, [(1, "", "", "A"), (2, None, None, "B"), (3, "p", "", "C")], D.greedy_keys_contact_or_name, contact) == [1, 3]


def test_greedy_against_loop(spark):
    """A long chain, a hot key and random keys, against the plain loop; the
    same with one partition and with eight."""
    import random

    rnd = random.Random(5)
    rows = [(i, f"n{rnd.randint(0, 60)}" if i % 3 else "hot", f"s{rnd.randint(0, 60)}" if i % 4 else None) for i in range(400)]
    rows += [(1000 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(12)]
    names, sites, want = set(), set(), []
    for i, n, s in rows:
        if n in names or (s and s in sites):
            continue
        names.add(n)
        sites.update([s] if s else [])
        want.append(i)
    df = spark.createDataFrame(rows, "id int, name string, website string")
    for parts in (1, 8):
        got = D.dedup_greedy(df.repartition(parts), D.greedy_keys_name_or_site(), "id")
        assert sorted(r["id"] for r in got.collect()) == want


def test_host_then_name_and_geo(spark):
    df = spark.createDataFrame([(1, "h1", "A"), (2, "h2", "A"), (3, "h2", "B")], "id int, host string, name string")
    assert [r["id"] for r in D.dedup_host_then_name(df, F.col("host"), F.col("name"), [F.asc("id")]).collect()] == [1]
    geo = spark.createDataFrame([(1, 29.76041, -95.36979, "a"), (2, 29.76043, -95.36981, "b"), (3, None, None, "a"), (4, None, None, "A ")], "id int, latitude double, longitude double, name string")
    assert sorted(r["id"] for r in D.dedup_keyed(geo, D.key_geo(), [F.asc("id")]).collect()) == [1, 3]


def test_dedup_is_idempotent_and_skew_safe(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"))
    once = D.first_per_key(df, "k", [F.asc("id")])
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, D.first_per_key(once, "k", [F.asc("id")]).collect()))
    plan = once._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2  # also before the shuffle


def test_lexicon(spark):
    text = "scrap scrap metal waste copper"
    s = one(spark, text, lambda x: T.lexicon_count_score(x, L.CATEGORY_MATERIALS))
    assert s == {"scrap": 0.8, "non_ferrous": 0.2}
    df = spark.createDataFrame([("scrap", "scrap metal waste copper"), ("", "nothing here"), (None, None), ("Лом", "СТАЛЬ")], "t string, c string")
    got = [r[0] for r in df.select(T.categorize_article("t", "c")).collect()]
    assert got == [["material:non_ferrous", "material:scrap"], ["type:other"], ["type:other"], ["material:ferrous", "material:scrap"]]
    assert one(spark, "steel " * 6, lambda x: T.lexicon_count_score(x, {"m": ["steel"]})) == {"m": 1.0}
    assert one(spark, "金属回收", lambda x: T.lexicon_match(x, {"zh": ["回收"]})) == ["zh"]


def test_prices(spark):
    t = "We sell brass at $2.50/lb and copper at $3/lb today. " + "x" * 80 + " candy $9/lb " + "y" * 80
    got = one(spark, t, lambda x: T.extract_inline_prices(x))
    assert len(got) == 2 and "$2.50/lb" in got[0] and "$3/lb" in got[1]
    assert one(spark, None, lambda x: T.extract_inline_prices(x)) == []


def test_cleaning(spark):
    assert one(spark, "monday-FRI 8-5", C.normalize_day_names) == "Mon-Fri 8-5"
    df = spark.createDataFrame([(["555 681 2000", "713 868 4111"], ["A@B.org", "bad"], "a.org", "x", "77055-1234", "USA")],
                               "phones array<string>, emails array<string>, website string, hours string, zip_code string, country string")
    r = C.clean_contact_record(df).first()
    assert (r["phones"], r["had_fake_phone"], r["emails"], r["website"], r["zip_code"], r["had_fake_zip"]) == (["(713) 868-4111"], True, ["a@b.org"], "https://a.org", "77055", False)


def test_fusion(spark):
    rec = spark.createDataFrame([(1, None), (2, "p0")], "id int, phone string")
    src = spark.createDataFrame([(1, 1, "a", None), (1, 2, "b", "p2"), (1, 3, "c", "p3"), (2, 1, "a", "p9")], "id int, prio int, source string, phone string")
    got = {r["id"]: (r["phone"], r["phone_source"]) for r in J.fuse_fill_missing(rec, src, ["phone"]).collect()}
    assert got == {1: ("p2", "b"), 2: ("p0", "record")}


def test_scores(spark):
    df = spark.createDataFrame(
        [("Name", "p", "w", "e", "a", "c", "s", "h", ["x"]), ("Name", "p", "w", None, "", None, None, None, None)],
        "name string, phone string, website string, email string, address string, city string, state string, hours string, services array<string>")
    assert [r[0] for r in df.select(Q.quality_score()).collect()] == [100, 65]
    nums = spark.createDataFrame([(80,), (79,), (60,), (59,)], "n int")
    assert [r[0] for r in nums.select(Q.verification_status(F.col("n"))).collect()] == ["verified", "partial", "partial", "basic"]
    fifteen = spark.createDataFrame([tuple(["x"] * 12 + [None] * 3), tuple(["x"] * 9 + [""] * 6)], ", ".join(f"f{i} string" for i in range(15)))
    assert [r[0] for r in fifteen.select(Q.completeness_score([f"f{i}" for i in range(15)])).collect()] == [80, 60]


def test_cache(spark):
    rows = [("a", "2024-01-01 06:00:00", "2024-01-01 11:59:00"), ("b", "2024-01-01 06:00:00", "2024-01-01 12:00:00"), ("c", "2024-01-01 06:00:00", None),
            ("d", "2024-01-01 06:00:00", "2024-01-01 13:00:00"), ("d", "2024-01-01 07:00:00", "2024-01-01 11:00:00")]
    df = spark.createDataFrame(rows, "url string, cached_at string, expires_at string").withColumns({c: F.col(c).cast("timestamp") for c in ("cached_at", "expires_at")})
    assert sorted(r["url"] for r in S.ttl_cache_lookup(df, "2024-01-01 12:00:00").collect()) == ["b", "c"]


def test_digest(spark):
    rows = [(i, f"t{i}", None, f"u{i}", "a", "2024-01-02 00:00:00" if i < 5 else "2024-01-01 00:00:00", True) for i in range(6)]
    rows += [(7, "both", None, "u7", "a, b", "2024-01-01 12:00:00", True), (8, "raw", None, "u8", "a", "2024-01-01 12:00:00", False), (9, "late", None, "u9", "a", "2024-01-02 00:00:01", True)]
    df = spark.createDataFrame(rows, "id int, title string, translated_title string, url string, categories_list string, published_at string, is_processed boolean")
    df = df.withColumn("published_at", F.col("published_at").cast("timestamp")).withColumn("summary", F.lit(None).cast("string"))
    r = G.digest_period(df, "2024-01-01 00:00:00", "2024-01-02 00:00:00").collect()[0]
    assert r["article_count"] == 6 and r["categories"] == "a, b" and r["content"].count("**both**") == 2
    assert "raw" not in r["content"] and "late" not in r["content"]
    assert G.digest_period(df, "2020-01-01", "2020-01-02").collect() == []


def test_records_of_any_age(spark, tmp_path):
    old = [{"name": "A", "phones": "1, 2", "materials": ["Copper", "Iron"]}, {"name": "B", "phones": ["3"], "materials": "['Sam\\'s', \"O'k\"]", "website": ""}]
    (tmp_path / "r.json").write_text(json.dumps(old))
    (tmp_path / "r.csv").write_text('name,phones,materials,description\nC,"4, 5","[\'Copper\', ""Sam\'s""]","two\nlines ""q"""\nD,,,\n')
    got = {r["name"]: r for r in R.scan_company_records(spark, str(tmp_path / "r.json"), str(tmp_path / "r.csv")).collect()}
    assert got["A"]["phones"] == ["1", "2"] and got["A"]["materials"] == ["Copper", "Iron"]
    assert got["B"]["phones"] == ["3"] and got["B"]["website"] is None
    assert got["C"]["phones"] == ["4", "5"] and got["C"]["materials"] == ["Copper", "Sam's"] and got["C"]["description"] == 'two\nlines "q"'
    assert got["D"]["phones"] is None


def test_run_documents_and_feeds(spark, tmp_path):
    for i, t in enumerate(("2025-10-06T17:12:22", "2025-10-06T16:00:00")):
        (tmp_path / f"run{i}.json").write_text(json.dumps({"stage": 1, "collected_at": t, "urls": [f"u{i}a", f"u{i}b"], "sources": {"rss": 2}}, indent=1))
    heads, urls = R.scan_run_documents(spark, str(tmp_path / "run*.json"))
    assert heads.count() == 2 and urls.count() == 4
    assert sorted(r["url"] for r in R.latest_run(heads, urls).collect()) == ["u0a", "u0b"]
    (tmp_path / "f.xml").write_text("<rss><item><title><![CDATA[T & 1]]></title><link>l1</link></item><item><title>T2</title><link>l2</link></item></rss>")
    assert [(r["pos"], r["url"], r["title"]) for r in R.scan_rss_items(spark, str(tmp_path / "f.xml"), 1).collect()] == [(0, "l1", "T & 1")]
    (tmp_path / "google_1.json").write_text(json.dumps([{"title": "t", "url": "u"}]))
    assert [r["source_file"] for r in R.scan_search_links(spark, str(tmp_path)).collect()] == ["google_1.json"]


def test_truncated_json(spark):
    whole = '{\n  "companies": [\n    {"name": "A"\n    },\n    {"name": "B"\n    }\n  ]\n}'
    cut = whole[: whole.index('"B"') + 2]
    for text, n in ((whole, 2), (cut, 1)):
        assert len(one(spark, text, lambda x: B.companies_of(x))) == n
    assert one(spark, "garbage", lambda x: B.companies_of(x)) is None


def test_dirty_input(spark):
    rows = [None, "", "   ", "Привет мир. 你好", "<p><b>open <a href='x", "{bad json", "x" * 50_000]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "page_id int, html string").withColumn("url", F.lit("not a url"))
    out = df.select(
        H.html_to_text("html"), H.html_main_text("html"), H.html_company_name("html", "url"), H.parse_json_ld("html"), H.html_price_rows("html"),
        C.extract_phones("html"), C.extract_emails("html"), C.phone_candidates("html"), C.parse_us_address("html"), C.social_map("html"), C.working_hours_map("html"),
        T.summary_extractive("html"), T.segment_paragraphs("html"), T.extract_price_struct("html"), T.services_from_text("html"), T.lexicon_confidence("html", L.METAL_TYPES),
        U.url_host("html"), U.unwrap_redirect_url("html"), U.absolute_url("url", "html"), U.score_topic_url("html"), U.filter_article_url("html"))
    assert len(out.collect()) == len(rows)
    assert one(spark, "a &#1055;&#x4f60; &lt;b&gt; &amp;amp;", H.html_to_text) == "a П你 <b> &amp;"


@pytest.mark.parametrize("name", ["vector_theme_topk", "agg_theme_relevance", "vector_similar", "cosine_filter", "vector_stats"])
def test_vector_queries_on_an_empty_table(spark, sf_dir, tmp_path, name):
    from webrec.plans import all_queries

    spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(0).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert all_queries()[name](spark, str(tmp_path)).count() == 0
