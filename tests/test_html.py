"""The HTML layer on odd pages: nesting, missing tags, selectors, size."""

import time

import pytest

from webrec.functions import contacts as C
from webrec.functions import html as H
from webrec.functions.html_select import Steps, compile_selector, html_select_all, select_html
from webrec.functions.html_tree import Tree
from webrec.operators import extraction as X

LONG = "word " * 60


def one(spark, html, column):
    return spark.createDataFrame([(html,)], "html string").select(column.alias("x")).first().x


def hits(html, selector, part="text"):
    return [h[part] for h in select_html(html, {"s": compile_selector(selector)}, (part,))["s"]]


@pytest.mark.parametrize("selector,want", [
    ("div > p", ["direct"]), ("div p", ["direct", "deep"]), ("p:first-child", ["direct", "deep", "one"]), ("p:last-child", ["deep", "two"]),
    ('a[href$=".pdf"]', ["pdf"]), ('a[rel~="next"]', ["rel"]), ('a[title="x, y"]', ["comma"]), ("a[rel]", ["rel"]), ("a[href^=/], p.k", ["two", "pdf"]),
    ("#m p", ["one", "two"]), ("p.k.j", ["two"]), ("section#m > p:first-child", ["one"]), ('a[class*="big"]', []), ("*[rel]", ["rel"]),
])
def test_selectors(selector, want):
    page = '<div><p>direct</p><section><p>deep</p></section></div><section id=m><p>one</p><p class="j k">two</p></section><a href="/f.pdf">pdf</a><a rel="prev next">rel</a><a title="x, y">comma</a>'
    assert hits(page, selector) == want


@pytest.mark.parametrize("selector", ["p:nth-child(2)", "a + b", "", "div >", "a::before", "p !"])
def test_unknown_selectors_raise(selector):
    with pytest.raises(ValueError):
        compile_selector(selector)


def test_markup_and_attributes():
    page = '<ul><li class="a b">x &amp; <b>y</b><li>z<br></ul><script>1 < 2</script>'
    assert hits(page, "ul", "html") == ['<ul><li class="a b">x &amp; <b>y</b></li><li>z<br></li></ul>']
    assert hits(page, "li", "attrs") == [{"class": "a b"}, {}]
    assert hits(page, "script", "html") == ["<script>1 < 2</script>"]
    assert Tree(page).text(-1) == "x & y z"


def test_nested_drops(spark):
    page = "<header><nav>Menu</nav> HEADERTEXT</header><p>kept</p><footer><nav>x</nav>y</footer>tail"
    assert one(spark, page, H.html_to_text("html")) == "kept tail"


def test_main_text(spark):
    main = lambda page: one(spark, page, H.html_main_text("html", 100))
    side = "<aside><div class=content>" + LONG + "</div></aside>"
    assert main(f"<head><title>t</title></head><p>{LONG}</p>") == LONG.strip()
    assert main(f"<body>{side}<div class='article-content'>A {LONG}</div>rest</body>") == "A " + LONG.strip()
    assert main(f"<body><div id=content>short</div><div class='story-body'>B {LONG}</div></body>") == "B " + LONG.strip()
    assert main(f'<body><div data-testid="article-body">C {LONG}</div>') == "C " + LONG.strip()
    assert main("<body><header><nav>m</nav>h</header><p>small</p></body>") == "small"
    assert main("") == ""


def test_links(spark):
    links = lambda page: [tuple(x) for x in one(spark, page, H.link_array("html"))]
    assert links("<a href=/x>u</a><a class=k href='/y'>v <b>w</b></a><a name=n>no</a><!-- <a href='/c'>c</a> -->") == [("/x", "u"), ("/y", "v w")]


def test_whatsapp_is_not_cut(spark):
    page = "".join(f'<a href="https://facebook.com/{i}">f</a>' for i in range(30)) + '<a href="https://wa.me/1">w</a><p>713-868-4111</p>'
    df = spark.createDataFrame([(1, "https://a.org/", page)], "page_id long, url string, html string")
    row = X.extract_company(df).first()
    assert row.whatsapp == ["https://wa.me/1"] and len(row.social_links) == 31


def test_deep_phone(spark):
    phone = lambda ld: one(spark, f'<script type="application/ld+json">{ld}</script>', H.json_ld_deep_phone("html"))
    assert phone('{"contactPoint":{"telephone":"1"},"telephone":"2"}') == "2"
    assert phone('{"phone":"\\u002b1 713","name":"x"}') == "+1 713"
    assert phone('{"a":{"b":[{"telephone":"say \\"7\\""}]}}') == 'say "7"'
    assert phone("{broken") is None


@pytest.mark.parametrize("bad", [
    "<a>" * 60_000, "<a href=x>" * 60_000, "<nav>" * 60_000, "<!--" * 60_000, "<h1>" * 60_000, "<div>" * 100_000 + "x", "<font>a" * 60_000, "<script>" * 60_000,
    '<div itemprop="address">' * 50_000, "<a " * 60_000, '<p class="' * 15_000,
])
def test_unclosed_tags_cost_their_length(spark, bad):
    df = spark.createDataFrame([(1, "https://a.org/", bad + "713-868-4111")], "page_id long, url string, html string")
    start = time.time()
    X.html_links(df).count()
    df.select(H.html_to_text("html"), H.html_main_text("html"), H.html_name("html")).collect()
    X.extract_company(df).collect()
    select_html(bad, {"s": compile_selector("div.x > p a[href]")})
    assert time.time() - start < 60


def test_many_phones(spark):
    page = " ".join(f"({200 + i // 900}) {213 + i % 700}-{1000 + i * 7 % 9000}" for i in range(3000))
    start = time.time()
    found = one(spark, page, C.phone_candidates("html"))
    assert len({c.phone for c in found}) == len(found) > 500 and time.time() - start < 60


@pytest.mark.parametrize("bad", ["<div class='phone'>x" * 100_000, "<p>" + "<span class=\"tel\">713-868-4111 " * 30_000 + "</p>"])
def test_unclosed_class_tags(spark, bad):
    start = time.time()
    found = one(spark, "<b class='phone'>(281) 445-9065</b>" + bad, C.phone_candidates("html"))
    assert ("(281) 445-9065", "css_class") in {(c.phone, c.method) for c in found} and time.time() - start < 60


def test_class_tags_before_and_behind_the_last_end_tag(spark):
    page = "<DIV class='contact'>713-868-4111</div> <div class='phone'>281-445-9065 <span class='tel'>832-467-0147</SPAN> <p class='phone'>409-763-2211"
    found = one(spark, page, C.phone_candidates("html"))
    assert {c.phone for c in found if c.method == "css_class"} == {"(713) 868-4111", "(832) 467-0147"}


def test_cut_references_stay(spark):
    page = '<body><article><h1>t</h1>R&amp;D and&amp <a href="/x?a=1&copy=2&amp;b=3">l&lt;</a> &notit; &#65;&#x42; end&am</article></body>'
    want = "t R&D and&amp l< &notit; AB end&am"
    assert one(spark, page, H.html_to_text("html")) == want
    assert one(spark, page, H.html_main_text("html", 5)) == want
    assert hits(page, "a", "attrs") == [{"href": "/x?a=1&copy=2&b=3"}]


def test_selectors_are_filed_once_for_many_pages(spark, monkeypatch):
    """More pages than are worked on at once, empty ones included, in one task."""
    pages = [(i, None if i % 50 == 7 else f'<div class="a">t{i}</div><p id=x title="v">' * (i % 3)) for i in range(200)]
    df = spark.createDataFrame(pages, "i int, html string").coalesce(1)
    got = df.select("i", html_select_all("html", {"d": ".a", "p": "p#x"}, ("text", "attrs")).alias("s")).orderBy("i").collect()
    for i, s in got:
        n = 0 if i % 50 == 7 else i % 3
        assert [h.text for h in s.d] == [f"t{i}"] * n
        assert [h.attrs for h in s.p] == [{"id": "x", "title": "v"}] * n
    made = []
    plain = Steps.__init__
    monkeypatch.setattr(Steps, "__init__", lambda self, compiled: (made.append(1), plain(self, compiled))[1])
    steps = Steps({"d": compile_selector(".a")})
    assert [len(select_html(h or "", steps)["d"]) for _, h in pages[:9]] == [0, 1, 2, 0, 1, 2, 0, 0, 2]
    assert len(made) == 1
