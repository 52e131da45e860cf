import html as entities
import re
import time

import numpy as np
import pytest

from webrec.llm import gbt, main_text, queries
from webrec.llm.dom import TAGS, Page


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    return [r.html for r in spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet").orderBy("page_id").collect()]


@pytest.fixture(scope="module")
def trees(sample):
    return main_text.train(sample[:100], composed=400)


def runs(html):
    p = Page(html)
    return [(TAGS[p.tag[p.parent[k]]], t) for k, t in p.text.items()]


def test_tree():
    assert runs("<body><p>a<b>b</b> c<p>d <i>e</p>f</body>") == [("p", "ab c"), ("p", "d e"), ("body", "f")]
    assert runs("<ul><li>1<li>2<ul><li>x</ul>y</ul>z") == [("li", "1"), ("li", "2"), ("li", "x"), ("li", "y"), ("html", "z")]
    assert runs("<div>a</p>b</span>c<br>d &amp; &eacute;&nbsp; e</div>") == [("div", "abc d & é e")]
    assert runs("<head><title>t</title></head><script>var a='<p>no</p>'</script><p title='a>b'>yes <!-- no <p>no --> on</p>") == [("p", "yes on")]
    assert runs("<b><p>one</b> two</p> 1 < 2") == [("p", "one two"), ("html", "1 < 2")]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table>") == [("td", "a"), ("td", "b"), ("td", "c")]
    assert runs("") == [] and runs("<") == [("html", "<")] and runs("<p") == []


def test_nothing_is_lost_behind_an_element():
    for tag in ("object data=x", "svg", "select", "template", "noscript", "math"):
        assert [t for _, t in runs(f"<p>Alpha beta.</p><{tag}><p>Rest of the article.</p>")] == ["Alpha beta.", "Rest of the article."]
    assert runs("<p>Let <math><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow></math> be.</p>") == [("p", "Let x=2 be.")]
    assert runs("<p>See <object data=m.swf>the map</object> here.</p>") == [("p", "See the map here.")]
    assert runs("<p>a<svg><text>no</text></svg>b<select><option>no</select>c<noscript>no</noscript>d</p>") == [("p", "abcd")]
    assert runs("<p>a</p><svg></svg><p>b</p><svg><p>c</p>") == [("p", "a"), ("p", "b"), ("p", "c")]
    assert runs("<p>a</p><script>var x = '<p>no</p>'") == [("p", "a")]


def test_references_end_with_their_piece():
    assert runs("<p>&am<b>p;</b> &amp;<i>lt;</i> &l<!-- -->t; x&#x41;y</p>") == [("p", "&amp; &lt; &lt; xAy")]


def test_upper_case_share_reads_the_whole_run():
    low, high = Page(f"<p>{'a' * 400}</p>"), Page(f"<p>{'a' * 200}{'B' * 200}</p>")
    a, b = main_text.features([low]), main_text.features([high])
    assert (a != b).any()


def test_subtrees_are_stretches(sample):
    for h in sample[:30]:
        p = Page(h)
        for k, parent in enumerate(p.parent):
            assert parent < k < p.end[k] and (parent < 0 or p.end[k] <= p.end[parent])


def test_feature_sums():
    p = Page("<body><div><p>four <a href=x>five</a></p><p>six</p></div>tail</body>")
    x = main_text.features([p, Page("<p>z</p>")])
    chars = {TAGS[t]: c for t, c in zip(p.tag, x[:, 0])}
    assert chars["body"] == 9 + 3 + 4 and chars["div"] == 12
    assert len(x) == len(p.parent) + 3 and np.isfinite(x).all()


def test_boosting():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    t = gbt.fit(x[:1500], y[:1500], rounds=40, depth=3)
    assert ((t.logits(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def brute_taken(page, gain):
    best = (0.0, frozenset())
    n = len(gain)
    for m in range(1 << n):
        if all(not m >> k & 1 or page.parent[k] < 0 or m >> page.parent[k] & 1 for k in range(n)):
            best = max(best, (sum(gain[k] for k in range(n) if m >> k & 1), frozenset(k for k in range(n) if m >> k & 1)), key=lambda b: b[0])
    return best[0]


def test_decoding_is_best_and_consistent():
    r = np.random.default_rng(2)
    page = Page("<body><div><p>a</p><p>b</p></div><div>c<p>d</p></div></body>")
    for _ in range(60):
        gain = r.normal(size=len(page.parent))
        got = main_text.taken(page, gain)
        assert all(not g or p < 0 or got[p] for g, p in zip(got, page.parent))
        assert sum(gain[k] for k, g in enumerate(got) if g) == pytest.approx(brute_taken(page, gain))


def expected(h):
    inner = re.search(r"<article>(.*?)</article>", h, re.S)[1]
    parts = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", " ", x))).strip() for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(x for x in parts if x)


def test_held_out_pages(sample, trees):
    test = sample[100:]
    got = main_text.texts_of([Page(h) for h in test], trees)
    assert sum(g == expected(h) for g, h in zip(got, test)) >= 0.97 * len(test)


def test_unseen_layouts(sample, trees):
    composer = main_text.Composer([main_text.blocks_of(h) for h in sample[100:]], seed=5)
    hits = 0
    for _ in range(100):
        h = composer.page()
        hits += main_text.marked_text(h) == main_text.texts_of([Page(main_text.unmarked(h))], trees)[0]
    assert hits >= 85


def test_boilerplate_by_kind(trees):
    prose = "The river rose in the night, and by the morning the old bridge was gone. Nobody had seen it fall."
    page = (
        '<body><header><nav><a href="/a">Home</a> <a href="/b">News</a></nav>Daily Paper</header><div class="cookie-notice"><p>We use cookies to improve this site.</p></div>'
        f'<div id="main-content"><h1>Bridge lost to flood</h1><p>{prose}</p><div class="advert">Buy boots now.</div><p>{prose} Again &amp; again.</p></div>'
        '<aside class="sidebar"><h3>Related</h3><ul><li><a href="/c">One</a></li><li><a href="/d">Two</a></li></ul></aside>'
        f'<form action="/s"><label>Mail</label><input name="m"><p>Sign up here</p></form><section id="comments"><h2>Comments</h2><div class="comment"><p>{prose}</p></div></section><footer>&copy; 2020 Daily Paper</footer>'
    )
    assert main_text.texts_of([Page(page)], trees)[0] == f"Bridge lost to flood\n{prose}\n{prose} Again & again."


@pytest.mark.parametrize("bad", ["<div>" * 100_000 + "x", "<a>" * 300_000, "<font>a" * 100_000, "<!--" * 200_000, "<nav>" * 100_000, '<p class="x' * 50_000, "<i>" * 50_000 + "</b>" * 50_000, "<b><p>" * 30_000, "<" * 200_000, "<script>" * 50_000, "<svg>" * 50_000, "<select><p>" * 50_000, "<svg></svg>" * 50_000 + "<svg>a" * 50_000])
def test_odd_pages_are_linear(trees, bad):
    start = time.time()
    main_text.texts_of([Page(bad)], trees)
    assert time.time() - start < 30


def test_extract(spark, sf_dir, sample):
    rows = [(1, "u", sample[0], "x"), (2, None, None, None), (3, "u", "", None), (1, "u", sample[0], "x"), (None, None, "<p>only", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = main_text.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert main_text.extract(df.limit(0)).count() == 0
    whole = queries.op6_main_text(spark, sf_dir).collect()
    assert len(whole) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
