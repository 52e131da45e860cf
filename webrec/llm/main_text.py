"""Main text of pages by gradient-boosted trees over DOM nodes.

Every node of a page (blocks and runs of text, see ``dom``) gets features: its
element, tokens of its class, id and role and of those around it, text and link
density of its subtree, depth, its place among its siblings and in the page.
Trees give the log odds that it holds main text. Decoding is hierarchical: a
node can only be taken with its parent, and of all such choices the one with
the highest sum of log odds is taken, so no text is kept inside a dropped
ancestor and no ancestor is kept for nothing. The text of the runs taken is
the result.

The trees are trained on pages composed by rule from the blocks of a bounded
sample of the table: titles, paragraphs, menus, notices and footers of real
pages, in many layouts, with and without telling names.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webrec.llm import gbt
from webrec.llm.base import map_slices
from webrec.llm.dom import GROUPS, TAG_ID, TAGS, Page

SAMPLE = 200
COMPOSED = 600
INNER = ("nav", "aside", "footer", "header", "form", "article", "main")


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of the pages, in order."""
    starts = np.cumsum([0] + [len(p.parent) for p in pages])
    n = int(starts[-1])
    shift = np.repeat(starts[:-1], np.diff(starts))
    flat = lambda name: np.fromiter((v for p in pages for v in getattr(p, name)), np.int64, n)
    parent, tag, depth, own, over, end = (flat(a) for a in ("parent", "tag", "depth", "own", "over", "end"))
    root = parent < 0
    parent, end = np.where(root, np.arange(n), parent + shift), end + shift
    runs = np.array([s + k for s, p in zip(starts, pages) for k in p.text], np.int64)
    texts = [t for p in pages for t in p.text.values()]
    stats = np.zeros((n, 6))
    if len(runs):
        stats[runs, 0] = [len(t) for t in texts]
        stats[runs, 1] = [v for p in pages for v in p.linked.values()]
        stats[runs, 2] = [t.count(" ") + 1 for t in texts]
        stats[runs, 3] = [t.count(",") + t.count(". ") + t.endswith((".", "!", "?")) for t in texts]
        stats[runs, 4] = [sum(map(str.isupper, t)) / len(t) for t in texts]
        stats[runs, 5] = 1
    total = np.vstack([np.zeros((1, 6)), stats.cumsum(0)])
    inside = total[end] - total[np.arange(n)]
    before = total[np.arange(n)] - total[shift]
    whole = np.maximum((total[np.append(starts[1:], 0)[:-1]] - total[starts[:-1]])[np.repeat(np.arange(len(pages)), np.diff(starts))], 1e-9)
    nodes = end - np.arange(n)
    kids = np.bincount(parent[~root], minlength=n)
    # place among siblings: children of one parent in page order
    order = np.argsort(parent, kind="stable")
    order = order[~root[order]]
    first = np.r_[True, parent[order][1:] != parent[order][:-1]] if len(order) else np.zeros(0, bool)
    place, prev, follow = np.zeros(n), np.full(n, -1), np.full(n, -1)
    if len(order):
        heads = np.flatnonzero(first)
        place[order] = np.arange(len(order)) - np.repeat(heads, np.diff(np.r_[heads, len(order)]))
        prev[order[1:]] = np.where(first[1:], -1, order[:-1])
        follow[order[:-1]] = np.where(first[1:], -1, order[1:])
    chars, links, words, marks = inside[:, 0], inside[:, 1], inside[:, 2], inside[:, 3]
    near = lambda at, v: np.where(at < 0, -1, v[at])
    paragraphs = np.zeros(n)
    is_p = (tag == TAG_ID["p"]) & ~root
    np.add.at(paragraphs, parent[is_p], 1)
    bits = lambda v, k: v >> k & 1
    grand = parent[parent]
    columns = [
        chars, np.log1p(words), links / np.maximum(chars, 1), chars / nodes, words / np.maximum(inside[:, 5], 1), marks / np.maximum(words, 1), inside[:, 4] / np.maximum(inside[:, 5], 1), inside[:, 5],
        depth, kids, place, place / np.maximum(kids[parent], 1), kids[parent], chars / np.maximum(chars[parent], 1), near(prev, chars), near(follow, chars), near(prev, tag), near(follow, tag),
        near(prev, links / np.maximum(chars, 1)), near(follow, links / np.maximum(chars, 1)), before[:, 0] / whole[:, 0], chars / whole[:, 0], paragraphs, paragraphs[parent], paragraphs[grand],
        tag[parent], tag[grand], (links / np.maximum(chars, 1))[parent], (chars / nodes)[parent], np.log1p(words)[parent], np.log1p(words)[grand],
        np.isin(tag, [TAG_ID[t] for t in ("h1", "h2", "h3", "h4")]), np.isin(tag, [TAG_ID[t] for t in ("ul", "ol", "li", "dl", "dt", "dd")]), np.isin(tag[parent], [TAG_ID[t] for t in ("h1", "h2")]),
    ]
    columns += [tag == k for k in range(len(TAGS))]
    columns += [bits(own, k) for k in range(len(GROUPS))] + [bits(own[parent], k) for k in range(len(GROUPS))] + [bits(over[parent], k) for k in range(len(GROUPS))]
    columns += [bits(over[parent], len(GROUPS) + TAG_ID[t]) for t in INNER]
    return np.stack([np.asarray(c, np.float32) for c in columns], 1)


def taken(page: Page, logits: np.ndarray) -> list[bool]:
    """The best choice of nodes in which every node's parent is chosen."""
    gain = logits.tolist()
    for k in range(len(gain) - 1, 0, -1):  # children stand behind their parents
        if gain[k] > 0:
            gain[page.parent[k]] += gain[k]
    out = [False] * len(gain)
    for k, p in enumerate(page.parent):
        out[k] = gain[k] > 0 and (p < 0 or out[p])
    return out


def texts_of(pages: list[Page], trees: gbt.Trees) -> list[str]:
    logits, at, out = trees.logits(features(pages)), 0, []
    for page in pages:
        n = len(page.parent)
        keep = taken(page, logits[at : at + n])
        out.append("\n".join(t for k, t in page.text.items() if keep[k]))
        at += n
    return out


# --- training -----------------------------------------------------------------


def blocks_of(html: str) -> dict[str, list[str]]:
    """Texts of a sampled page by the element that they stand in."""
    page, out = Page(html), {"title": [], "prose": [], "small": []}
    for k, text in page.text.items():
        tag = TAGS[page.tag[page.parent[k]]]
        out["title" if tag in ("h1", "h2") else "prose" if tag == "p" and len(text) > 60 else "small"].append(text)
    return out


class Composer:
    """Pages by rule; main runs are marked by a private-use letter."""

    MARK = "\ue000"

    def __init__(self, blocks: list[dict[str, list[str]]], seed: int = 23):
        self.r = random.Random(seed)
        pool = {k: [t for b in blocks for t in b[k]] for k in ("title", "prose", "small")}
        self.words = sorted({w for t in pool["prose"] + pool["title"] + pool["small"] for w in t.split()[:40]})[:5000] or ["lorem", "ipsum", "dolor", "sit", "amet"]
        self.pool = pool

    def some(self, lo: int, hi: int) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(lo, hi)))

    def prose(self) -> str:
        if self.r.random() < 0.2:
            return self.some(3, 14).capitalize() + "."
        if self.pool["prose"] and self.r.random() < 0.7:
            return self.r.choice(self.pool["prose"])
        return ". ".join(self.some(4, 18).capitalize() for _ in range(self.r.randint(1, 6))) + "."

    def short(self) -> str:
        return self.r.choice(self.pool["small"])[:200] if self.pool["small"] and self.r.random() < 0.5 else self.some(1, 8)

    def named(self, names: str, tags: str = "div div section", often: float = 0.8) -> tuple[str, str]:
        tag, r = self.r.choice(tags.split()), self.r
        if r.random() > often:
            return f"<{tag}>", f"</{tag}>"
        return f'<{tag} {r.choice(["class", "class", "id"])}="{r.choice(names.split())}">', f"</{tag}>"

    def esc(self, text: str) -> str:
        return entities.escape(text)

    def links(self, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{k}">{self.esc(self.some(1, 4))}</a></{tag}>' for k in range(self.r.randint(2, 9)))

    def menu(self) -> str:
        a, b = self.named("menu nav navbar main-menu navigation breadcrumb topnav", "nav nav div ul", 0.6)
        return a + ("<ul>" + self.links() + "</ul>" if not a.startswith("<ul") else self.links()) + b

    def ad(self) -> str:
        a, b = self.named("ad ads advert sponsored promo banner-ad ad-slot", "div div aside section", 0.95)
        return a + self.r.choice([self.esc(self.short()), f"<p>{self.esc(self.some(3, 14))}.</p>", f'<a href="/x">{self.esc(self.some(2, 9))}</a>']) + b

    def side(self) -> str:
        a, b = self.named("sidebar related widget side-bar recommended trending", "aside aside div section", 0.85)
        return a + f"<h3>{self.esc(self.some(1, 3))}</h3>" + self.r.choice([f"<ul>{self.links()}</ul>", f"<p>{self.esc(self.some(5, 30))}.</p>", self.links("div")]) + b

    def comments(self) -> str:
        a, b = self.named("comments comment-list reader-comments discussion disqus_thread responses", "section div div", 1.0)
        one = lambda: f'<{self.r.choice(["div", "li", "article"])} class="comment"><p>{self.esc(self.prose())}</p>'
        return a + self.r.choice(["", "<h2>Comments</h2>", "<h3>Reader comments</h3>"]) + "".join(one() + "</div>" for _ in range(self.r.randint(1, 6))) + b

    def notice(self) -> str:
        a, b = self.named("cookie-notice notice consent newsletter alert popup subscribe gdpr", "div div section aside", 0.95)
        return a + f"<p>{self.esc(self.some(5, 30))}.</p>" + self.r.choice(["", "<button>OK</button>"]) + b

    def form(self) -> str:
        return f'<form action="/s"><label>{self.esc(self.some(1, 3))}</label><input name="q"><p>{self.esc(self.some(2, 12))}</p><button>{self.esc(self.some(1, 2))}</button></form>'

    def foot(self) -> str:
        a, b = self.named("footer site-footer copyright bottom", "footer footer div", 0.5)
        return (a if "foot" in a or "copy" in a or "bottom" in a else "<footer>") + self.r.choice([f"&copy; {self.esc(self.short())}", f"<p>{self.esc(self.some(4, 25))}</p><ul>{self.links()}</ul>"]) + (b if "foot" in a or "copy" in a or "bottom" in a else "</footer>")

    def head(self) -> str:
        return "<header>" + self.r.choice(["", f"<p>{self.esc(self.some(1, 5))}</p>", f'<div class="logo">{self.esc(self.some(1, 3))}</div>']) + self.menu() + self.r.choice(["", self.esc(self.some(1, 5))]) + "</header>"

    def block(self, tag: str, text: str) -> str:
        return f"<{tag}>{self.MARK}{text}</{tag}>"

    def story(self) -> str:
        r, out = self.r, []
        title = self.block(r.choice(["h1", "h1", "h2"]), self.esc(r.choice(self.pool["title"]) if self.pool["title"] else self.some(3, 9)))
        out.append(r.choice([title, title, f"<header>{title}</header>"]))
        for _ in range(r.choice([1, 1, 2, 3, 5, 9])):
            kind = r.random()
            if kind < 0.75:
                text = self.esc(self.prose())
                if r.random() < 0.15:
                    text = f"<b>{text}<br>"
                elif r.random() < 0.2:
                    words = text.split(" ")
                    words[0] = f'<a href="/y">{words[0]}</a>'
                    text = " ".join(words)
                out.append(self.block("p", text) if r.random() < 0.9 else f"<p>{self.MARK}{text}")
            elif kind < 0.82:
                out.append(self.block(r.choice(["h2", "h3"]), self.esc(self.some(2, 7))))
            elif kind < 0.88:
                out.append("<ul>" + "".join(self.block("li", self.esc(self.some(3, 15))) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.92:
                out.append(self.block("blockquote", self.esc(self.some(8, 40))))
            elif kind < 0.95:
                out.append(self.block("div", self.esc(self.prose())))
            elif kind < 0.97:
                out.append("<table>" + "".join("<tr>" + "".join(self.block("td", self.esc(self.some(1, 4))) for _ in range(3)) + "</tr>" for _ in range(3)) + "</table>")
            else:
                out.append(self.block("pre", self.esc(self.some(4, 20))))
            if r.random() < 0.12:
                out.append(r.choice([self.ad, self.side, self.notice, self.form])())
        body = "".join(out)
        a, b = r.choice([("<article>", "</article>")] * 3 + [('<article class="post">', "</article>"), ("<main>", "</main>"), self.named("content article-body post entry-content story main", "div div section", 0.9)])
        if r.random() < 0.35:
            c, d = self.named("content wrapper container page inner", "div main section", 0.6)
            a, b = c + a, b + d
        return a + body + b

    def page(self) -> str:
        r = self.r
        parts = [m() for m in (self.head, self.menu, self.ad, self.notice, self.form, self.side) if r.random() < 0.4]
        late = [m() for m in (self.comments, self.side, self.ad, self.notice, self.form) if r.random() < 0.35]
        r.shuffle(parts)
        r.shuffle(late)
        if r.random() < 0.9:
            late.append(self.foot())
        inner = "".join(parts) + self.story() + "".join(late)
        if r.random() < 0.3:
            a, b = self.named("wrapper page container site", "div", 0.7)
            inner = a + inner + b
        return f"<!DOCTYPE html><html><head><title>{self.esc(self.some(2, 6))}</title></head><body>{inner}" + r.choice(["</body></html>", ""])


def train(sample: list[str], composed: int = COMPOSED, rounds: int = 60) -> gbt.Trees:
    """Trees from pages composed of the sample's blocks."""
    composer = Composer([blocks_of(h) for h in sorted(sample)])
    pages = [Page(composer.page()) for _ in range(composed)]
    labels = []
    for p in pages:
        main = [0] * len(p.parent)
        for k in range(len(main) - 1, -1, -1):
            if Composer.MARK in p.text.get(k, ""):
                main[k] = 1
                p.text[k] = p.text[k].replace(Composer.MARK, "")
            if main[k] and p.parent[k] >= 0:
                main[p.parent[k]] = 1
        labels += main
    return gbt.fit(features(pages), np.array(labels, float), rounds)


def fit(pages: DataFrame, sample: int = SAMPLE, id_col: str = "page_id", html_col: str = "html") -> gbt.Trees:
    """Trees for a table of pages, from at most ``sample`` of them, picked by
    a hash of their id. An empty table gives trees of composed words alone."""
    rows = pages.select(F.xxhash64(F.col(id_col).cast("string")).alias("pick"), F.col(html_col).cast("string").alias("html"))
    picks = [r.pick for r in rows.select("pick").distinct().orderBy("pick").limit(sample).collect()]
    found = rows.filter(F.col("pick") <= picks[-1]).dropDuplicates(["pick"]).select("html").collect() if picks else []
    return train([r.html for r in found if r.html])


def extract(pages: DataFrame, trees: gbt.Trees | None = None, sample: int = SAMPLE, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row: ``page_id, url, text, n_chars``. A null, empty or
    textless page has the empty text; repeated rows stay; an empty table gives
    no rows; other columns are not read. Pages of any depth and with any number
    of unclosed tags are read in linear time."""
    trees = trees or fit(pages, sample, id_col, html_col)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))

    def make():
        known: dict[str, int] = {}

        def work(batch):
            texts = texts_of([Page(h, known) for h in batch.column("html").to_pylist()], trees)
            return pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

        return work

    return map_slices(rows, make, "page_id long, url string, text string, n_chars long")


def marked_text(html: str) -> str:
    """The main text of a composed page, by its marks."""
    page = Page(html)
    return "\n".join(t.replace(Composer.MARK, "") for t in page.text.values() if Composer.MARK in t)


def unmarked(html: str) -> str:
    return re.sub(Composer.MARK, "", html)
