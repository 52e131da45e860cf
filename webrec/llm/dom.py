"""Pages as flat trees of blocks, in one linear pass without recursion.

A node is a block element or a run, the text between two block boundaries.
Inline elements make no node; their links count. Scripts, styles, comments and
the head are left out. Unclosed and misnested tags are met as browsers do:
paragraphs, list items and cells end where the next begins, an end tag closes
what is open inside its element, one without a start is ignored, and the end of
an inline element does not close a block.

Raw text elements go with all up to their end tag, as in browsers to the end of
the page without one. Elements whose content is no page text (``HIDDEN``) go
where they are closed; an unclosed one is an ordinary element, so nothing
behind it is lost. Formulas and the fallback of objects are text.
"""

from __future__ import annotations

import html as entities
import re

# fixed values: kinds of elements
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture source".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE |= frozenset("object math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose semantics annotation".split())
RAW = frozenset("script style textarea title iframe".split())
HIDDEN = frozenset("template noscript svg select".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
SCOPES = frozenset("ul ol dl table body html article section div".split())
TAGS = (
    "run", "html", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "nav", "aside", "header", "footer", "form",
    "table", "tr", "td", "th", "figure", "figcaption", "blockquote", "pre", "dl", "dt", "dd", "address", "button", "other",
)
TAG_ID = {t: k for k, t in enumerate(TAGS)}
TOKENS = {
    "content": "article content main story entry articlebody post body text page read news blog prose", "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pager pagination",
    "ad": "ad ads adv advert adverts advertisement sponsor sponsored promo promoted banner adsense dfp", "side": "sidebar aside side related widget recommended recommendations more trending popular rail teaser teasers",
    "comment": "comment comments commentlist reply replies respond disqus discussion reader thread responses", "notice": "cookie cookies notice consent gdpr alert modal popup overlay subscribe newsletter paywall banner toast",
    "foot": "footer foot copyright colophon legal bottom", "head": "header head masthead logo topbar top site brand", "form": "form search login signup register contact input field",
    "share": "share sharing social tags meta byline author", "hidden": "hidden none invisible offscreen sr",
}
GROUPS = tuple(TOKENS)
GROUP_OF = {}
for _k, _words in enumerate(TOKENS.values()):
    for _w in _words.split():
        GROUP_OF[_w] = GROUP_OF.get(_w, 0) | 1 << _k
ATTRIBUTE = re.compile(r"""([a-zA-Z:-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
WORDS = re.compile(r"[a-z]+")
#: HTML's own white space.
SPACE = re.compile(r"\s+")


def groups(attributes: str) -> int:
    """Bits of the token groups named in class, id, role and itemprop."""
    bits = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "aria-label"):
            for w in WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()):
                bits |= GROUP_OF.get(w, 0)
        elif name == "style" and "none" in (a or b or c).lower():
            bits |= 1 << GROUPS.index("hidden")
    if " hidden" in attributes.lower():
        bits |= 1 << GROUPS.index("hidden")
    return bits


class Page:
    """Nodes in page order: parallel lists, one entry per node."""

    def __init__(self, html: str, known: dict[str, int] | None = None):
        self.parent, self.tag, self.depth, self.own, self.over, self.end = [], [], [], [], [], []
        self.text: dict[int, str] = {}
        self.linked: dict[int, int] = {}
        self.known = known if known is not None else {}
        self._parse(html)

    def _node(self, parent: int, tag: str, bits: int) -> int:
        n = len(self.parent)
        self.parent.append(parent)
        self.tag.append(TAG_ID.get(tag, TAG_ID["other"]))
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.own.append(bits)
        self.over.append((self.over[parent] if parent >= 0 else 0) | bits | (1 << (len(GROUPS) + TAG_ID[tag]) if tag in ("nav", "aside", "footer", "header", "form", "article", "main") else 0))
        self.end.append(0)
        return n

    def _parse(self, html: str) -> None:
        root = self._node(-1, "html", 0)
        names, nodes = ["html"], [root]  # open elements; inline ones have node -1
        at_name: dict[str, list[int]] = {"html": [0]}  # places of a name among them
        blocks = [0]  # places of block elements among them
        piece: list[str] = []
        links = 0

        def flush() -> None:
            nonlocal links
            if piece:
                text = SPACE.sub(" ", "".join(piece)).strip()
                piece.clear()
                if text:
                    n = self._node(nodes[blocks[-1]], "run", 0)
                    self.end[n] = n + 1
                    self.text[n], self.linked[n] = text, min(links, len(text))
            links = 0

        def close(down_to: int) -> None:
            """Ends all open elements from that place on."""
            if blocks[-1] >= down_to:
                flush()
            while len(names) > down_to:
                at_name[names.pop()].pop()
                n = nodes.pop()
                if n >= 0:
                    blocks.pop()
                    self.end[n] = len(self.parent)

        def implied(tag: str) -> None:
            for open_tag, closers in CLOSED_BY.items():
                places = at_name.get(open_tag)
                if tag in closers and places:
                    # not beyond the nearest list, table or section of its own
                    if not any((p := at_name.get(s)) and p[-1] > places[-1] for s in SCOPES):
                        close(places[-1])

        at, n, size = 0, len(html), len
        quotes = {'"': True, "'": True}  # whether another may follow
        endless: set[str] = set()  # tags without another end tag
        while at < n:
            lt = html.find("<", at)
            if lt < 0:
                lt = n
            if lt > at:
                part = entities.unescape(html[at:lt])  # a reference does not go on behind a tag
                piece.append(part)
                if at_name.get("a"):
                    links += size(part)
            if lt == n:
                break
            nxt = html[lt + 1 : lt + 2]
            if nxt == "!" or nxt == "?":
                if html.startswith("<!--", lt):
                    gt = html.find("-->", lt + 4)
                    at = n if gt < 0 else gt + 3
                else:
                    gt = html.find(">", lt)
                    at = n if gt < 0 else gt + 1
                continue
            closing = nxt == "/"
            m = NAME.match(html, lt + 2 if closing else lt + 1)
            if not m:
                piece.append("<")
                at = lt + 1
                continue
            gt = html.find(">", m.end())
            if gt < 0:
                break  # an unfinished tag to the end
            if not closing:
                for q in quotes:  # a > inside quotes
                    while quotes[q] and html.count(q, m.end(), gt) % 2:
                        back = html.find(q, gt)
                        after = html.find(">", back) if back >= 0 else -1
                        if after < 0:
                            quotes[q] = False
                        else:
                            gt = after
            tag, attributes = m[0].lower(), html[m.end() : gt]
            at = gt + 1
            if closing:
                places = at_name.get(tag)
                if tag in INLINE:
                    if places and places[-1] > blocks[-1]:
                        close(places[-1])
                elif places and tag not in ("html", "body"):
                    close(places[-1])
                continue
            if tag in ("html", "body"):
                if tag == "body" and not at_name.get("body"):
                    flush()
                    at_name.setdefault("body", []).append(len(names))
                    blocks.append(len(names))
                    names.append("body")
                    nodes.append(self._node(nodes[0], "body", 0))
                continue
            if (tag in RAW or tag in HIDDEN) and tag not in endless and not attributes.endswith("/"):
                m = re.compile(f"</{tag}", re.I).search(html, at)
                gt = html.find(">", m.end()) if m else -1
                if gt >= 0 or tag in RAW:
                    at = n if gt < 0 else gt + 1
                    continue
                endless.add(tag)
            if tag == "head" or tag in VOID or tag in INLINE and attributes.endswith("/"):
                if tag == "br":
                    piece.append(" ")
                elif tag == "hr":
                    flush()
                continue
            bits = 0
            if "=" in attributes or "hidden" in attributes:
                bits = self.known.get(attributes)
                if bits is None:
                    if size(self.known) > 50_000:
                        self.known.clear()
                    bits = self.known[attributes] = groups(attributes)
            if tag in INLINE:
                at_name.setdefault(tag, []).append(len(names))
                names.append(tag)
                nodes.append(-1)
                continue
            implied(tag)
            flush()
            if attributes.endswith("/") and tag not in TAG_ID:
                continue
            at_name.setdefault(tag, []).append(len(names))
            node = self._node(nodes[blocks[-1]], tag, bits)
            blocks.append(len(names))
            names.append(tag)
            nodes.append(node)
        close(0)
