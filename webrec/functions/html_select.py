"""CSS selection over HTML text: the one thing column expressions cannot say.

An Arrow-batched Python function reads each page once into a flat tree and
answers all wanted selectors. Supported: tag, ``*``, ``.class``, ``#id``,
``[attr]`` with ``=``, ``^=``, ``$=``, ``*=`` and ``~=``, ``:first-child``,
``:last-child``, descendants by space, children by ``>``, alternatives by comma.
Anything else raises ``ValueError`` when the plan is built.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webrec.functions.common import col
from webrec.functions.html_tree import Tree

HIT = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("html", T.StringType()),
])

_TEST = re.compile(
    r"""(?P<tag>\*|[a-zA-Z][\w-]*)|[.](?P<class>[\w-]+)|[#](?P<id>[\w-]+)|:(?P<place>first-child|last-child)
    |\[\s*(?P<attr>[\w-]+)\s*(?:(?P<op>[*^$~]?=)\s*(?:"(?P<v1>[^"]*)"|'(?P<v2>[^']*)'|(?P<v3>[^\]\s]*))\s*)?\]""",
    re.X,
)
_GAP = re.compile(r"\s*(>|,)\s*|\s+")

#: One compound: (tests, how it hangs on the one before: "", " " or ">").
Compound = tuple[list[tuple[str, str, str]], str]


def compile_selector(selector: str) -> list[list[Compound]]:
    """Alternatives, each a list of compounds from left to right."""
    out: list[list[Compound]] = []
    steps: list[Compound] = []
    at, link, wanted, text = 0, "", True, selector.strip()
    while at < len(text):
        if not wanted and (m := _GAP.match(text, at)):
            at, link = m.end(), m[1] or " "
            if link == ",":
                out.append(steps)
                steps, link = [], ""
            wanted = True
            continue
        tests = []
        while m := _TEST.match(text, at):
            if m["tag"] and tests:
                break
            if m["attr"]:
                tests.append((m["op"] or "has", m["attr"].lower(), m["v1"] or m["v2"] or m["v3"] or ""))
            else:
                kind = m.lastgroup
                tests.append((kind, (m[kind].lower() if kind == "tag" else m[kind]), ""))
            at = m.end()
        if not tests:
            raise ValueError(f"selector not understood at {text[at:]!r} in {selector!r}")
        steps.append((tests, link))
        wanted = False
    if wanted:
        raise ValueError(f"selector ends too early: {selector!r}")
    return [*out, steps]


class Steps:
    """The compounds of all wanted selectors, numbered and filed; made once for
    many pages."""

    def __init__(self, compiled: Mapping[str, list]):
        self.names = list(compiled)
        self.steps: list[tuple] = []
        self.goals: dict[int, list[str]] = {}
        self.filed: dict[tuple[str, str], list[int]] = {}
        words = set()
        for name, alternatives in compiled.items():
            for chain in alternatives:
                for i, (tests, link) in enumerate(chain):
                    rank = {"id": 0, "class": 1, "tag": 3, "place": 4}
                    kind, word, _ = min(tests, key=lambda t: rank.get(t[0], 2))
                    kind = kind if kind in rank else "attr"
                    key = ("tag", "*") if kind == "place" else (kind, word)
                    if kind in ("id", "class", "attr"):
                        words.add(word)
                    self.filed.setdefault(key, []).append(len(self.steps))
                    self.steps.append((tests, link if i else "", len(self.steps) - 1))
                self.goals.setdefault(len(self.steps) - 1, []).append(name)
        self.may = re.compile("|".join(map(re.escape, sorted(words))), re.I) if words else None
        self.goal = sum(1 << b for b in self.goals)
        self.attributes = {w for k, w in self.filed if k == "attr"}
        self.everywhere = self.filed.get(("tag", "*"), [])


class _Matcher:
    def __init__(self, tree: Tree):
        self.tree = tree
        self.first, self.last = tree.siblings()

    def fits(self, k: int, tests) -> bool:
        tree = self.tree
        for kind, name, value in tests:
            if kind == "tag":
                if name not in ("*", tree.tag[k]):
                    return False
            elif kind == "class":
                if not tree.has_words(k, name) or name not in tree.attrs(k).get("class", "").split():
                    return False
            elif kind == "id":
                if not tree.has_words(k, name) or tree.attrs(k).get("id") != name:
                    return False
            elif kind == "place":
                if not (self.first if name == "first-child" else self.last)[k]:
                    return False
            else:
                have = tree.attrs(k).get(name)
                if have is None or not (
                    kind == "has" or (kind == "=" and have == value) or (kind == "~=" and value in have.split())
                    or (value != "" and ((kind == "^=" and have.startswith(value)) or (kind == "$=" and have.endswith(value)) or (kind == "*=" and value in have)))
                ):
                    return False
        return True

    def hits_all(self, asked: Mapping[str, list] | Steps) -> dict[str, list[int]]:
        """Matching nodes of every selector, in page order, from one walk down
        the page. Each compound of each selector is a bit; a node carries the
        bits met at it and at or above it, so depth costs nothing. A compound
        is filed under one thing it asks for (id, class, attribute or tag), so
        a node is tested only against those it may fit."""
        plan = asked if isinstance(asked, Steps) else Steps(asked)
        tree, steps, goals, filed, may, goal = self.tree, plan.steps, plan.goals, plan.filed, plan.may, plan.goal
        found: dict[str, list[int]] = {name: [] for name in plan.names}
        above, here = [], []
        for k, p in enumerate(tree.parent):
            over, own = (above[p], here[p]) if p >= 0 else (0, 0)
            asked = [*plan.everywhere, *filed.get(("tag", tree.tag[k]), ())]
            if may and may.search(tree._source[k]):
                attrs = tree.attrs(k)
                for c in dict.fromkeys(attrs.get("class", "").split()):
                    asked += filed.get(("class", c), ())
                if "id" in attrs:
                    asked += filed.get(("id", attrs["id"]), ())
                for a in plan.attributes & attrs.keys():
                    asked += filed.get(("attr", a), ())
            bits = 0
            for b in asked:
                tests, link, before = steps[b]
                if (not link or (over if link == " " else own) >> before & 1) and self.fits(k, tests):
                    bits |= 1 << b
            if bits & goal:
                for name in dict.fromkeys(n for b, names in goals.items() if bits >> b & 1 for n in names):
                    found[name].append(k)
            here.append(bits)
            above.append(over | bits)
        return found


def select_html(html: str, compiled: Mapping[str, list] | Steps, parts: Sequence[str] = ("text", "attrs", "html")) -> dict:
    """Hits of each selector; only the wanted parts of a hit are made."""
    tree = Tree(html)
    matcher = _Matcher(tree)
    make = {"text": tree.text, "attrs": lambda k: dict(tree.attrs(k)), "html": tree.markup}
    return {name: [{p: make[p](k) for p in parts} for k in hits] for name, hits in matcher.hits_all(compiled).items()}


# fixed value: pages whose hits are Python objects at a time
PAGES_AT_ONCE = 64


def html_select_all(html: Column | str, selectors: Mapping[str, str], parts: Sequence[str] = ("text", "attrs", "html")) -> Column:
    """Struct with one array of hits per selector; the page is read once for
    all of them, and only the wanted ``parts`` of a hit are made. Pages and
    hits wait in Arrow; as Python objects there are those of a few pages only,
    whatever the size of a batch."""
    names, parts = list(selectors), tuple(parts)
    hit = T.StructType([f for f in HIT.fields if f.name in parts])
    schema = T.StructType([T.StructField(n, T.ArrayType(hit)) for n in names])
    steps = Steps({n: compile_selector(s) for n, s in selectors.items()})
    kinds = {"text": pa.string(), "attrs": pa.map_(pa.string(), pa.string()), "html": pa.string()}
    kind = pa.struct([(n, pa.list_(pa.struct([(f.name, kinds[f.name]) for f in hit.fields]))) for n in names])

    @F.arrow_udf(schema)
    def run(pages: pa.Array) -> pa.Array:
        done = [pa.array([], kind)]
        for at in range(0, len(pages), PAGES_AT_ONCE):
            done.append(pa.array([select_html(p.as_py() or "", steps, parts) for p in pages.slice(at, PAGES_AT_ONCE)], kind))
        return pa.concat_arrays(done)

    return run(col(html))


def html_select(html: Column | str, selector: str, parts: Sequence[str] = ("text", "attrs", "html")) -> Column:
    """Array of {text, attrs, html} of the elements a selector picks."""
    return html_select_all(html, {"hits": selector}, parts)["hits"]


def first_text(hits: Column) -> Column:
    return F.get(hits, F.lit(0))["text"]


def page_text(html: Column | str, drop: Sequence[str]) -> Column:
    """Text of the page without the dropped elements, nested ones included."""
    without = frozenset(drop)

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([Tree(p or "").text(-1, without) for p in pages], dtype="object")

    return run(col(html))


def main_text(html: Column | str, selectors: Sequence[str], drop: Sequence[str], min_chars: int) -> Column:
    """Text of the first selector whose first hit has more than ``min_chars``
    characters; else of the body, or of a page without body tags all behind
    the head."""
    without, compiled = frozenset(drop), Steps({s: compile_selector(s) for s in selectors})

    def one(html: str) -> str:
        tree = Tree(html)
        found = _Matcher(tree).hits_all(compiled)
        dropped = set()
        k = 0
        while k < len(tree.tag):
            if tree.tag[k] in without:
                dropped.update(range(k, tree.last[k] + 1))
                k = tree.last[k]
            k += 1
        for s in compiled.names:
            hit = next((k for k in found[s] if k not in dropped), None)
            if hit is not None and len(text := tree.text(hit, without)) > min_chars:
                return text
        if "body" in tree.tag:
            return tree.text(tree.tag.index("body"), without)
        return tree.text(-1, without | {"head"})

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([one(p or "") for p in pages], dtype="object")

    return run(col(html))
