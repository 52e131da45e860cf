"""Builders for check SQL (plain SQL run by another engine in tests)."""

from __future__ import annotations


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words) -> str:
    return "[" + ", ".join(lit(w) for w in words) + "]"


def has_any(expr: str, words) -> str:
    """Some word is a substring of expr."""
    return "(" + " OR ".join(f"contains({expr}, {lit(w)})" for w in words) + ")"


def n_hits(expr: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({expr}, {lit(w)}) AS INT)" for w in words) + ")"


def sub_of(host: str, domains) -> str:
    """Host is one of the domains or below one."""
    return "(" + " OR ".join(f"{host} = {lit(d)} OR ends_with({host}, {lit('.' + d)})" for d in domains) + ")"


def words_in(expr: str, words) -> str:
    return f"[w for w in {lst(words)} if contains({expr}, w)]"


def netloc(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def path(u: str) -> str:
    """Between authority and ? or #."""
    return f"regexp_extract(regexp_replace({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '^[^?#]*')"


def querystr(u: str) -> str:
    return f"CASE WHEN contains({u}, '?') THEN split_part({u}[strpos({u}, '?') + 1:], '#', 1) ELSE '' END"


def distinct(l: str) -> str:
    """Distinct elements in order of first appearance."""
    return f"list_filter({l}, lambda x, i: list_position({l}, x) = i)"


def plain(x: str) -> str:
    """Markup to text: tags to space, whitespace squeezed, names decoded."""
    t = f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"
    for name, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        t = f"replace({t}, '{name}', '{char}')"
    return t


def without(html: str, tags: str) -> str:
    """Comments and whole elements out."""
    t = f"regexp_replace({html}, '<!--.*?-->', ' ', 'gs')"
    return f"regexp_replace({t}, '<(?:{tags})\\b.*?</(?:{tags})\\s*>', ' ', 'gsi')"


def inner(html: str, tag: str) -> str:
    return f"regexp_extract({html}, '(?is)<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1)"
