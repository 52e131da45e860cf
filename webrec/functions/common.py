"""Small Column helpers shared by all function modules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Column | str) -> Column:
    """Null-safe text."""
    return F.coalesce(col(c), F.lit(""))


def filled(c: Column | str) -> Column:
    """The value is there: not null and not the empty string."""
    c = col(c)
    return c.isNotNull() & (c != "")


def filled_array(c: Column | str) -> Column:
    c = col(c)
    return c.isNotNull() & (F.size(c) > 0)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"^\s+|\s+$", "")


def squeeze(c: Column | str) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(col(c), r"\s+", " "))


def any_of(conds: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def quoted(word: str) -> str:
    """Word as a literal inside a pattern."""
    return re.sub(r"([\\\\.^$|?*+()\[\]{}\-])", r"\\\1", word)


def either(words: Sequence[str]) -> str:
    return "(?:" + "|".join(quoted(w) for w in words) + ")"


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """True if any word occurs as a substring of a short value (URL, host,
    name). One literal pattern evaluates the input once however long the list;
    it is compiled once per task and stays inside whole-stage code."""
    if len(words) <= 2:
        return any_of([c.contains(w) for w in words])
    return c.rlike(either(words))


def text_has_any(c: Column, words: Sequence[str]) -> Column:
    """``contains_any`` for long text: byte searches that stop at the first hit
    beat an alternation there by far."""
    return let(c, lambda x: any_of([x.contains(w) for w in words]))


def let(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once per row, for expressions that
    read it dozens of times (they would otherwise outgrow generated code)."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def weighted_contains(c: Column, weights: Sequence[tuple[str, int]]) -> Column:
    """Sum of the weights of the words that occur as a substring."""
    table = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(n).alias("n")) for w, n in weights])
    return let(c, lambda x: F.aggregate(
        table, F.lit(0), lambda acc, e: acc + F.when(x.contains(e["w"]), e["n"]).otherwise(0)))


def count_contains(c: Column, words: Sequence[str]) -> Column:
    """How many of the words occur as a substring."""
    return weighted_contains(c, [(w, 1) for w in words])


def matched_words(c: Column, words: Sequence[str]) -> Column:
    """Array of the words that occur, in list order."""
    return let(c, lambda x: F.filter(F.array(*[F.lit(w) for w in words]), lambda w: x.contains(w)))


def matched_labels(pairs: Sequence[tuple[str, Column]]) -> Column:
    """Array of labels whose condition holds, in list order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(label)) for label, cond in pairs]))


def labels_text(pairs: Sequence[tuple[str, Column]], sep: str = ", ") -> Column:
    """Labels whose condition holds, joined. No array, no lambda."""
    return F.concat_ws(sep, *[F.when(cond, F.lit(label)) for label, cond in pairs])


def in_domains(host: Column, domains: Sequence[str]) -> Column:
    """Host equals one of the domains or is a subdomain of one."""
    return host.rlike(r"(?:^|\.)" + either(domains) + "$")


def first_match(c: Column, pattern: str, group: int = 1) -> Column:
    """First regex match as value, null where there is none."""
    return blank_to_null(F.regexp_extract(c, pattern, group))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def first_of(*cols: Column) -> Column:
    """First filled value."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def cut(c: Column, n: int | None) -> Column:
    """The first n characters; all of them without n."""
    return c if n is None else F.substring(c, 1, n)


def at_most(items: Column, n: int | None) -> Column:
    """The first n elements; all of them without n."""
    return items if n is None else F.slice(items, 1, n)
