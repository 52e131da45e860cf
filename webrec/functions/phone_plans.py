"""Phone numbers of several countries in running text.

A plan says how a country's numbers look: calling code, trunk digit, which
national numbers are valid, and which of them are written without the trunk.
Calling codes are free of prefixes, so a number written with ``+`` or ``00``
has one plan at most; others are read by the plan of the page's country."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions.common import all_matches, at_most, col, let, text
from webrec.functions.contacts import extract_phones


@dataclass(frozen=True)
class Plan:
    code: str
    trunk: str
    valid: str
    bare: str = ""  # numbers that need no trunk


# fixed values: public numbering plans, by region
PLANS = {
    "US": Plan("1", "1", r"[2-9]\d{2}[2-9]\d{6}", r"[2-9]\d{2}[2-9]\d{6}"),
    "GB": Plan("44", "0", r"[1-357-9]\d{9}|[18]\d{8}"),
    "AU": Plan("61", "0", r"[2-478]\d{8}|1[38]00\d{6}|13\d{4}", r"1[38]00\d{6}"),
    "NZ": Plan("64", "0", r"[34679]\d{7}|2\d{7,9}|[58]0\d{6,8}"),
    "IE": Plan("353", "0", r"1\d{7}|[24-79]\d{6,8}|8\d{8}"),
    "IN": Plan("91", "0", r"[1-9]\d{9}", r"[6-9]\d{9}"),
    "ZA": Plan("27", "0", r"[1-8]\d{8}"),
}
#: Regions that share a plan.
SAME_PLAN = {"CA": "US"}

_CANDIDATE = r"(?<![\w+.])(?:\+|00)?\(?\d(?:[ .()\-\x{A0}]{0,2}\d){6,14}(?!\d)"


def region_of(country: Column | str, codes=L.COUNTRY_REGION_CODES, default: str = "US") -> Column:
    """Region of a country's name; the default where it has none here."""
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(text(country)))), F.lit(default))


def _write(plan: Plan, national: Column) -> Column:
    if plan.code == "1":
        return F.regexp_replace(national, r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")
    return F.concat(F.lit(f"+{plan.code} "), national)


def plan_number(number: Column, region: Column, plans=PLANS) -> Column:
    """A number as ``+<code> <national>``, North American ones as
    ``(AAA) EEE-NNNN``; null where no plan knows it."""
    home = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in SAME_PLAN.items() for x in pair]), region), region)
    seen = F.struct(F.regexp_replace(number, r"\D", "").alias("digits"), number.rlike(r"^\(?\+|^\(?00").alias("abroad"), home.alias("home"))

    def abroad(plan: Plan, whole: Column) -> Column:
        # a trunk in brackets behind the code, "+44 (0)20", is not dialled
        after = F.regexp_replace(F.substr(whole, F.lit(len(plan.code) + 1)), f"^{plan.trunk}" if plan.trunk == "0" else "^$", "")
        return F.when(whole.startswith(plan.code) & after.rlike(f"^(?:{plan.valid})$"), _write(plan, after))

    def inland(name: str, plan: Plan, n: Column) -> Column:
        short = F.regexp_replace(n["digits"], f"^{plan.trunk}", "")
        bare = n["digits"].rlike(f"^(?:{plan.bare})$") if plan.bare else F.lit(False)
        return (
            F.when((n["home"] == name) & bare, _write(plan, n["digits"]))
            .when((n["home"] == name) & n["digits"].startswith(plan.trunk) & short.rlike(f"^(?:{plan.valid})$"), _write(plan, short))
        )

    # what all plans ask for is worked out once
    def read(n):
        far = let(F.regexp_replace(n["digits"], "^00", ""), lambda whole: F.coalesce(*[abroad(p, whole) for p in plans.values()]))
        return F.when(n["abroad"], far).otherwise(F.coalesce(*[inland(k, p, n) for k, p in plans.items()]))

    return let(seen, read)


def extract_phones_by_region(body: Column | str, region: Column | str, plans=PLANS, limit: int | None = None) -> Column:
    """Distinct numbers of the text in page order: international ones of every
    plan, national ones of the region's plan. Of digits that go on behind a
    blank (a date, a second number), the longest part up to a blank counts."""
    def one(candidate):
        words = F.split(candidate, " ")
        starts = F.transform(F.sequence(F.size(words), F.lit(1)), lambda n: plan_number(F.array_join(F.slice(words, 1, n), " "), col(region), plans))
        return F.get(F.filter(starts, lambda p: p.isNotNull()), F.lit(0))

    found = F.transform(all_matches(text(body), _CANDIDATE), one)
    return at_most(F.array_distinct(F.filter(found, lambda p: p.isNotNull())), limit)


def page_phones(body: Column | str, region: Column) -> Column:
    """Numbers by the plans. North American pages, and pages without any, also
    give what ten digits in a row of blocks look like."""
    loose = extract_phones(body)

    def both(v):
        american = v["region"].isin("US", "CA")
        return F.when(american, F.array_distinct(F.concat(loose, v["own"]))).when(F.size(v["own"]) > 0, v["own"]).otherwise(loose)

    # the region once for a page, not for every number and plan
    own = lambda r: F.struct(r.alias("region"), extract_phones_by_region(body, r).alias("own"))
    return let(let(region, own), both)
