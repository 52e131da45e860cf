"""Phones, e-mails, addresses, hours, social links: extract, normalise, check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions.common import (
    all_matches, at_most, blank_to_null, col, contains_any, cut, filled, first_match, first_of, let, squeeze, strip, text,
)
from webrec.functions.html import drop_raw, elements, json_ld_deep_phone


# The patterns below are tried at the start of a run of their characters only
# (or where the last hit ended): inside a run no later start can do better, and
# a long run (encoded data in a page) would cost its length squared.
_LOCAL = r"[A-Za-z0-9._%+\-]"
_EMAIL_TAIL = r"@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
_EMAIL_RUN = rf"(?:\G|(?<!{_LOCAL}))(?={_LOCAL}++@)"
EMAIL_AT_BOUNDARY = rf"{_EMAIL_RUN}{_LOCAL}*?\b({_LOCAL}+{_EMAIL_TAIL})\b"
EMAIL_ANYWHERE = rf"{_EMAIL_RUN}({_LOCAL}+{_EMAIL_TAIL})"


# -- e-mails ------------------------------------------------------------------
def extract_emails(body: Column | str, limit: int | None = None) -> Column:
    """Distinct in order of appearance."""
    return at_most(F.array_distinct(all_matches(text(body), EMAIL_AT_BOUNDARY, 1)), limit)


def extract_business_emails(body: Column | str, spam=L.EMAIL_SPAM_WORDS, limit: int | None = None) -> Column:
    """Lower case, without no-reply and sample addresses."""
    found = F.transform(all_matches(text(body), EMAIL_AT_BOUNDARY, 1), F.lower)
    return at_most(F.array_distinct(F.filter(found, lambda e: ~contains_any(e, spam))), limit)


def extract_mailto(html: Column | str) -> Column:
    """Addresses of mailto links, without the part after ``?``."""
    found = all_matches(text(html), r"(?i)\bhref\s*=\s*[\"']mailto:([^\"'?]*)", 1)
    return F.array_distinct(F.filter(F.transform(found, lambda e: F.lower(F.trim(e))), lambda e: e.rlike(L.EMAIL_FULL)))


def validate_email(email: Column | str, *, exclude: Sequence[str] = L.EMAIL_EXCLUDE_SUBSTRINGS, test_domains: Sequence[str] | None = None) -> Column:
    """Full match, and no excluded substring; with ``test_domains`` the domain
    must not be exactly one of them instead."""
    e = text(email)
    if test_domains is not None:
        return e.rlike(L.EMAIL_FULL) & ~F.lower(F.element_at(F.split(e, "@"), -1)).isin(*test_domains)
    return e.rlike(L.EMAIL_FULL) & ~contains_any(F.lower(e), exclude)


def extract_email_first(body: Column | str, skip=L.EMAIL_FIRST_SKIP) -> Column:
    found = F.transform(all_matches(text(body), EMAIL_ANYWHERE, 1), F.lower)
    return F.get(F.filter(found, lambda e: ~contains_any(e, skip)), F.lit(0))


# -- phones -------------------------------------------------------------------
# fixed values: patterns in order of trust
US_PHONE_PATTERNS = [
    r"\(\d{3}\)\s*\d{3}[-.\s]*\d{4}\b",
    r"\b\d{3}[-.\s]*\d{3}[-.\s]*\d{4}\b",
    r"\b\d{3}\.\d{3}\.\d{4}\b",
    r"\b1[-.\s]*\d{3}[-.\s]*\d{3}[-.\s]*\d{4}\b",
]
FIRST_PHONE_PATTERNS = [
    r"\((\d{3})\)[\s\-]?(\d{3})[\s\-]?(\d{4})",
    r"(\d{3})[\s\-.](\d{3})[\s\-.](\d{4})",
    r"(\d{3})\s(\d{3})\s(\d{4})",
    r"1[\s\-]?(\d{3})[\s\-]?(\d{3})[\s\-]?(\d{4})",
]
CANDIDATE_PATTERNS = [
    r"(?i)tel:[\s]*\+?1?[\s]*\(?(\d{3})\)?[\s]*[-.\s]*(\d{3})[\s]*[-.\s]*(\d{4})",
    r"\(?(\d{3})\)?[-.\s]*(\d{3})[-.\s]*(\d{4})(?!\d)",
    r"(\d{3})[-.\s]+(\d{3})[-.\s]+(\d{4})(?!\d)",
    r"1[-.\s]*\(?(\d{3})\)?[-.\s]*(\d{3})[-.\s]*(\d{4})(?!\d)",
    r"(?i)(?:phone|call|tel|contact)[\s:]*\(?(\d{3})\)?[-.\s]*(\d{3})[-.\s]*(\d{4})",
    r"(?i)(?:data-phone|data-tel)[\s]*=[\s]*[\"'][\s]*\(?(\d{3})\)?[-.\s]*(\d{3})[-.\s]*(\d{4})",
]


def digits(c: Column | str) -> Column:
    return F.regexp_replace(text(c), r"\D", "")


def us_digits(c: Column | str) -> Column:
    """Ten digits of a US number (a leading 1 of eleven is dropped), or null."""
    return first_match(digits(c), r"^1?(\d{10})$")


def _us_format(ten: Column) -> Column:
    return F.regexp_replace(ten, r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")


def normalize_phone_us(phone: Column | str, mode: str = "strict") -> Column:
    """``(AAA) EEE-NNNN``. Otherwise: ``keep`` the original, ``null``, or
    ``strict`` (null, and area or exchange starting with 0 or 1 is null too)."""
    ten = us_digits(phone)
    if mode == "strict":
        ten = F.when(ten.rlike(r"^[2-9]\d{2}[2-9]\d{6}$"), ten)
    out = _us_format(ten)
    return F.coalesce(out, col(phone)) if mode == "keep" else out


def validate_phone_strict(phone: Column | str) -> Column:
    """About a dozen rules against made-up and non-local numbers."""
    runs = "|".join(str(d) * 4 for d in range(10))
    ladder = "|".join("".join(str(d + i) for i in range(5)) for d in range(6))
    areas = "|".join(dict.fromkeys(L.PHONE_INVALID_AREAS))
    fakes = "|".join(L.PHONE_FAKE_NUMBERS)
    distinct = lambda ten: F.size(F.array_distinct(F.split(ten, "")))

    def check(ten):
        return (
            ten.rlike(r"^[2-9]\d{2}[2-9]\d{6}$")
            & ~ten.rlike(rf"^(?:{areas})|^\d{{3}}55501|{runs}|{ladder}|^(?:{fakes})$")
            & (distinct(ten) >= 4)
        )

    return F.coalesce(let(us_digits(phone), check), F.lit(False))


def extract_phones(body: Column | str, limit: int | None = None) -> Column:
    """US numbers in the text as ``(AAA) EEE-NNNN``, distinct."""
    found = F.concat(*[all_matches(text(body), p) for p in US_PHONE_PATTERNS])
    tens = F.filter(F.transform(found, us_digits), lambda d: d.isNotNull())
    return at_most(F.array_distinct(F.transform(tens, _us_format)), limit)


def extract_phone_first(body: Column | str) -> Column:
    """First pattern that hits and whose first hit has no zero block."""
    b = text(body)

    def attempt(p):
        area, exch, num = (F.regexp_extract(b, p, i) for i in (1, 2, 3))
        ok = (area != "") & (area != "000") & (exch != "000") & (num != "0000")
        return F.when(ok, F.concat(F.lit("("), area, F.lit(") "), exch, F.lit("-"), num))

    return F.coalesce(*[attempt(p) for p in FIRST_PHONE_PATTERNS])


def normalize_phone_e164(phone: Column | str, country: Column | str, codes=L.COUNTRY_REGION_CODES, calling=L.REGION_CALLING_CODES, default_region: str = "US") -> Column:
    """``+<code><number>``: a number written with ``+`` keeps its code, others
    get the code of their country (trunk 0 dropped); 8 to 15 digits."""
    d = digits(phone)
    by_country = F.create_map(*[F.lit(x) for k, r in codes.items() for x in (k, calling[r])])
    code = F.coalesce(F.try_element_at(by_country, F.lower(F.trim(text(country)))), F.lit(calling[default_region]))
    national = F.regexp_replace(d, "^0+", "")
    is_us = code == "1"
    full = (
        F.when(F.trim(text(phone)).startswith("+"), d)
        .when(is_us & d.rlike(r"^1\d{10}$"), d)
        .otherwise(F.concat(code, national))
    )
    ok = F.when(full.startswith("1"), full.rlike(r"^1[2-9]\d{2}[2-9]\d{6}$")).otherwise(full.rlike(r"^[2-9]\d{7,14}$"))
    return F.when((d != "") & ok, F.concat(F.lit("+"), full))


def _as_candidates(raw: Column, confidence: int, method: str) -> Column:
    phones = F.filter(F.transform(raw, lambda p: normalize_phone_us(p)), lambda p: p.isNotNull() & validate_phone_strict(p))
    return F.transform(phones, lambda p: F.struct(
        p.alias("phone"), F.lit(confidence).alias("confidence"), F.lit(method).alias("method")))


def _joined_groups(body: Column, pattern: str) -> Column:
    """All hits of a three-group pattern, groups joined."""
    parts = F.arrays_zip(*[all_matches(body, pattern, i).alias(f"g{i}") for i in (1, 2, 3)])
    return F.transform(parts, lambda z: F.concat(z["g1"], z["g2"], z["g3"]))


def _without_open(html: Column, names: Column) -> Column:
    """Start tags of these names with no end tag of their name behind them get
    a space behind ``<``, so that no pattern tries each of them to the end of
    the page; they are still stripped as tags."""
    def one(page, name):
        end = F.length(F.call_function("regexp_extract", page, F.concat(F.lit("(?is)^.*</"), name, F.lit(r"\s*>")), F.lit(0)))
        rest = F.regexp_replace(F.substr(page, end + 1), F.concat(F.lit("(?i)<(?="), name, F.lit(r"\b)")), F.lit("< "))
        return F.concat(F.substr(page, F.lit(1), end), rest)

    return F.aggregate(names, html, one)


def phone_candidates(html: Column | str) -> Column:
    """Array of {phone, confidence, method}: one entry per phone, the most
    trusted method wins, ties to the earlier method and position."""
    h = text(html)
    visible = F.regexp_replace(drop_raw(h), r"<[^<>]*>", " ")
    scripts = F.array_join(elements(h, "script", 1), "\n")
    microdata = first_of(
        F.regexp_extract(h, r"(?is)<[^<>]*itemprop\s*=\s*[\"'][^\"'<>]*phone[^\"'<>]*[\"'][^<>]*content\s*=\s*[\"']([^\"']*)", 1),
        F.regexp_extract(h, r"(?is)<[^<>]*itemprop\s*=\s*[\"'][^\"'<>]*phone[^\"'<>]*[\"'][^<>]*>([^<]*)", 1),
    )
    head = r"(?is)<(\w+)\b[^<>]*class\s*=\s*[\"'][^\"'<>]*(?:phone|tel|contact)[^\"'<>]*[\"'][^<>]*>"
    classed = F.transform(
        all_matches(_without_open(h, F.array_distinct(F.transform(all_matches(h, head, 1), lambda n: F.lower(n)))), head + r"(.*?)</\1\s*>", 2),
        lambda x: F.regexp_replace(x, r"<[^<>]*>", " "),
    )

    def first_valid(t):
        hits = F.concat(*[_joined_groups(t, p) for p in CANDIDATE_PATTERNS])
        return F.get(F.filter(hits, validate_phone_strict), F.lit(0))

    mine = r"(\d{3}[\s\-().]*\d{3}[\s\-().]*\d{4})"
    # fixed values: confidence and name of each method
    everything = let(visible, lambda seen: F.concat(
        _as_candidates(all_matches(h, r"(?is)<a\b[^<>]*href\s*=\s*[\"']tel:([^\"']*)", 1), 95, "tel_link"),
        _as_candidates(F.array(F.coalesce(json_ld_deep_phone(h), microdata)), 90, "structured_data"),
        _as_candidates(all_matches(h, r"(?is)\s[\w-]*(?:phone|tel)[\w-]*\s*=\s*[\"']([^\"']*)", 1), 85, "data_attribute"),
        _as_candidates(all_matches(scripts, r"(?i)(?:tele)?phone[\"'\s]*[:=][\"'\s]*(\d{3}[-.\s]*\d{3}[-.\s]*\d{4})", 1), 80, "javascript_var"),
        _as_candidates(F.transform(classed, first_valid), 75, "css_class"),
        *[_as_candidates(_joined_groups(seen, p), 70, f"html_pattern_{i}") for i, p in enumerate(CANDIDATE_PATTERNS, 1)],
        _as_candidates(all_matches(F.regexp_replace(seen, r"[^\d\s\-().]+", " "), mine, 1), 60, "text_mining"),
    ))
    # methods are listed by falling confidence, so the first entry of a phone
    # is its best one; sorted by phone and place, it is the first of its run
    placed = F.sort_array(F.transform(everything, lambda c, i: F.struct(c["phone"].alias("phone"), i.alias("i"), c.alias("c"))))
    firsts = let(placed, lambda ps: F.filter(ps, lambda p, k: F.coalesce(F.get(ps, k - 1)["phone"] != p["phone"], F.lit(True))))
    in_order = F.sort_array(F.transform(firsts, lambda p: F.struct(p["i"].alias("i"), p["c"].alias("c"))))
    return F.transform(in_order, lambda p: p["c"])


def best_phone(candidates: Column) -> Column:
    """Highest confidence; the first such entry."""
    def pick(cs):
        top = F.array_max(F.transform(cs, lambda c: c["confidence"]))
        return F.get(F.filter(cs, lambda c: c["confidence"] == top), F.lit(0))

    return let(candidates, pick)


def had_fake_area(phone: Column | str, fake: Sequence[str] = L.FAKE_AREA_CODES) -> Column:
    return F.coalesce(F.substring(us_digits(phone), 1, 3).isin(*fake), F.lit(False))


def clean_phones(phones: Column, limit: int | None = None) -> Column:
    """Formatted; numbers with a made-up area code out; others as they are."""
    kept = F.filter(F.transform(phones, lambda x: F.trim(x)), lambda p: (p != "") & ~had_fake_area(p))
    return at_most(F.transform(kept, lambda p: normalize_phone_us(p, "keep")), limit)


def clean_emails(emails: Column, limit: int | None = None) -> Column:
    lows = F.transform(emails, lambda e: F.lower(F.trim(e)))
    return at_most(F.filter(lows, lambda e: e.rlike(r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$")), limit)


def zip5(zip_code: Column | str, country: Column | str) -> Column:
    """Five-digit ZIP for the US, others unchanged."""
    five = first_match(text(zip_code), r"\b(\d{5})\b")
    us = F.lower(text(country)).isin("united states", "usa", "us")
    return F.when(us, F.coalesce(five, col(zip_code))).otherwise(col(zip_code))


# -- text fields --------------------------------------------------------------
def normalize_day_names(hours: Column | str) -> Column:
    out = col(hours)
    for short, long in zip(L.DAY_PREFIXES, L.DAY_NAMES):
        out = F.regexp_replace(out, rf"(?i)\b(?:{short}|{long})\b", short.capitalize())
    return out


def clean_text(c: Column | str) -> Column:
    """Collapse whitespace, drop characters outside words and -.,()&@#."""
    return strip(F.regexp_replace(squeeze(text(c)), r"[^\p{L}\p{N}_\s\-.,()&@#]", ""))


def valid_city(city: Column | str) -> Column:
    c = text(city)
    low = F.lower(strip(c))
    return (
        (F.length(c) >= 3) & ~low.isin(*L.CITY_STOP_WORDS) & ~low.rlike(r"^[a-z]{1,2}$|^\d+$")
        & c.rlike("[a-zA-Z]")
    )


_CITY = r"([A-Za-z][A-Za-z\s\-.]{2,25}?)"
_STREET_CHAR = r"[A-Za-z0-9\s\-.]"
# a street reaches over any later number of its run, so only the first number
# of a run is tried
_STREET = (
    rf"(?:\G|(?<!{_STREET_CHAR}))(?>{_STREET_CHAR}*?(?=\d+\s+{_STREET_CHAR}))"
    rf"(\d+\s+{_STREET_CHAR}+?\b(?:{L.STREET_SUFFIXES})\b\.?)\s*,?\s*"
)
ADDRESS_FULL = rf"(?i){_STREET}{_CITY}\s*,\s*([A-Z]{{2}})\s*(\d{{5}}(?:-\d{{4}})?)"
ADDRESS_CITY = rf"(?i){_CITY}\s*,\s*([A-Z]{{2}})\s*(\d{{5}}(?:-\d{{4}})?)"
ADDRESS_NO_ZIP = rf"(?i){_STREET}{_CITY}\s*,?\s*\b([A-Z]{{2}})\b"
ADDRESS_TAIL = rf"{_CITY}\s*,?\s*([A-Z]{{2}})\s*$"


def parse_us_address(body: Column | str) -> Column:
    """Struct street, city, state, postal, country; null when nothing fits.
    Patterns in order; within one, the first match with a real state and a
    plausible city; last, the 50 characters before a ZIP."""
    t = text(body)

    def tries(pattern, groups):
        # one pass over the text; the groups come from the short hits
        def shape(hit):
            get = lambda g: F.trim(F.regexp_extract(hit, pattern, groups[g])) if g in groups else F.lit(None).cast("string")
            return F.struct(
                get("street").alias("street"), get("city").alias("city"), F.upper(get("state")).alias("state"),
                get("postal").alias("postal"), F.lit("United States").alias("country"))

        shaped = F.transform(all_matches(t, pattern), shape)
        return F.filter(shaped, lambda s: valid_city(s["city"]) & s["state"].isin(*L.US_STATES))

    zips = all_matches(t, r"\b\d{5}(?:-\d{4})?\b")

    def before(z):
        at = F.instr(t, z)
        start = F.greatest(F.lit(1), at - 50)
        window = F.trim(F.substring(t, start, at - start))
        return F.struct(
            F.lit(None).cast("string").alias("street"),
            F.trim(F.regexp_extract(window, ADDRESS_TAIL, 1)).alias("city"),
            F.upper(F.regexp_extract(window, ADDRESS_TAIL, 2)).alias("state"),
            z.alias("postal"), F.lit("United States").alias("country"))

    fallback = F.filter(F.transform(zips, before), lambda s: valid_city(s["city"]) & s["state"].isin(*L.US_STATES))
    found = F.concat(
        tries(ADDRESS_FULL, {"street": 1, "city": 2, "state": 3, "postal": 4}),
        tries(ADDRESS_CITY, {"city": 1, "state": 2, "postal": 3}),
        tries(ADDRESS_NO_ZIP, {"street": 1, "city": 2, "state": 3}),
        fallback,
    )
    return F.when(F.length(t) >= 10, F.get(found, F.lit(0)))


def simple_address_parts(address: Column | str) -> Column:
    """ZIP and the last two-letter upper-case token."""
    a = text(address)
    states = all_matches(a, r"\b[A-Z]{2}\b")
    return F.struct(
        first_match(a, r"\b\d{5}(?:-\d{4})?\b", 0).alias("postal_code"),
        F.get(F.reverse(states), F.lit(0)).alias("state"),
    )


def first_tag(tags: Column, keys: Sequence[str] = L.PHONE_TAG_KEYS) -> Column:
    return F.coalesce(*[blank_to_null(F.try_element_at(tags, F.lit(k))) for k in keys])


def build_osm_address(tags: Column) -> Column:
    num, street = first_tag(tags, ["addr:housenumber"]), first_tag(tags, ["addr:street"])
    return F.coalesce(blank_to_null(F.concat_ws(" ", num, street)), first_tag(tags, ["addr:full"]))


def social_map(body: Column | str, patterns=L.SOCIAL_PATTERNS) -> Column:
    """Platform -> first match, scheme added; absent platforms left out."""
    t = text(body)

    def url(alternatives):
        hit = F.coalesce(*[first_match(t, "(?i)" + p, 0) for p in alternatives])
        return F.when(hit.startswith("http"), hit).otherwise(F.concat(F.lit("https://"), hit))

    entries = F.array(*[F.struct(F.lit(k).alias("k"), url(ps).alias("v")) for k, ps in patterns.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def working_hours_map(body: Column | str) -> Column:
    """Day -> ``start - end`` or ``Closed``; an opening time wins over closed,
    the last mention of a day counts."""
    low = F.lower(text(body))
    time = r"[\s:\-]*(\d{1,2}:?\d{0,2})\s*(am|pm)?\s*[-to]*\s*(\d{1,2}:?\d{0,2})\s*(am|pm)?"

    def day(short, long):
        p = rf"\b(?:{long}|{short}){time}"
        last = lambda g: F.get(F.reverse(all_matches(low, p, g)), F.lit(0))
        start = F.concat_ws(" ", last(1), blank_to_null(last(2)))
        end = F.concat_ws(" ", last(3), blank_to_null(last(4)))
        opened = F.when(last(1).isNotNull(), F.concat(start, F.lit(" - "), end))
        return F.coalesce(opened, F.when(low.rlike(rf"\b(?:{long}|{short})[\s:\-]*closed"), F.lit("Closed")))

    entries = F.array(*[F.struct(F.lit(d).alias("k"), day(s, d).alias("v")) for s, d in zip(L.DAY_PREFIXES, L.DAY_NAMES)])
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def hours_text(body: Column | str, limit: int | None = None) -> Column:
    def leftmost(p: str) -> str:
        # parts in order, each at its first place: if that fails from the first
        # start it fails from all, so one anchored attempt decides
        head, *rest = p.split(".*?")
        return rf"(?is)\A(?>.*?(?={head}))({head}" + "".join(f"(?>.*?{x})" for x in rest) + ")"

    return cut(F.coalesce(*[first_match(text(body), leftmost(p)) for p in L.HOURS_TEXT_PATTERNS]), limit)


def classify_text_field(c: Column | str) -> Column:
    """company / phone / address / website, first rule that fits, else null."""
    t = text(c)
    low = F.lower(t)
    return (
        F.when((F.length(t) >= 3) & contains_any(low, ["metal", "scrap", "recycling", "salvage", "steel", "aluminum", "copper", "inc", "llc"]) & ~t.startswith("http"), "name")
        .when(t.rlike(r"\(\d{3}\)\s*\d{3}[-\s]?\d{4}|\d{3}[-\s]?\d{3}[-\s]?\d{4}|\+1[-\s]?\d{3}[-\s]?\d{3}[-\s]?\d{4}"), "phone")
        .when((F.length(t) >= 5) & t.rlike(r"\d") & contains_any(low, ["st", "street", "ave", "avenue", "rd", "road", "blvd", "dr", "drive", "ln", "lane"]), "address")
        .when(t.startswith("http") | contains_any(t, [".com", ".net", ".org", ".biz"]), "website")
    )



# -- record shaping -----------------------------------------------------------
def clean_contact_record(df, *, zip_col: str = "zip_code", country: str = "country", fake_zips: Sequence[str] = L.FAKE_ZIPS):
    """Phones, e-mails (arrays), website, hours and ZIP in clean form. Made-up
    area codes and ZIPs become null and are flagged, not replaced."""
    five = zip5(zip_col, country)
    us = F.lower(text(country)).isin("united states", "usa", "us")
    fake = F.coalesce(us & five.isin(*fake_zips), F.lit(False))
    return df.withColumns({
        "had_fake_phone": F.coalesce(F.exists("phones", lambda p: had_fake_area(p)), F.lit(False)),
        "had_fake_zip": fake,
        "phones": clean_phones(F.col("phones")),
        "emails": clean_emails(F.col("emails")),
        "website": F.when(filled("website") & ~F.col("website").rlike("^https?://"), F.concat(F.lit("https://"), "website")).otherwise(F.col("website")),
        "hours": normalize_day_names("hours"),
        zip_col: F.when(~fake, five),
    })


def split_primary_secondary(values: str, prefix: str) -> list[Column]:
    return [F.get(F.col(values), F.lit(i)).alias(f"{prefix}_{n}") for i, n in enumerate(("primary", "secondary"))]


def group_fields_to_records(df, groups: Sequence[str], row_id: str):
    """The i-th items of all groups make one record; each item fills the field
    its text looks like, a later one wins. Records need a name or a phone."""
    zipped = df.select(row_id, F.posexplode(F.arrays_zip(*groups)).alias("pos", "z"))
    items = [F.col("z")[g] for g in groups]

    def field(kind):
        out = F.lit(None).cast("string")
        for i in items:
            out = F.when(classify_text_field(i) == kind, strip(i)).otherwise(out)
        return out.alias(kind)

    rows = zipped.select(row_id, "pos", *[field(k) for k in ("name", "phone", "address", "website")])
    return rows.where(filled("name") | filled("phone"))


def flatten_record(df, sep: str = ", "):
    """Struct fields to ``column_field``, arrays to text."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "struct":
            out += [F.col(f.name)[s].alias(f"{f.name}_{s}") for s in f.dataType.names]
        elif kind == "array":
            out.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), sep).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


# fixed values: field -> table column
CSV_COLUMNS = {"state": "state_region"}


def format_us_csv_fields(df, json_fields: Sequence[str] = ("working_hours", "services_offered"), names=CSV_COLUMNS):
    """Rename to table columns; nested hours and services become JSON text."""
    as_json = {c: F.to_json(c) for c in json_fields if c in df.columns}
    return df.withColumns(as_json).withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})
