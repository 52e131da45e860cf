"""Record validation, quality scores and business rules."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions.common import (
    blank_to_null, col, contains_any, count_contains, filled, filled_array, labels_text, let, matched_labels, text,
)


# fixed values throughout this module: issue texts, labels, tiers, points and
# thresholds are outputs, or decide them, and must be as they are

# -- validation ---------------------------------------------------------------
def validate_company(name="name", website="website", phones="phones", emails="emails", social="social_links", country="country", materials="materials") -> Column:
    """Array of issues; empty means valid. Placeholder words match as
    substrings. Phones, e-mails, social links and materials are text."""
    n, w, p, e, m = text(name), text(website), text(phones), text(emails), text(materials)
    has_phone, has_email, has_social = F.trim(p) != "", F.trim(e) != "", F.trim(text(social)) != ""
    return matched_labels([
        ("Missing or invalid company name", F.length(F.trim(n)) < 2),
        ("Missing website", w == ""),
        ("Website must start with http:// or https://", (w != "") & ~w.rlike("^https?://")),
        ("Missing contact information (phone, email, or social links)", ~(has_phone | has_email | has_social)),
        ("Phone number format appears invalid", has_phone & ~p.rlike(r"\(\d{3}\)\s?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{10}")),
        ("Email format appears invalid", has_email & ~e.rlike(r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}")),
        ("Missing country", text(country) == ""),
        ("Website appears to be an example/placeholder", F.lower(w).contains("example.com")),
        ("Company name appears to be placeholder/test data", contains_any(F.lower(n), L.PLACEHOLDER_WORDS)),
        ("No recognizable scrap metal materials mentioned", (m != "") & ~contains_any(F.lower(m), L.VALID_MATERIALS)),
    ])


def validate_company_basic(name="name", website="website", description="description", materials="materials", topic=L.BASIC_TOPIC_WORDS) -> Column:
    n, w = F.trim(text(name)), F.trim(text(website))
    body = F.lower(F.concat_ws(" ", n, text(description), F.array_join(col(materials), " ")))
    return (
        (F.length(n) >= 3) & ~contains_any(F.lower(n), L.SYNTHETIC_WORDS)
        & ((w == "") | w.rlike("^https?://")) & contains_any(body, topic)
    )


def validate_company_final(name="name", website="website", phones="phones", emails="emails") -> Column:
    return (
        (F.length(F.trim(text(name))) >= 3) & (filled(website) | filled(phones) | filled(emails))
        & ~contains_any(F.lower(text(name)), L.FINAL_NAME_DENY)
    )


def detect_synthetic(address="address", phones="phones", name="name") -> Column:
    """Array of signs of made-up data; the ending is that of all phones."""
    house = F.regexp_extract(text(address), r"^(\d+)", 1)
    ending = F.right(F.regexp_replace(text(phones), r"\D", ""), F.lit(4))
    return F.array_compact(F.array(
        F.when(house.isin(*L.SYNTHETIC_HOUSES), F.concat(F.lit("Sequential address: "), house)),
        F.when(contains_any(text(phones), L.SYNTHETIC_PHONES), F.lit("Pattern phone number")),
        F.when(ending.isin(*L.SYNTHETIC_ENDINGS), F.concat(F.lit("Sequential phone ending: "), ending)),
        F.when(contains_any(text(name), L.SYNTHETIC_NAMES), F.lit("Generic company name pattern")),
    ))


# -- predicates on records ----------------------------------------------------
def filter_business_relevant(title, url, description, *, words=L.RELEVANT_BUSINESS_WORDS, deny_domains=L.RELEVANT_DENY_DOMAINS, deny_words=L.RELEVANT_DENY_WORDS, indicators=L.BUSINESS_INDICATORS) -> Column:
    body = F.lower(F.concat_ws(" ", text(title), text(url), text(description)))
    return (
        (count_contains(body, words) >= 2) & ~contains_any(F.lower(text(url)), deny_domains)
        & ~contains_any(body, deny_words) & contains_any(body, indicators)
    )


def filter_business_relevant_weak(title, description, *, words=L.WEAK_RELEVANT_WORDS, deny_words=L.WEAK_DENY_WORDS) -> Column:
    body = F.lower(F.concat_ws(" ", text(title), text(description)))
    return contains_any(body, words) & ~contains_any(body, deny_words)


def filter_min_requirements(name="name", phone="phone", email="email", description="description", website="website", words=L.MIN_REQUIREMENT_WORDS) -> Column:
    body = F.lower(F.concat_ws(" ", text(name), text(description), text(website)))
    return (F.length(text(name)) > 3) & (filled(phone) | filled(email)) & contains_any(body, words)


def filter_has_contact(*cols: Column | str) -> Column:
    return reduce(lambda a, b: a | b, [filled(c) for c in cols])


def filter_non_target_business(tags: Column, name: Column | str) -> Column:
    """True when the business is not one of ours: tag types, then name words,
    then allowed names, then allowed tags; unclear ones are out."""
    t = lambda k: F.lower(F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit("")))
    raw = lambda k: F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))
    kinds = F.concat_ws("\n", t("amenity"), t("shop"), t("cuisine"), t("building"))
    low = F.lower(text(name))
    tagged = (
        (raw("amenity") == "recycling") | (raw("shop") == "scrap_yard") | raw("industrial").isin("scrap_yard", "metal_processing")
        | F.exists(F.map_keys(tags), lambda k: k.startswith("recycling:"))
    )
    return (
        F.when(contains_any(kinds, L.NON_TARGET_TYPES), True)
        .when(contains_any(low, L.NON_TARGET_NAMES), True)
        .when(contains_any(low, L.TARGET_NAMES), False)
        .otherwise(~F.coalesce(tagged, F.lit(False)))
    )


# -- scores -------------------------------------------------------------------
def _is_filled(c: str, arrays: Sequence[str]) -> Column:
    return filled_array(c) if c in arrays else F.col(c).isNotNull() & (F.col(c).cast("string") != "")


def completeness_score(fields: Sequence[str], arrays: Sequence[str] = ()) -> Column:
    """Filled share in whole percent, rounded down."""
    n = reduce(lambda a, b: a + b, [F.when(_is_filled(f, arrays), 1).otherwise(0) for f in fields])
    return F.floor(n * 100 / len(fields)).cast("int")


def contact_completeness(phone="phone", website="website", email="email") -> Column:
    return completeness_score([phone, website, email])


def contact_quality(*cols: str) -> Column:
    """How many contact fields are filled (0 to 5)."""
    return reduce(lambda a, b: a + b, [F.when(filled(c), 1).otherwise(0) for c in cols])


def quality_score(name="name", phone="phone", website="website", email="email", address="address", city="city", state="state", hours="hours", services="services") -> Column:
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    total = (
        pts(filled(phone), 30) + pts(F.length(text(name)) > 3, 20) + pts(filled(website), 15) + pts(filled(email), 10)
        + pts(filled(address), 10) + pts(filled(city), 5) + pts(filled(state), 5) + pts(filled(hours), 3)
        + pts(filled_array(services), 2)
    )
    return F.least(total, F.lit(100))


def verification_status(score: Column) -> Column:
    return let(score, lambda x: F.when(x >= 80, "verified").when(x >= 60, "partial").otherwise("basic"))


def goal_attainment(percent: Column, target: float = 85.0, acceptable: float = 60.0) -> Column:
    return F.when(percent >= target, "reached").when(percent >= acceptable, "acceptable").otherwise("missed")


# -- business rules -----------------------------------------------------------
def _yes(cond: Column, other: str = "No") -> Column:
    return F.when(cond, "Yes").otherwise(other)


def operational_capability(services: Column, hours: Column | str, metal_count: Column) -> dict[str, Column]:
    """Service flags, schedule, facility size, staff estimate."""
    s = F.lower(F.coalesce(F.array_join(services, " "), F.lit("")))
    container, processing, demolition = (
        contains_any(s, ["container", "rental", "roll-off"]), contains_any(s, ["processing", "sorting", "shredding"]), s.contains("demolition"))
    points = (
        F.when(container, 2).otherwise(0) + F.when(processing, 2).otherwise(0) + F.when(demolition, 1).otherwise(0)
        + F.when(metal_count > 5, 1).otherwise(0)
    )
    h = F.lower(text(hours))
    return {
        "pickup_service": _yes(s.contains("pickup")), "container_rental": _yes(container),
        "demolition_service": _yes(demolition), "processing_capabilities": _yes(processing), "certified_scales": _yes(s.contains("scale")),
        "operation_schedule": F.when(h == "", "Unknown").when(contains_any(h, ["24", "monday", "weekday"]), "Full Time").otherwise("Limited Hours"),
        "facility_size": let(points, lambda x: F.when(x >= 5, "Large Industrial").when(x >= 3, "Medium Commercial").otherwise("Small Local")),
        "employee_estimate": let(points, lambda x: F.when(x >= 5, "20+ employees").when(x >= 3, "5-20 employees").otherwise("1-5 employees")),
    }


def digital_presence(website: Column | str, pricing: Column | str) -> dict[str, Column]:
    w, has = F.lower(text(website)), filled(website)
    professional = has & contains_any(w, [".com", "www"])
    priced = has & filled(pricing)
    return {
        "website_quality": F.when(~has, "No Website").when(professional, "Professional").otherwise("Basic"),
        "pricing_available": _yes(priced),
        "pricing_info": F.when(priced, col(pricing)).otherwise("Not Available"),
        "social_media_presence": F.when(professional, "Likely Present").otherwise("Limited/None"),
    }


def commercial_flags(body: Column | str) -> dict[str, Column]:
    low = F.lower(text(body))
    return {
        "commercial_accounts": _yes(contains_any(low, ["commercial", "industrial", "business", "corporate"]), "Unknown"),
        "licenses": F.when(contains_any(low, ["license", "permit", "authorized"]), "Licensed Operation").otherwise("Standard Operation"),
        "environmental_compliance": F.when(contains_any(low, ["environmental", "green", "sustainable", "eco"]), "Enhanced").otherwise("Standard"),
    }


def business_profile(metals: Column, city, state, website, phone, email, services: Column, priced: Column, completeness: Column, quality: Column, flags: dict[str, Column]) -> dict[str, Column]:
    """Top metals, specialisation, size, market tier, outreach priority and
    advantages. ``flags`` come from the capability rules, which run first."""
    n = F.coalesce(F.size(metals), F.lit(0))
    n = F.when(n < 0, 0).otherwise(n)
    spec = F.when(n == 0, "Unknown").when(n <= 2, "High").when(n <= 5, "Medium").otherwise("Low")
    one = lambda cond: F.when(cond, 1).otherwise(0)
    signs = one(filled(website)) + one(filled(phone)) + one(filled(email)) + one(filled_array(services)) + one(priced)
    c = F.lower(text(city))
    points = (
        let(completeness, lambda x: F.when(x > 70, 3).when(x > 50, 2).when(x > 30, 1).otherwise(0))
        + let(quality, lambda x: F.when(x >= 4, 2).when(x >= 2, 1).otherwise(0)) + one(filled(website)) + one(priced)
    )
    yes = lambda k: flags[k] == "Yes"
    advantages = labels_text([
        ("Pickup Service", yes("pickup_service")), ("Container Rental", yes("container_rental")), ("Certified Scales", yes("certified_scales")),
        ("Processing", yes("processing_capabilities")), ("Commercial Focus", yes("commercial_accounts")), ("Specialized", spec == "High"),
    ])
    return {
        "primary_metal_types": F.when(n > 0, F.array_join(F.slice(metals, 1, 3), ", ")).otherwise("Unknown"),
        "all_metal_types_count": n, "specialization_score": spec,
        "business_size_estimate": let(signs, lambda x: F.when(x >= 4, "Large").when(x >= 2, "Medium").otherwise("Small")),
        "market_tier": F.when(contains_any(c, L.MAJOR_METROS), "Tier 1 (Major Metro)").when(col(state).isin(*L.MAJOR_STATES), "Tier 2 (Major State)").otherwise("Tier 3 (Regional)"),
        "outreach_priority": let(points, lambda x: F.when(x >= 6, "High").when(x >= 4, "Medium").otherwise("Low")),
        "competitive_advantage": F.coalesce(blank_to_null(advantages), F.lit("Standard Operations")),
    }


def market_position(city, state, services: Column, metal_count: Column) -> dict[str, Column]:
    c, s = F.lower(text(city)), text(state)
    high = contains_any(c, L.HIGH_COMPETITION_CITIES) | s.isin(*L.HIGH_COMPETITION_STATES)
    medium = s.isin(*L.MEDIUM_COMPETITION_STATES)
    n = F.when(filled_array(services), F.size(services)).otherwise(0)
    return {
        "local_competition_level": F.when(high, "High").when(medium, "Medium").otherwise("Low"),
        "market_opportunity": F.when(high, "Competitive Market").when(medium, "Balanced Market").otherwise("Growth Opportunity"),
        "expansion_potential": F.when((n >= 4) & (metal_count >= 5), "Limited (Full Service)").when((n >= 2) | (metal_count >= 3), "Moderate").otherwise("High (Underserved)"),
    }


# -- map tags -----------------------------------------------------------------
def _tag(tags: Column, k: str) -> Column:
    return F.coalesce(F.try_element_at(tags, F.lit(k)), F.lit(""))


def business_type(tags: Column) -> Column:
    return (
        F.when(_tag(tags, "shop") == "scrap_yard", "Scrap Metal Dealer")
        .when(_tag(tags, "amenity") == "recycling", "Metal Recycling Center")
        .when(_tag(tags, "industrial").isin("scrap_yard", "metal_processing"), "Industrial Recycling")
        .when(F.lower(_tag(tags, "name")).contains("auto"), "Auto Salvage")
        .otherwise("Metal Recycling Center")
    )


def metal_types_from_tags(tags: Column) -> Column:
    """Sorted distinct metals named by tags; ``Mixed Metals`` if none."""
    recycling = F.lower(_tag(tags, "recycling"))
    named = F.lower(F.concat_ws(" ", _tag(tags, "name"), _tag(tags, "description")))

    def lists(c, rules):
        return [F.when(c.contains(k), F.array(*[F.lit(v) for v in vs])).otherwise(F.array().cast("array<string>")) for k, vs in rules]

    found = F.array_sort(F.array_distinct(F.concat(*lists(recycling, L.TAG_RECYCLING_METALS), *lists(named, L.TAG_METALS))))
    default = F.when(
        _tag(tags, "shop") == "scrap_yard", F.array(*[F.lit(x) for x in ("Aluminum", "Copper", "Iron", "Steel")])
    ).otherwise(F.array(F.lit("Mixed Metals")))
    return F.when(F.size(found) > 0, found).otherwise(default)


def services_from_tags(tags: Column) -> Column:
    """Sorted distinct services named by tags, with the default pair."""
    named = F.lower(F.concat_ws(" ", _tag(tags, "name"), _tag(tags, "description")))
    found = matched_labels(
        [(label, _tag(tags, k) == "yes") for k, label in L.TAG_SERVICES] + [(label, named.contains(w)) for w, label in L.TAG_SERVICE_WORDS])
    found = F.array_sort(F.array_distinct(found))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("Cash Payment"), F.lit("Metal Processing")))


def select_essential_columns(df, essential: Sequence[str] = L.ESSENTIAL_COLUMNS):
    """Essential columns first, then the rest in their order."""
    first = [c for c in essential if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])

