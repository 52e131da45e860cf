"""Queries for validation, scores and business rules."""

from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions import quality as Q
from webrec.operators.records import profile_records, reject_synthetic_batch, score_records
from webrec.plans import sqltext as S
from webrec.plans.inputs import view, with_views
from webrec.plans.registry import query

CO = with_views("companies")
U = with_views("urls")


def _co(spark, sf_dir):
    return view(spark, sf_dir, "companies")


def _full(c):
    return f"(coalesce({c}, '') <> '')"


_MATS = "coalesce(array_to_string(materials, ', '), '')"
_ISSUES = [
    ("Missing or invalid company name", "length(trim(coalesce(name, ''))) < 2"),
    ("Missing website", "coalesce(website, '') = ''"),
    ("Website must start with http:// or https://", "coalesce(website, '') <> '' AND NOT starts_with(website, 'http://') AND NOT starts_with(website, 'https://')"),
    ("Missing contact information (phone, email, or social links)", "coalesce(phone, '') = '' AND coalesce(email, '') = ''"),
    ("Phone number format appears invalid", r"coalesce(phone, '') <> '' AND NOT regexp_matches(phone, '\(\d{3}\)\s?\d{3}-\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{10}')"),
    ("Email format appears invalid", r"coalesce(email, '') <> '' AND NOT regexp_matches(email, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')"),
    ("Missing country", "coalesce(country, '') = ''"),
    ("Website appears to be an example/placeholder", "contains(lower(coalesce(website, '')), 'example.com')"),
    ("Company name appears to be placeholder/test data", S.has_any("lower(coalesce(name, ''))", L.PLACEHOLDER_WORDS)),
    ("No recognizable scrap metal materials mentioned", f"{_MATS} <> '' AND NOT {S.has_any(_MATS, L.VALID_MATERIALS)}"),
]
ISSUE_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {S.lit(n)} END" for n, c in _ISSUES) + "], lambda v: v IS NOT NULL)"


def issues():
    return Q.validate_company(
        phones="phone", emails="email", social=F.lit(""), materials=F.coalesce(F.array_join("materials", ", "), F.lit("")))


query("validate_company", f"{CO} SELECT id, array_to_string({ISSUE_LIST}, '|') AS issues, len({ISSUE_LIST}) = 0 AS is_valid FROM companies")(
    lambda spark, sf_dir: _co(spark, sf_dir).select("id", issues().alias("i")).select("id", F.array_join("i", "|").alias("issues"), (F.size("i") == 0).alias("is_valid"))
)
query(
    "validate_company_basic",
    f"""{CO} SELECT id, length(trim(coalesce(name, ''))) >= 3 AND NOT {S.has_any("lower(coalesce(name, ''))", L.SYNTHETIC_WORDS)}
        AND (coalesce(website, '') = '' OR regexp_matches(website, '^https?://'))
        AND {S.has_any(f"lower(coalesce(name, '') || ' ' || coalesce(description, '') || ' ' || {_MATS})", L.BASIC_TOPIC_WORDS)} AS ok_basic,
        length(trim(coalesce(name, ''))) >= 3 AND (coalesce(website, '') <> '' OR coalesce(phone, '') <> '' OR coalesce(email, '') <> '')
        AND NOT {S.has_any("lower(coalesce(name, ''))", L.FINAL_NAME_DENY)} AS ok_final FROM companies""",
)(
    lambda spark, sf_dir: _co(spark, sf_dir).select(
        "id", Q.validate_company_basic().alias("ok_basic"), Q.validate_company_final(phones="phone", emails="email").alias("ok_final"))
)
_SIGNS = """list_filter([CASE WHEN regexp_extract(coalesce(address, ''), '^([0-9]+)', 1) IN ('1234','2345','3456','4567','5678','6789') THEN 'Sequential address: ' || regexp_extract(address, '^([0-9]+)', 1) END,
 CASE WHEN regexp_matches(coalesce(phone, ''), '555-1234|555-5678|555-0000') THEN 'Pattern phone number' END,
 CASE WHEN right(regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g'), 4) IN ('1234','5678','0000','1111') THEN 'Sequential phone ending: ' || right(regexp_replace(phone, '[^0-9]', '', 'g'), 4) END,
 CASE WHEN regexp_matches(coalesce(name, ''), 'Scrap Metal #|Metal Recycling #|Houston Scrap 1|Texas Metal 1') THEN 'Generic company name pattern' END], lambda v: v IS NOT NULL)"""
query("detect_synthetic", f"{CO} SELECT id, array_to_string({_SIGNS}, '|') AS signs FROM companies")(
    lambda spark, sf_dir: _co(spark, sf_dir).select("id", F.array_join(Q.detect_synthetic(phones="phone"), "|").alias("signs"))
)
_BATCH = "id % 97 * 1000 + id % 13"
query(
    "reject_synthetic_batch",
    f"{CO} SELECT id, batch_id FROM (SELECT id, {_BATCH} AS batch_id, bool_or(len({_SIGNS}) > 0) OVER (PARTITION BY {_BATCH}) AS bad FROM companies) WHERE NOT bad",
)(
    lambda spark, sf_dir: reject_synthetic_batch(_co(spark, sf_dir).withColumn("batch_id", F.expr(_BATCH)), phones="phone").select("id", "batch_id")
)

# -- predicates ---------------------------------------------------------------
_T = "lower(concat_ws(' ', coalesce(title, ''), coalesce(url, ''), coalesce(description, '')))"
_T2 = "lower(concat_ws(' ', coalesce(title, ''), coalesce(description, '')))"
query(
    "filter_business_relevant",
    f"{U} SELECT page_id, {S.n_hits(_T, L.RELEVANT_BUSINESS_WORDS)} >= 2 AND NOT {S.has_any('lower(coalesce(url, chr(32)))', L.RELEVANT_DENY_DOMAINS)} AND NOT {S.has_any(_T, ['software', 'weather', 'jobs'])} AND {S.has_any(_T, L.BUSINESS_INDICATORS)} AS strong, "
    f"{S.has_any(_T2, L.WEAK_RELEVANT_WORDS)} AND NOT {S.has_any(_T2, L.WEAK_DENY_WORDS)} AS weak FROM urls",
)(
    lambda spark, sf_dir: view(spark, sf_dir, "urls").select(
        "page_id", Q.filter_business_relevant("title", "url", "description", deny_words=["software", "weather", "jobs"]).alias("strong"),
        Q.filter_business_relevant_weak("title", "description").alias("weak"))
)
query(
    "filter_min_requirements",
    f"""{CO} SELECT id FROM companies WHERE length(name) > 3 AND (coalesce(phone, '') <> '' OR coalesce(email, '') <> '')
        AND {S.has_any("lower(name || ' ' || coalesce(description, '') || ' ' || coalesce(website, ''))", L.MIN_REQUIREMENT_WORDS)}""",
)(lambda spark, sf_dir: _co(spark, sf_dir).where(Q.filter_min_requirements()).select("id"))

# map tags of the companies, five kinds of place
PLACE_TAGS = """map_from_arrays(array('amenity', 'shop', 'industrial', 'recycling', 'name', 'description', 'service:pickup', 'recycling:cans'),
 array(CASE id % 7 WHEN 0 THEN 'recycling' WHEN 1 THEN 'restaurant' ELSE '' END, CASE id % 7 WHEN 2 THEN 'scrap_yard' ELSE '' END, CASE id % 7 WHEN 3 THEN 'metal_processing' ELSE '' END,
  CASE id % 4 WHEN 0 THEN 'aluminium;copper' ELSE '' END, coalesce(CASE WHEN id % 10 = 9 THEN 'Barrow ' || name WHEN id % 10 = 8 THEN 'Auto Zone' ELSE name END, 'Plain'), CASE id % 5 WHEN 0 THEN 'cash and scale' ELSE '' END,
  CASE WHEN id % 3 = 0 THEN 'yes' ELSE 'no' END, 'x'))"""
_PN = "coalesce(CASE WHEN id % 10 = 9 THEN 'Barrow ' || name WHEN id % 10 = 8 THEN 'Auto Zone' ELSE name END, 'Plain')"


def _tagged(spark, sf_dir):
    return _co(spark, sf_dir).select("id", F.expr(PLACE_TAGS).alias("tags")).withColumn("place", F.col("tags")["name"])


query(
    "filter_non_target_business",
    f"""{CO}, p AS (SELECT id, lower({_PN}) AS n FROM companies)
        SELECT id, CASE WHEN id % 7 = 1 THEN true WHEN {S.has_any('n', L.NON_TARGET_NAMES)} THEN true WHEN {S.has_any('n', L.TARGET_NAMES)} THEN false ELSE id % 7 NOT IN (0, 2, 3) END AS non_target FROM p""",
)(
    lambda spark, sf_dir: _tagged(spark, sf_dir).select(
        "id", Q.filter_non_target_business(F.map_filter("tags", lambda k, v: k != "recycling:cans"), "place").alias("non_target"))
)
query(
    "business_type",
    f"""{CO} SELECT id, CASE id % 7 WHEN 2 THEN 'Scrap Metal Dealer' WHEN 0 THEN 'Metal Recycling Center' WHEN 3 THEN 'Industrial Recycling'
        ELSE CASE WHEN contains(lower({_PN}), 'auto') THEN 'Auto Salvage' ELSE 'Metal Recycling Center' END END AS kind FROM companies""",
)(lambda spark, sf_dir: _tagged(spark, sf_dir).select("id", Q.business_type(F.col("tags")).alias("kind")))
_TM = " UNION ALL ".join(
    [f"SELECT id, unnest({S.lst(vs)}) AS m FROM p WHERE contains(r, '{k}')" for k, vs in L.TAG_RECYCLING_METALS] + [f"SELECT id, unnest({S.lst(vs)}) FROM p WHERE contains(n, '{k}')" for k, vs in L.TAG_METALS])
_TS = " UNION ALL ".join(["SELECT id, 'Pickup Service' AS s FROM p WHERE id % 3 = 0"] + [f"SELECT id, {S.lit(v)} FROM p WHERE contains(n, '{k}')" for k, v in L.TAG_SERVICE_WORDS])
query(
    "metal_types_from_tags",
    f"""{CO}, p AS (SELECT id, CASE id % 4 WHEN 0 THEN 'aluminium;copper' ELSE '' END AS r, lower({_PN}) || ' ' || CASE id % 5 WHEN 0 THEN 'cash and scale' ELSE '' END AS n FROM companies),
        m AS (SELECT id, string_agg(DISTINCT m, '|' ORDER BY m) AS metals FROM ({_TM}) GROUP BY id), s AS (SELECT id, string_agg(DISTINCT s, '|' ORDER BY s) AS services FROM ({_TS}) GROUP BY id)
        SELECT p.id, coalesce(metals, CASE WHEN p.id % 7 = 2 THEN 'Aluminum|Copper|Iron|Steel' ELSE 'Mixed Metals' END) AS metals, coalesce(services, 'Cash Payment|Metal Processing') AS services
        FROM p LEFT JOIN m ON p.id = m.id LEFT JOIN s ON p.id = s.id""",
)(
    lambda spark, sf_dir: _tagged(spark, sf_dir).select(
        "id", F.array_join(Q.metal_types_from_tags(F.col("tags")), "|").alias("metals"), F.array_join(Q.services_from_tags(F.col("tags")), "|").alias("services"))
)

# -- scores -------------------------------------------------------------------
_TEN = " + ".join([f"CAST({_full(c)} AS INT)" for c in ("name", "address", "city", "state", "phone", "website")] + ["CAST(latitude IS NOT NULL AS INT)", "CAST(longitude IS NOT NULL AS INT)", "CAST(coalesce(len(materials), 0) > 0 AS INT)", "CAST(coalesce(len(services), 0) > 0 AS INT)"])
COMPLETENESS = f"CAST(floor(({_TEN}) * 100 / 10) AS BIGINT)"
CONTACT_QUALITY = "(" + " + ".join(f"CAST({_full(c)} AS INT)" for c in ("phone", "email", "website", "address", "hours")) + ")"
query("completeness_score", f"{CO} SELECT id, {COMPLETENESS} AS completeness FROM companies")(
    lambda spark, sf_dir: _co(spark, sf_dir).select("id", Q.completeness_score(
        ["name", "address", "city", "state", "latitude", "longitude", "phone", "website", "materials", "services"], ["materials", "services"]).cast("bigint").alias("completeness"))
)
query("contact_completeness", f"{CO} SELECT id, CAST(({_full('phone')}::INT + {_full('website')}::INT + {_full('email')}::INT) * 100 // 3 AS BIGINT) AS contact FROM companies")(
    lambda spark, sf_dir: _co(spark, sf_dir).select("id", Q.contact_completeness().cast("bigint").alias("contact"))
)
_W = [("phone", 30), ("website", 15), ("email", 10), ("address", 10), ("city", 5), ("state", 5), ("hours", 3)]
QUALITY = "least(100, " + " + ".join(f"CASE WHEN {_full(c)} THEN {n} ELSE 0 END" for c, n in _W) + " + CASE WHEN length(coalesce(name, '')) > 3 THEN 20 ELSE 0 END + CASE WHEN len(services) > 0 THEN 2 ELSE 0 END)"
query("quality_score", f"{CO} SELECT id, CAST({QUALITY} AS BIGINT) AS quality FROM companies")(
    lambda spark, sf_dir: _co(spark, sf_dir).select("id", Q.quality_score().cast("bigint").alias("quality"))
)
query("verification_status", f"{CO} SELECT id, CASE WHEN {COMPLETENESS} >= 80 THEN 'verified' WHEN {COMPLETENESS} >= 60 THEN 'partial' ELSE 'basic' END AS status FROM companies")(
    lambda spark, sf_dir: score_records(_co(spark, sf_dir)).select("id", "status")
)
query(
    "goal_attainment",
    f"""{CO} SELECT source, CAST(count(*) AS BIGINT) AS total, round(avg(CASE WHEN {_full('phone')} THEN 100.0 ELSE 0 END), 1) AS phone_percent,
        CASE WHEN avg(CASE WHEN {_full('phone')} THEN 100.0 ELSE 0 END) >= 85 THEN 'reached' WHEN avg(CASE WHEN {_full('phone')} THEN 100.0 ELSE 0 END) >= 60 THEN 'acceptable' ELSE 'missed' END AS goal FROM companies GROUP BY source""",
)(
    lambda spark, sf_dir: _co(spark, sf_dir).groupBy("source").agg(F.count("*").alias("total"), F.avg(F.when(F.coalesce("phone", F.lit("")) != "", 100.0).otherwise(0.0)).alias("p"))
    .select("source", "total", F.round("p", 1).alias("phone_percent"), Q.goal_attainment(F.col("p")).alias("goal"))
)

# -- business rules -----------------------------------------------------------
_SV = "lower(coalesce(array_to_string(services, ' '), ''))"
_CONT = S.has_any(_SV, ["container", "rental", "roll-off"])
_PROC = S.has_any(_SV, ["processing", "sorting", "shredding"])
_NM = "coalesce(len(materials), 0)"
_NS = "coalesce(len(services), 0)"
_FAC = f"(CASE WHEN {_CONT} THEN 2 ELSE 0 END + CASE WHEN {_PROC} THEN 2 ELSE 0 END + CASE WHEN contains({_SV}, 'demolition') THEN 1 ELSE 0 END + CASE WHEN {_NM} > 5 THEN 1 ELSE 0 END)"


def _yn(c, no="No"):
    return f"CASE WHEN {c} THEN 'Yes' ELSE '{no}' END"


query(
    "operational_capability",
    f"""{CO} SELECT id, {_yn(f"contains({_SV}, 'pickup')")} AS pickup_service, {_yn(_CONT)} AS container_rental, {_yn(f"contains({_SV}, 'demolition')")} AS demolition_service,
        {_yn(_PROC)} AS processing_capabilities, {_yn(f"contains({_SV}, 'scale')")} AS certified_scales,
        CASE WHEN coalesce(hours, '') = '' THEN 'Unknown' WHEN {S.has_any('lower(hours)', ['24', 'monday', 'weekday'])} THEN 'Full Time' ELSE 'Limited Hours' END AS operation_schedule,
        CASE WHEN {_FAC} >= 5 THEN 'Large Industrial' WHEN {_FAC} >= 3 THEN 'Medium Commercial' ELSE 'Small Local' END AS facility_size,
        CASE WHEN {_FAC} >= 5 THEN '20+ employees' WHEN {_FAC} >= 3 THEN '5-20 employees' ELSE '1-5 employees' END AS employee_estimate FROM companies""",
)(
    lambda spark, sf_dir: profile_records(_co(spark, sf_dir)).select(
        "id", "pickup_service", "container_rental", "demolition_service", "processing_capabilities", "certified_scales", "operation_schedule", "facility_size", "employee_estimate")
)
_PRO = f"{_full('website')} AND (contains(lower(website), '.com') OR contains(lower(website), 'www'))"
_PRICED = f"({_full('website')} AND {_full('pricing')})"
query(
    "digital_presence",
    f"""{CO} SELECT id, CASE WHEN NOT {_full('website')} THEN 'No Website' WHEN {_PRO} THEN 'Professional' ELSE 'Basic' END AS website_quality, {_yn(_PRICED)} AS pricing_available,
        CASE WHEN {_PRICED} THEN pricing ELSE 'Not Available' END AS pricing_info, CASE WHEN {_PRO} THEN 'Likely Present' ELSE 'Limited/None' END AS social_media_presence FROM companies""",
)(
    lambda spark, sf_dir: _co(spark, sf_dir).withColumns(Q.digital_presence("website", "pricing"))
    .select("id", "website_quality", "pricing_available", "pricing_info", "social_media_presence")
)
_FT = "lower(concat_ws(' ', coalesce(array_to_string(services, ' '), ''), description))"
query(
    "commercial_flags",
    f"""{CO} SELECT id, {_yn(S.has_any(_FT, ['commercial', 'industrial', 'business', 'corporate']), 'Unknown')} AS commercial_accounts,
        CASE WHEN {S.has_any(_FT, ['license', 'permit', 'authorized'])} THEN 'Licensed Operation' ELSE 'Standard Operation' END AS licenses,
        CASE WHEN {S.has_any(_FT, ['environmental', 'green', 'sustainable', 'eco'])} THEN 'Enhanced' ELSE 'Standard' END AS environmental_compliance FROM companies""",
)(lambda spark, sf_dir: profile_records(_co(spark, sf_dir)).select("id", "commercial_accounts", "licenses", "environmental_compliance"))
_SPEC = f"CASE WHEN {_NM} = 0 THEN 'Unknown' WHEN {_NM} <= 2 THEN 'High' WHEN {_NM} <= 5 THEN 'Medium' ELSE 'Low' END"
_SIZE = f"({_full('website')}::INT + {_full('phone')}::INT + {_full('email')}::INT + ({_NS} > 0)::INT + {_PRICED}::INT)"
SIZE = f"CASE WHEN {_SIZE} >= 4 THEN 'Large' WHEN {_SIZE} >= 2 THEN 'Medium' ELSE 'Small' END"
TIER = f"CASE WHEN {S.has_any('lower(coalesce(city, chr(32)))', L.MAJOR_METROS)} THEN 'Tier 1 (Major Metro)' WHEN state IN ('CA','TX','NY','FL','IL','PA','OH','GA','NC','MI') THEN 'Tier 2 (Major State)' ELSE 'Tier 3 (Regional)' END"
_PTS = f"(CASE WHEN {COMPLETENESS} > 70 THEN 3 WHEN {COMPLETENESS} > 50 THEN 2 WHEN {COMPLETENESS} > 30 THEN 1 ELSE 0 END + CASE WHEN {CONTACT_QUALITY} >= 4 THEN 2 WHEN {CONTACT_QUALITY} >= 2 THEN 1 ELSE 0 END + {_full('website')}::INT + {_PRICED}::INT)"
PRIORITY = f"CASE WHEN {_PTS} >= 6 THEN 'High' WHEN {_PTS} >= 4 THEN 'Medium' ELSE 'Low' END"
_ADV = ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in [
    ("Pickup Service", f"contains({_SV}, 'pickup')"), ("Container Rental", _CONT), ("Certified Scales", f"contains({_SV}, 'scale')"), ("Processing", _PROC),
    ("Commercial Focus", S.has_any(_FT, ["commercial", "industrial", "business", "corporate"])), ("Specialized", f"{_NM} BETWEEN 1 AND 2")])
query(
    "business_profile",
    f"""{CO} SELECT id, CASE WHEN {_NM} > 0 THEN array_to_string(materials[1:3], ', ') ELSE 'Unknown' END AS primary_metal_types, CAST({_NM} AS BIGINT) AS all_metal_types_count,
        {_SPEC} AS specialization_score, {SIZE} AS business_size_estimate, {TIER} AS market_tier, {PRIORITY} AS outreach_priority,
        coalesce(nullif(concat_ws(', ', {_ADV}), ''), 'Standard Operations') AS competitive_advantage FROM companies""",
)(
    lambda spark, sf_dir: profile_records(_co(spark, sf_dir)).select(
        "id", "primary_metal_types", F.col("all_metal_types_count").cast("bigint").alias("all_metal_types_count"), "specialization_score",
        "business_size_estimate", "market_tier", "outreach_priority", "competitive_advantage")
)
_HI = f"({S.has_any('lower(coalesce(city, chr(32)))', L.HIGH_COMPETITION_CITIES)} OR coalesce(state, '') IN ('OH','PA','MI','IN','IL'))"
query(
    "market_position",
    f"""{CO} SELECT id, CASE WHEN {_HI} THEN 'High' WHEN state IN ('TX','CA','NY','FL') THEN 'Medium' ELSE 'Low' END AS local_competition_level,
        CASE WHEN {_HI} THEN 'Competitive Market' WHEN state IN ('TX','CA','NY','FL') THEN 'Balanced Market' ELSE 'Growth Opportunity' END AS market_opportunity,
        CASE WHEN {_NS} >= 4 AND {_NM} >= 5 THEN 'Limited (Full Service)' WHEN {_NS} >= 2 OR {_NM} >= 3 THEN 'Moderate' ELSE 'High (Underserved)' END AS expansion_potential FROM companies""",
)(lambda spark, sf_dir: profile_records(_co(spark, sf_dir)).select("id", "local_competition_level", "market_opportunity", "expansion_potential"))
query(
    "select_essential_columns",
    f"{CO} SELECT name, address, city, state, zip_code, latitude, longitude, phone, email, website, id, source FROM companies",
)(
    lambda spark, sf_dir: Q.select_essential_columns(
        _co(spark, sf_dir).select("id", "website", "source", "phone", "email", "zip_code", "state", "city", "address", "name", "longitude", "latitude"))
)
