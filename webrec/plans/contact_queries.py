"""Queries for phones, e-mails, addresses, hours and contact fields."""

from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions import contacts as C
from webrec.functions.quality import filter_has_contact
from webrec.plans import sqltext as S
from webrec.plans.inputs import table, view, with_views
from webrec.plans.registry import query

CO = with_views("companies")
CP = with_views("company_pages")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _companies(spark, sf_dir):
    return view(spark, sf_dir, "companies")


# -- e-mails: word boundaries are Unicode-aware on both sides ------------------
_E = r"regexp_extract_all(text, '(?:^|[^\pL\pN_])([A-Za-z0-9_][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,})|[\pL\pN_]([.%+-][A-Za-z0-9._%+-]*@[A-Za-z0-9.-]+\.[A-Za-z]{2,})', GRP)"
_ALL = f"list_transform(list_zip({_E.replace('GRP', '1')}, {_E.replace('GRP', '2')}), lambda z: coalesce(nullif(z[1], ''), z[2]))"
query("extract_emails", f"SELECT doc_id, array_to_string({S.distinct('l')}, '|') AS emails FROM (SELECT doc_id, {_ALL} AS l FROM documents)")(
    lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.array_join(C.extract_emails("text"), "|").alias("emails"))
)
query(
    "extract_business_emails",
    f"SELECT doc_id, array_to_string({S.distinct('l')}, '|') AS emails FROM (SELECT doc_id, [lower(e) for e in {_ALL} if NOT contains(lower(e), 'mail3.example')] AS l FROM documents)",
)(lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.array_join(C.extract_business_emails("text", ["mail3.example"]), "|").alias("emails")))
query(
    "extract_mailto",
    f"{CP} SELECT page_id, CASE WHEN page_id % 6 = 1 THEN 'info' || page_id || '@yard.org' ELSE '' END AS emails FROM company_pages",
)(lambda spark, sf_dir: view(spark, sf_dir, "company_pages").select("page_id", F.array_join(C.extract_mailto("html"), "|").alias("emails")))

_FULL = r"regexp_full_match(coalesce(email, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}')"
query(
    "validate_email",
    f"{CO} SELECT id, {_FULL} AND NOT {S.has_any('lower(email)', L.EMAIL_EXCLUDE_SUBSTRINGS)} IS TRUE AS ok_substring, "
    f"{_FULL} AND coalesce(lower(split_part(email, '@', 2)) NOT IN ({', '.join(S.lit(d) for d in L.EMAIL_TEST_DOMAINS)}), true) AS ok_domain FROM companies",
)(
    lambda spark, sf_dir: _companies(spark, sf_dir).select(
        "id", C.validate_email("email").alias("ok_substring"), C.validate_email("email", test_domains=L.EMAIL_TEST_DOMAINS).alias("ok_domain"))
)

# -- phones -------------------------------------------------------------------
_P = [p.replace("'", "''") for p in C.US_PHONE_PATTERNS]
_CAT = "list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}')" for p in (_P[0], _P[1])) + f", regexp_extract_all(text, '{_P[3]}'))"
_TEN = r"[right(regexp_replace(x, '\D', '', 'g'), 10) for x in l if length(regexp_replace(x, '\D', '', 'g')) IN (10, 11)]"
_FMT = "['(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] for d in t]"
query(
    "extract_phones",
    f"SELECT doc_id, array_to_string({S.distinct('f')}, '|') AS phones FROM (SELECT doc_id, {_FMT} AS f FROM (SELECT doc_id, {_TEN} AS t FROM (SELECT doc_id, {_CAT} AS l FROM documents)))",
)(lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.array_join(C.extract_phones("text"), "|").alias("phones")))


def _try(p):
    g = [f"regexp_extract(text, '{p}', {i})" for i in (1, 2, 3)]
    return f"CASE WHEN {g[0]} <> '' AND {g[0]} <> '000' AND {g[1]} <> '000' AND {g[2]} <> '0000' THEN '(' || {g[0]} || ') ' || {g[1]} || '-' || {g[2]} END"


query("extract_phone_first", "SELECT doc_id, coalesce(" + ", ".join(_try(p) for p in C.FIRST_PHONE_PATTERNS) + ") AS phone FROM documents")(
    lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", C.extract_phone_first("text").alias("phone"))
)
query(
    "extract_email_first",
    r"SELECT doc_id, [e for e in [lower(x) for x in regexp_extract_all(text, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}')] if NOT contains(e, 'mail5.example.com')][1] AS email FROM documents",
)(lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", C.extract_email_first("text", ["mail5.example.com", "test.com", "sample.com"]).alias("email")))

_D = r"regexp_replace(coalesce(phone, ''), '\D', '', 'g')"
_N = f"CASE WHEN length({_D}) = 10 THEN {_D} WHEN length({_D}) = 11 AND {_D}[1] = '1' THEN {_D}[2:11] END"


def _fmt(n):
    return f"'(' || {n}[1:3] || ') ' || {n}[4:6] || '-' || {n}[7:10]"


query(
    "normalize_phone_us",
    f"{CO} SELECT id, coalesce({_fmt('n')}, phone) AS kept, {_fmt('n')} AS loose, CASE WHEN n[1] NOT IN ('0', '1') AND n[4] NOT IN ('0', '1') THEN {_fmt('n')} END AS strict "
    f"FROM (SELECT id, phone, {_N} AS n FROM companies)",
)(
    lambda spark, sf_dir: _companies(spark, sf_dir).select(
        "id", C.normalize_phone_us("phone", "keep").alias("kept"), C.normalize_phone_us("phone", "null").alias("loose"),
        C.normalize_phone_us("phone").alias("strict"))
)
query(
    "normalize_phone_e164",
    f"""{CO} SELECT id, CASE WHEN n IS NOT NULL AND n[1] NOT IN ('0', '1') AND n[4] NOT IN ('0', '1') THEN '+1' || n END AS e164 FROM (SELECT id, {_N} AS n FROM companies)""",
)(lambda spark, sf_dir: _companies(spark, sf_dir).select("id", C.normalize_phone_e164("phone", "country").alias("e164")))

# fixed rules restated: digits as a list, differences instead of patterns
_STRICT = f"""(n IS NOT NULL AND n[1] NOT IN ('0','1') AND n[4] NOT IN ('0','1') AND n[1:3] NOT IN ({', '.join(S.lit(a) for a in L.PHONE_INVALID_AREAS)})
 AND NOT (n[4:6] = '555' AND n[7:8] = '01') AND len(list_distinct(string_split(n, ''))) >= 4
 AND len([i for i in range(1, 8) if n[i] = n[i+1] AND n[i] = n[i+2] AND n[i] = n[i+3]]) = 0
 AND len([i for i in range(1, 7) if ascii(n[i+1]) = ascii(n[i]) + 1 AND ascii(n[i+2]) = ascii(n[i]) + 2 AND ascii(n[i+3]) = ascii(n[i]) + 3 AND ascii(n[i+4]) = ascii(n[i]) + 4]) = 0
 AND n NOT IN ({', '.join(S.lit(a) for a in L.PHONE_FAKE_NUMBERS)}))"""
query("validate_phone_strict", f"{CO} SELECT id, coalesce({_STRICT}, false) AS valid FROM (SELECT id, {_N} AS n FROM companies)")(
    lambda spark, sf_dir: _companies(spark, sf_dir).select("id", C.validate_phone_strict("phone").alias("valid"))
)

# candidates on the company pages: where each number is written is known
_CAND = f"""SELECT page_id, '713868' || n4 AS n, 90 AS confidence, 'structured_data' AS method FROM company_pages WHERE page_id % 5 IN (0, 3)
 UNION ALL SELECT page_id, '713' || (200 + page_id % 700) || n4, 95, 'tel_link' FROM company_pages WHERE page_id % 2 = 0
 UNION ALL SELECT page_id, '713681' || n4, 75, 'css_class' FROM company_pages WHERE page_id % 7 = 0"""
_BEST = f"SELECT page_id, {_fmt('n')} AS phone, CAST(max(confidence) AS BIGINT) AS confidence, arg_max(method, confidence) AS method FROM ({_CAND}) WHERE {_STRICT} GROUP BY ALL"
query("phone_candidates", f"{CP} {_BEST}")(
    lambda spark, sf_dir: view(spark, sf_dir, "company_pages")
    .select("page_id", F.explode(C.phone_candidates("html")).alias("c"))
    .select("page_id", "c.phone", F.col("c.confidence").cast("bigint").alias("confidence"), "c.method")
)
query(
    "best_phone",
    f"{CP} SELECT page_id, arg_max(phone, confidence) AS phone, max(confidence) AS confidence FROM ({_BEST}) GROUP BY page_id",
)(
    lambda spark, sf_dir: view(spark, sf_dir, "company_pages")
    # a filter on the result would be pushed below it and make page and phones
    # again; inside the generator each page is worked on once
    .select("page_id", F.inline(F.array_compact(F.array(C.best_phone(C.phone_candidates("html"))))))
    .select("page_id", "phone", F.col("confidence").cast("bigint").alias("confidence"))
)

# -- cleaning -----------------------------------------------------------------
_FAKE = f"coalesce(({_N})[1:3] IN ('555', '000', '999', '123'), false)"
query(
    "clean_contact_record",
    f"""{CO} SELECT id, CASE WHEN phone IS NULL OR {_FAKE} THEN '' ELSE coalesce({_fmt('(' + _N + ')')}, phone) END AS phones, {_FAKE} AS had_fake_phone,
        CASE WHEN regexp_full_match(lower(coalesce(email, '')), '[a-z0-9._%+-]+@[a-z0-9.-]+[.][a-z]{{2,}}') THEN lower(email) ELSE '' END AS emails,
        CASE WHEN website IS NULL OR website = '' OR regexp_matches(website, '^https?://') THEN website ELSE 'https://' || website END AS website,
        CASE id % 4 WHEN 0 THEN 'Mon-Fri 8:00 - 17:00' WHEN 1 THEN 'Open 24 hours' WHEN 2 THEN 'Mon to Sat 9:30 until 18:30, Sun closed' END AS hours,
        CASE WHEN lower(country) IN ('united states', 'usa', 'us') THEN substr(zip_code, 1, 5) ELSE zip_code END AS zip_code,
        coalesce(lower(country) IN ('united states', 'usa', 'us') AND substr(zip_code, 1, 5) IN ({', '.join(S.lit(z) for z in L.FAKE_ZIPS)}), false) AS had_fake_zip
        FROM companies""".replace("THEN substr(zip_code, 1, 5) ELSE zip_code END AS zip_code", f"THEN CASE WHEN substr(zip_code, 1, 5) IN ({', '.join(S.lit(z) for z in L.FAKE_ZIPS)}) THEN NULL ELSE substr(zip_code, 1, 5) END ELSE zip_code END AS zip_code"),
)(
    lambda spark, sf_dir: C.clean_contact_record(
        _companies(spark, sf_dir).withColumn("phones", F.array_compact(F.array("phone"))).withColumn("emails", F.array_compact(F.array("email")))
    ).select("id", F.array_join("phones", "|").alias("phones"), "had_fake_phone", F.array_join("emails", "|").alias("emails"), "website", "hours", "zip_code", "had_fake_zip")
)
query("filter_has_contact", f"{CO} SELECT id FROM companies WHERE coalesce(phone, '') <> '' OR coalesce(email, '') <> ''")(
    lambda spark, sf_dir: _companies(spark, sf_dir).where(filter_has_contact("phone", "email")).select("id")
)
query("normalize_day_names", f"{CO} SELECT id, CASE id % 4 WHEN 0 THEN 'Mon-Fri 8:00 - 17:00' WHEN 1 THEN 'Open 24 hours' WHEN 2 THEN 'Mon to Sat 9:30 until 18:30, Sun closed' END AS hours FROM companies")(
    lambda spark, sf_dir: _companies(spark, sf_dir).select("id", C.normalize_day_names("hours").alias("hours"))
)
query(
    "clean_text",
    r"SELECT doc_id, trim(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '[^\p{L}\p{N}_\s.,()&@#-]', '', 'g')) AS cleaned FROM documents",
)(lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", C.clean_text("text").alias("cleaned")))
query(
    "valid_city",
    f"{CO} SELECT id, length(coalesce(c, '')) >= 3 AND lower(trim(c)) NOT IN ({', '.join(S.lit(w) for w in L.CITY_STOP_WORDS)}) AND NOT regexp_full_match(lower(trim(c)), '[a-z]{{1,2}}|[0-9]+') AND regexp_matches(c, '[a-zA-Z]') IS TRUE AS ok "
    "FROM (SELECT id, CASE id % 11 WHEN 0 THEN 'the' WHEN 1 THEN '12345' WHEN 2 THEN ' on ' ELSE coalesce(city, '') END AS c FROM companies)",
)(
    lambda spark, sf_dir: _companies(spark, sf_dir).select(
        "id", C.valid_city(F.expr("CASE id % 11 WHEN 0 THEN 'the' WHEN 1 THEN '12345' WHEN 2 THEN ' on ' ELSE coalesce(city, '') END")).alias("ok"))
)

# addresses written into a sentence in four ways
_ADDR = """CASE id % 5 WHEN 0 THEN 'Visit ' || CAST(100 + id AS STRING) || ' W Montgomery Road, Houston, TX 77086 today'
 WHEN 1 THEN 'Yard at ' || CAST(100 + id AS STRING) || ' Hempstead Rd Houston, TX 77008-1234' WHEN 2 THEN 'Houston, TX 77008'
 WHEN 3 THEN CAST(id AS STRING) || ' Elm Ave Dallas TX, call' ELSE 'Nowhere, ZZ 12345 at all' END"""
query(
    "parse_us_address",
    f"""{CO} SELECT id, CASE id % 5 WHEN 0 THEN (100 + id) || ' W Montgomery Road' WHEN 1 THEN (100 + id) || ' Hempstead Rd' WHEN 3 THEN id || ' Elm Ave' END AS street,
        CASE id % 5 WHEN 0 THEN 'Houston' WHEN 1 THEN 'Houston' WHEN 2 THEN 'Houston' WHEN 3 THEN 'Dallas' END AS city, CASE WHEN id % 5 < 4 THEN 'TX' END AS state,
        CASE id % 5 WHEN 0 THEN '77086' WHEN 1 THEN '77008-1234' WHEN 2 THEN '77008' END AS postal, CASE WHEN id % 5 < 4 THEN 'United States' END AS country FROM companies""",
)(
    lambda spark, sf_dir: _companies(spark, sf_dir).select("id", C.parse_us_address(F.expr(_ADDR)).alias("a")).select("id", "a.*")
)
query(
    "simple_address_parts",
    f"{CO}, a AS (SELECT id, {_ADDR} AS t FROM companies) SELECT id, nullif(regexp_extract(t, '\\b[0-9]{{5}}(?:-[0-9]{{4}})?\\b'), '') AS postal_code, CASE id % 5 WHEN 4 THEN 'ZZ' ELSE 'TX' END AS state FROM a",
)(
    lambda spark, sf_dir: _companies(spark, sf_dir).select("id", C.simple_address_parts(F.expr(_ADDR)).alias("a")).select("id", "a.*")
)

# -- map tags -----------------------------------------------------------------
TAGS = """map_from_arrays(array('name', 'addr:housenumber', 'addr:street', 'phone', 'contact:phone', 'fax', 'addr:full'),
 array(name, CASE WHEN id % 3 = 0 THEN split_part(address, ' ', 1) END, CASE WHEN id % 3 < 2 THEN 'Hempstead Rd' END, CASE WHEN id % 2 = 0 THEN '' ELSE phone END,
 CASE WHEN id % 4 = 0 THEN phone END, 'fax' || CAST(id AS STRING), address))"""
query(
    "build_osm_address",
    f"""{CO} SELECT id, CASE WHEN id % 3 = 0 THEN coalesce(split_part(address, ' ', 1) || ' ', '') || 'Hempstead Rd' WHEN id % 3 = 1 THEN 'Hempstead Rd' ELSE address END AS osm_address FROM companies""",
)(lambda spark, sf_dir: _companies(spark, sf_dir).select("id", C.build_osm_address(F.expr(TAGS)).alias("osm_address")))
query(
    "first_tag",
    f"""{CO} SELECT id, CASE WHEN id % 2 = 1 AND phone IS NOT NULL THEN phone WHEN id % 4 = 0 AND phone IS NOT NULL THEN phone ELSE 'fax' || id END AS phone FROM companies""",
)(lambda spark, sf_dir: _companies(spark, sf_dir).select("id", C.first_tag(F.expr(TAGS)).alias("phone")))

# -- maps and guesses ---------------------------------------------------------
_SOC = "'See http://fb.com/y' || CAST(id AS STRING) || ' and twitter.com/t' || CAST(id AS STRING) || CASE WHEN id % 2 = 0 THEN ' or t.me/g' || CAST(id AS STRING) ELSE '' END"
query(
    "social_map",
    f"""{CO} SELECT id, 'https://fb.com/y' || id AS facebook, 'https://twitter.com/t' || id AS twitter, CASE WHEN id % 2 = 0 THEN 'https://t.me/g' || id END AS telegram,
        CAST(2 + (id + 1) % 2 AS BIGINT) AS platforms FROM companies""",
)(
    lambda spark, sf_dir: _companies(spark, sf_dir).select("id", C.social_map(F.expr(_SOC)).alias("m")).select(
        "id", F.col("m")["facebook"].alias("facebook"), F.col("m")["twitter"].alias("twitter"), F.col("m")["telegram"].alias("telegram"), F.size("m").cast("bigint").alias("platforms"))
)
query(
    "working_hours_map",
    f"""{CO} SELECT id, CASE WHEN id % 2 = 0 THEN (id % 3 + 7) || ':30 am - 5 pm' END AS monday, CASE WHEN id % 2 = 1 THEN '9 - ' || (id % 3 + 4) END AS wednesday, 'Closed' AS sunday,
        CAST(2 AS BIGINT) AS days FROM companies""",
)(
    lambda spark, sf_dir: _companies(spark, sf_dir).select(
        "id", C.working_hours_map(F.expr(
            "CASE WHEN id % 2 = 0 THEN 'Monday: ' || CAST(id % 3 + 7 AS STRING) || ':30am - 5 pm. Sunday closed' ELSE 'wed 9 to ' || CAST(id % 3 + 4 AS STRING) || '; sun: closed' END")).alias("m")
    ).select("id", F.col("m")["monday"].alias("monday"), F.col("m")["wednesday"].alias("wednesday"), F.col("m")["sunday"].alias("sunday"), F.size("m").cast("bigint").alias("days"))
)
query(
    "hours_text",
    f"{CO} SELECT id, CASE id % 4 WHEN 0 THEN 'monday-FRI 8:00 - 17:00' END AS hours FROM companies",
)(lambda spark, sf_dir: _companies(spark, sf_dir).select("id", C.hours_text("hours").alias("hours")))
_FIELD = "CASE id % 4 WHEN 0 THEN name WHEN 1 THEN phone WHEN 2 THEN address ELSE website END"
query(
    "classify_text_field",
    f"""{CO} SELECT id, CASE WHEN length(coalesce(f, '')) >= 3 AND {S.has_any('lower(f)', ['metal', 'scrap', 'recycling', 'salvage', 'steel', 'aluminum', 'copper', 'inc', 'llc'])} AND NOT starts_with(f, 'http') THEN 'name'
        WHEN regexp_matches(f, '\\(\\d{{3}}\\)\\s*\\d{{3}}[-\\s]?\\d{{4}}|\\d{{3}}[-\\s]?\\d{{3}}[-\\s]?\\d{{4}}') THEN 'phone'
        WHEN length(f) >= 5 AND regexp_matches(f, '[0-9]') AND {S.has_any('lower(f)', ['st', 'ave', 'rd', 'road', 'blvd', 'dr', 'ln', 'lane'])} THEN 'address'
        WHEN starts_with(f, 'http') OR {S.has_any('f', ['.com', '.net', '.org', '.biz'])} THEN 'website' END AS kind FROM (SELECT id, {_FIELD} AS f FROM companies)""",
)(lambda spark, sf_dir: _companies(spark, sf_dir).select("id", C.classify_text_field(F.expr(_FIELD)).alias("kind")))
query(
    "split_primary_secondary",
    f"{CO} SELECT id, CASE WHEN phone IS NOT NULL THEN phone ELSE email END AS contact_primary, CASE WHEN phone IS NOT NULL THEN email END AS contact_secondary FROM companies",
)(
    lambda spark, sf_dir: _companies(spark, sf_dir).withColumn("contacts", F.array_compact(F.array("phone", "email"))).select(
        "id", *C.split_primary_secondary("contacts", "contact"))
)
query(
    "group_fields_to_records",
    f"""{CO} SELECT id, CAST(0 AS BIGINT) AS pos, CASE WHEN {S.has_any("lower(coalesce(name, ''))", ['metal', 'scrap', 'recycling', 'salvage', 'steel', 'aluminum', 'copper'])} THEN name END AS name, 'x@y.org' AS website
        FROM companies WHERE {S.has_any("lower(coalesce(name, ''))", ['metal', 'scrap', 'recycling', 'salvage', 'steel', 'aluminum', 'copper'])}
        UNION ALL SELECT id, 1, 'Steel Works ' || id, NULL FROM companies""",
)(
    lambda spark, sf_dir: C.group_fields_to_records(
        _companies(spark, sf_dir).select("id", F.array(F.coalesce("name", F.lit("")), F.concat(F.lit("Steel Works "), "id")).alias("g1"), F.array(F.lit("x@y.org")).alias("g2")),
        ["g1", "g2"], "id",
    ).select("id", F.col("pos").cast("bigint").alias("pos"), "name", "website")
)
query(
    "flatten_record",
    f"{CO} SELECT id, city AS place_city, state AS place_state, array_to_string(materials, ', ') AS materials FROM companies",
)(
    lambda spark, sf_dir: C.flatten_record(_companies(spark, sf_dir).select("id", F.struct("city", "state").alias("place"), "materials"))
)
query(
    "format_us_csv_fields",
    f"""{CO} SELECT id, name, state AS state_region, zip_code AS postal_code, CASE WHEN services IS NULL THEN NULL ELSE '["' || array_to_string(services, '","') || '"]' END AS services_offered FROM companies""",
)(
    lambda spark, sf_dir: C.format_us_csv_fields(
        _companies(spark, sf_dir).select("id", "name", F.col("state"), F.col("zip_code").alias("postal_code"), F.col("services").alias("services_offered")))
)

