"""Queries for company records: blocks, hours, phones by country, contact pages."""

from pyspark.sql import functions as F

from webrec.functions.company_blocks import blocks_address, blocks_company_name, blocks_hours, company_blocks
from webrec.functions.hours import normalize_hours
from webrec.functions.html import plain_text
from webrec.functions.phone_plans import extract_phones_by_region, region_of
from webrec.operators import extraction as X
from webrec.operators.contact_pages import contact_page_fallback
from webrec.plans.inputs import view, with_views
from webrec.plans.registry import query

BP = with_views("business_pages")
_ID = "CAST(page_id AS VARCHAR)"
# what stands on the pages, shape by shape
_NAME = f"""CASE WHEN page_id < 0 THEN CASE WHEN contains(url, 'team') THEN 'Team' ELSE 'Contact' END ELSE CASE page_id % 8 WHEN 0 THEN 'Alpha Yard ' WHEN 1 THEN 'Beta Metals ' WHEN 2 THEN 'Gamma Steel '
  WHEN 3 THEN 'Delta Iron ' WHEN 4 THEN 'Epsilon Copper ' WHEN 5 THEN 'Zeta Brass ' WHEN 6 THEN 'Eta Lead ' ELSE 'Theta Zinc ' END || {_ID} END"""
_STREET = f"""CASE page_id % 8 WHEN 0 THEN n4 || ' Main St' WHEN 1 THEN n4 || ' Oak Avenue' WHEN 2 THEN {_ID} || ' High St' WHEN 3 THEN n4 || ' Elm Street' WHEN 5 THEN n4 || ' Quay' WHEN 6 THEN n4 || ' Pine Road' END"""
_CITY = "CASE page_id % 8 WHEN 0 THEN 'Houston' WHEN 1 THEN 'Dallas' WHEN 2 THEN 'Leeds' WHEN 3 THEN 'Erie' WHEN 5 THEN 'Dublin' WHEN 6 THEN 'Boise' END"
_REGION = "CASE page_id % 8 WHEN 0 THEN 'TX' WHEN 1 THEN 'TX' WHEN 2 THEN 'Yorkshire' WHEN 3 THEN 'PA' WHEN 6 THEN 'ID' END"
_POSTAL = "CASE page_id % 8 WHEN 0 THEN '77008' WHEN 1 THEN '75201' WHEN 2 THEN 'LS1 4DY' WHEN 3 THEN '16501' WHEN 6 THEN '83702' END"
_COUNTRY = "CASE page_id % 8 WHEN 2 THEN 'England' WHEN 4 THEN 'Australia' WHEN 5 THEN 'Ireland' WHEN 7 THEN 'USA' ELSE 'United States' END"
_WEEK = "Mon,Tue,Wed,Thu,Fri"
_HOURS = f"""CASE page_id % 8 WHEN 0 THEN '{_WEEK}: 08:00-17:00; Sat: 09:00-13:00' WHEN 1 THEN '{_WEEK}: 08:00-17:00; Sat: 09:00-12:00' WHEN 2 THEN 'Mon,Wed,Fri: 09:00-12:00'
  WHEN 3 THEN '{_WEEK},Sat,Sun: 07:00-19:00' WHEN 4 THEN '{_WEEK}: 08:00-12:00,13:00-17:00; Sat,Sun: closed' WHEN 5 THEN 'Monday: 08:00-17:00' WHEN 6 THEN '{_WEEK},Sat: 09:30-18:30; Sun: closed' END"""
_PHONES = """CASE WHEN page_id < 0 THEN CASE WHEN contains(url, 'team') THEN '(303) 869-' || n4 WHEN (-page_id) // 10 % 16 = 7 THEN '(303) 868-' || n4 ELSE '' END
  ELSE CASE page_id % 8 WHEN 0 THEN '(713) 868-' || n4 WHEN 1 THEN '(214) 868-' || n4 WHEN 2 THEN '+44 113496' || n4 || '|+44 113497' || n4 WHEN 3 THEN '(814) 868-' || n4
  WHEN 4 THEN '+61 29374' || n4 || '|+61 130097' || n4 WHEN 5 THEN '+353 1677' || n4 || '|+353 87123' || n4 ELSE '' END END"""
_EMAILS = f"""CASE WHEN page_id < 0 THEN CASE WHEN contains(url, 'contact') THEN 'theta' || CAST((-page_id) // 10 AS VARCHAR) || '@yard.org' ELSE '' END
  ELSE CASE page_id % 8 WHEN 1 THEN 'beta' || {_ID} || '@yard.org' WHEN 6 THEN 'eta' || {_ID} || '@yard.org' ELSE '' END END"""
# a home page of the last shape takes what its contact pages have, in the order of its links
_FOUND = "page_id > 0 AND page_id % 8 = 7"
_PHONES_FOUND = f"CASE WHEN {_FOUND} THEN CASE WHEN page_id % 16 = 7 THEN '(303) 868-' || n4 || '|' ELSE '' END || '(303) 869-' || n4 ELSE {_PHONES} END"
_EMAILS_FOUND = f"CASE WHEN {_FOUND} THEN 'theta' || {_ID} || '@yard.org' ELSE {_EMAILS} END"
_OWN = f"page_id > 0 AND {_PHONES} || {_EMAILS} <> ''"


def _pages(spark, sf_dir):
    return view(spark, sf_dir, "business_pages")


def _blocks(spark, sf_dir):
    return _pages(spark, sf_dir).where("page_id > 0").withColumn("blocks", company_blocks("html"))


def _joined(df, *more):
    return df.select("page_id", F.array_join("phones", "|").alias("phones"), F.array_join("emails", "|").alias("emails"), *more)


query(
    "company_record",
    f"""{BP} SELECT page_id, url AS website, {_NAME} AS name, {_STREET} AS street_address, {_CITY} AS city, {_REGION} AS region, {_POSTAL} AS postal_code, {_COUNTRY} AS country,
        {_HOURS} AS opening_hours, {_PHONES} AS phones, {_EMAILS} AS emails FROM business_pages WHERE {_OWN}""",
)(
    lambda spark, sf_dir: X.extract_company(_pages(spark, sf_dir).where("page_id > 0"), country=F.col("country"), blocks=True).select(
        "page_id", "website", "name", "street_address", "city", "region", "postal_code", "country", "opening_hours",
        F.array_join("phones", "|").alias("phones"), F.array_join("emails", "|").alias("emails"))
)
query(
    "contact_page_fallback",
    f"""{BP} SELECT page_id, {_PHONES_FOUND} AS phones, {_EMAILS_FOUND} AS emails, {_FOUND} AS from_contact_page FROM business_pages""",
)(
    lambda spark, sf_dir: _joined(contact_page_fallback(_pages(spark, sf_dir), region_of("country")), "from_contact_page")
)
query(
    "company_record_contact_pages",
    f"""{BP} SELECT page_id, {_NAME} AS name, {_PHONES_FOUND} AS phones, {_EMAILS_FOUND} AS emails FROM business_pages WHERE {_PHONES_FOUND} || {_EMAILS_FOUND} <> ''""",
)(
    lambda spark, sf_dir: _joined(X.extract_company(_pages(spark, sf_dir), country=F.col("country"), contact_pages=True, blocks=True), "name")
)
query(
    "html_address_blocks",
    f"""{BP} SELECT page_id, CASE page_id % 8 WHEN 5 THEN '1 Main St' ELSE {_STREET} END AS street, CASE page_id % 8 WHEN 5 THEN 'Houston' ELSE {_CITY} END AS city,
        CASE page_id % 8 WHEN 5 THEN 'TX' ELSE {_REGION} END AS region, CASE page_id % 8 WHEN 5 THEN '77008' ELSE {_POSTAL} END AS postal,
        CASE page_id % 8 WHEN 5 THEN 'United States' ELSE {_COUNTRY} END AS country FROM business_pages WHERE page_id > 0""",
)(
    lambda spark, sf_dir: _blocks(spark, sf_dir)
    .select("page_id", blocks_address(F.col("blocks"), plain_text("html"), F.col("country")).alias("a")).select("page_id", "a.*")
)
query(
    "html_hours_blocks",
    f"{BP} SELECT page_id, CASE page_id % 8 WHEN 5 THEN 'Mon: 01:00-02:00' ELSE {_HOURS} END AS hours FROM business_pages WHERE page_id > 0",
)(
    lambda spark, sf_dir: _blocks(spark, sf_dir).select("page_id", blocks_hours(F.col("blocks")).alias("hours"))
)
query(
    "company_name_blocks",
    f"{BP} SELECT page_id, CASE page_id % 8 WHEN 5 THEN 'Biz' || {_ID} ELSE {_NAME} END AS name FROM business_pages WHERE page_id > 0",
)(
    lambda spark, sf_dir: _blocks(spark, sf_dir).select("page_id", blocks_company_name(F.col("blocks"), "html", "url").alias("name"))
)
query(
    "normalize_hours",
    with_views("hours_forms") + f"""SELECT id, CASE id % 10 WHEN 0 THEN '{_WEEK}: 0' || h || ':00-17:00; Sat: 09:00-13:00' WHEN 1 THEN '{_WEEK}: 0' || h || ':00-17:30; Sat: 09:00-12:00'
        WHEN 2 THEN 'Mon,Wed,Fri: 0' || h || ':00-12:00' WHEN 3 THEN '{_WEEK},Sat: 0' || h || ':30-18:30; Sun: closed' WHEN 4 THEN '{_WEEK},Sat,Sun: 0' || h || ':00-19:00'
        WHEN 5 THEN '{_WEEK}: 0' || h || ':00-12:00,13:00-17:00; Sat,Sun: closed' WHEN 6 THEN 'Mon,Fri,Sat,Sun: 0' || h || ':00-14:00' WHEN 7 THEN 'Tue,Wed,Thu: 13:00-' || (h + 12) || ':00'
        WHEN 8 THEN '{_WEEK},Sat,Sun: 00:00-24:00' ELSE 'Sat: 22:00-0' || h || ':00' END AS hours FROM hours_forms""",
)(lambda spark, sf_dir: view(spark, sf_dir, "hours_forms").select("id", normalize_hours("hours").alias("hours")))
query(
    "extract_phones_by_region",
    with_views("phone_texts") + """SELECT id, CASE id % 8 WHEN 0 THEN '(713) 868-' || n4 || '|(713) 869-' || n4 || '|+44 207946' || n4 WHEN 1 THEN '(416) 868-' || n4
        WHEN 2 THEN '+44 207946' || n4 || '|+44 161496' || n4 WHEN 3 THEN '+61 29374' || n4 || '|+61 180097' || n4 WHEN 4 THEN '+64 9363' || n4 || '|+64 21363' || n4
        WHEN 5 THEN '+353 1677' || n4 || '|+353 87123' || n4 WHEN 6 THEN '+91 987651' || n4 || '|+91 222778' || n4 ELSE '+27 11978' || n4 END AS phones FROM phone_texts""",
)(
    lambda spark, sf_dir: view(spark, sf_dir, "phone_texts")
    .select("id", F.array_join(extract_phones_by_region("body", region_of("country")), "|").alias("phones"))
)
