"""Queries for de-duplication."""

from pyspark.sql import functions as F

from webrec.functions import contacts as C
from webrec.operators import dedup as D
from webrec.plans import sqltext as S
from webrec.plans.inputs import table, view, with_views
from webrec.plans.registry import query

CO = with_views("companies")
CR = with_views("crawl")
LOWN, LOWC, LOWS = "lower(trim(coalesce(name, '')))", "lower(trim(coalesce(city, '')))", "lower(trim(coalesce(state, '')))"
HOST = f"nullif({S.netloc('coalesce(website, chr(32))')}, '')"


def _co(spark, sf_dir):
    return view(spark, sf_dir, "companies")


def _first(key, order="id", src="companies", cols="id"):
    return f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS rn FROM {src}) WHERE rn = 1"


query("dedup_exact_url", CR + _first("url", "ts, event_id", "crawl", "event_id, url"))(
    lambda spark, sf_dir: D.first_per_key(view(spark, sf_dir, "crawl"), "url", [F.asc("ts"), F.asc("event_id")]).select("event_id", "url")
)
query("dedup_url_lower", with_views("urls") + "SELECT page_id FROM (SELECT page_id, row_number() OVER (PARTITION BY lower(trim(split_part(coalesce(url, ''), '?', 1))) ORDER BY page_id) AS rn FROM urls) WHERE rn = 1")(
    lambda spark, sf_dir: D.first_per_key(
        view(spark, sf_dir, "urls").withColumn("bare", F.split_part(F.coalesce("url", F.lit("")), F.lit("?"), F.lit(1))), D.key_url_lower("bare"), [F.asc("page_id")]).select("page_id")
)
query("dedup_host", f"{CO} SELECT id, website FROM ({_first(HOST, cols='*')}) WHERE {HOST} IS NOT NULL")(
    lambda spark, sf_dir: D.dedup_keyed(_co(spark, sf_dir), D.key_host(), [F.asc("id")]).select("id", "website")
)
query("dedup_host_or_identity", CO + _first(f"coalesce({HOST}, {LOWN} || '|' || {LOWC} || '|' || {LOWS})"))(
    lambda spark, sf_dir: D.dedup_keyed(_co(spark, sf_dir), D.key_host_or_identity(region="state"), [F.asc("id")]).select("id")
)
query("dedup_name_address_phone", f"{CO} SELECT id FROM ({_first(LOWN + ', lower(trim(coalesce(address, ' + chr(39) * 2 + '))), trim(coalesce(phone, ' + chr(39) * 2 + '))', cols='*')}) WHERE {LOWN} <> ''")(
    lambda spark, sf_dir: D.dedup_keyed(_co(spark, sf_dir), D.key_name_address_phone(), [F.asc("id")]).select("id")
)
query("dedup_name_city_state", f"{CO} SELECT id FROM ({_first(f'{LOWN}, {LOWC}, {LOWS}', cols='*')}) WHERE length({LOWN}) > 3")(
    lambda spark, sf_dir: D.dedup_keyed(_co(spark, sf_dir), D.key_name_city_state(), [F.asc("id")]).select("id")
)
query("dedup_name_city", f"{CO} SELECT id FROM ({_first(f'{LOWN}, {LOWC}', cols='*')}) WHERE {LOWN} <> ''")(
    lambda spark, sf_dir: D.dedup_keyed(_co(spark, sf_dir), D.key_name_city(), [F.asc("id")]).select("id")
)
query("dedup_phone_or_name_city", f"{CO}, n AS (SELECT * FROM companies WHERE {LOWN} <> '') " + _first(f"CASE WHEN trim(coalesce(phone, '')) <> '' THEN trim(phone) ELSE {LOWN} || '_' || {LOWC} END", src="n"))(
    lambda spark, sf_dir: D.dedup_keyed(_co(spark, sf_dir), D.key_phone_or_name_city(), [F.asc("id")]).select("id")
)
query(
    "dedup_name_phone_site",
    CO + _first(f"{LOWN}, regexp_replace(coalesce(phone, ''), '[ ()-]', '', 'g'), lower(trim(coalesce(website, '')))", cols="id, coalesce(phone, '') <> '' AS has_phone, CAST(length(coalesce(name, '')) AS BIGINT) AS name_length"),
)(
    lambda spark, sf_dir: D.dedup_keyed(_co(spark, sf_dir), D.key_name_phone_site(), [F.asc("id")])
    .select("id", (F.coalesce("phone", F.lit("")) != "").alias("has_phone"), F.length(F.coalesce("name", F.lit(""))).cast("bigint").alias("name_length"),
            (F.coalesce("email", F.lit("")) != "").alias("e"), (F.coalesce("address", F.lit("")) != "").alias("a"))
    .orderBy(F.desc("has_phone"), F.desc("e"), F.desc("a"), F.desc("name_length"), "id").drop("e", "a")
)
query("dedup_geo", f"{CO} SELECT id FROM ({_first(f'round(latitude, 4), round(longitude, 4), CASE WHEN latitude IS NULL THEN {LOWN} END', cols='*')}) WHERE latitude IS NOT NULL OR {LOWN} <> ''")(
    lambda spark, sf_dir: D.dedup_keyed(_co(spark, sf_dir), D.key_geo(), [F.asc("id")]).select("id")
)
query(
    "dedup_host_then_name",
    f"""{CO}, h AS (SELECT *, row_number() OVER (PARTITION BY coalesce({HOST}, 'own' || id) ORDER BY id) AS r1 FROM companies),
        n AS (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif({LOWN}, ''), 'own' || id) ORDER BY id) AS r2 FROM h WHERE r1 = 1) SELECT id FROM n WHERE r2 = 1""",
)(
    lambda spark, sf_dir: D.dedup_host_then_name(_co(spark, sf_dir), D.key_host(), F.nullif(D.low("name"), F.lit("")), [F.asc("id")]).select("id")
)


# greedy: the kept set is the only set where no kept row shares a key with an
# earlier kept one and every dropped row does, so recursion settles row by row
def _greedy_sql(k1, k2, src):
    """Row by row in plain SQL: the state carries all keys of kept rows."""
    return f"""WITH RECURSIVE {src[5:]}, r AS (SELECT id, {k1} AS a, {k2} AS b, row_number() OVER (ORDER BY id) AS n FROM companies),
     g AS (SELECT 0::BIGINT AS n, NULL::BIGINT AS id, []::VARCHAR[] AS sa, []::VARCHAR[] AS sb, false AS keep
       UNION ALL SELECT r.n, r.id,
        CASE WHEN (r.a IS NULL OR NOT list_contains(g.sa, r.a)) AND (r.b IS NULL OR NOT list_contains(g.sb, r.b)) AND r.a IS NOT NULL THEN list_append(g.sa, r.a) ELSE g.sa END,
        CASE WHEN (r.a IS NULL OR NOT list_contains(g.sa, r.a)) AND (r.b IS NULL OR NOT list_contains(g.sb, r.b)) AND r.b IS NOT NULL THEN list_append(g.sb, r.b) ELSE g.sb END,
        (r.a IS NULL OR NOT list_contains(g.sa, r.a)) AND (r.b IS NULL OR NOT list_contains(g.sb, r.b))
       FROM g JOIN r ON r.n = g.n + 1)
     SELECT id FROM g WHERE keep"""


query("dedup_greedy_name_or_site", _greedy_sql(f"nullif({LOWN}, '')", "nullif(lower(trim(coalesce(website, ''))), '')", CO))(
    lambda spark, sf_dir: D.dedup_greedy(_co(spark, sf_dir), D.greedy_keys_name_or_site(), "id").select("id")
)
query("dedup_greedy_contact_or_name", _greedy_sql("coalesce(phone, '') || '|' || coalesce(email, '')", "substr(lower(coalesce(name, '')), 1, 50)", CO))(
    lambda spark, sf_dir: D.dedup_greedy(_co(spark, sf_dir), D.greedy_keys_contact_or_name(), "id").select("id")
)
_CONF = "CASE pos % 3 WHEN 0 THEN 70 WHEN 1 THEN 95 ELSE 60 END"
query(
    "dedup_phone_candidates",
    f"""SELECT doc_id, phone, CAST(max(confidence) AS BIGINT) AS confidence, CAST(arg_min(pos, pos - confidence * 1000000) AS BIGINT) AS pos FROM (
       SELECT doc_id, '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10] AS phone, pos, {_CONF} AS confidence FROM (
       SELECT doc_id, pos, right(regexp_replace(raw, '[^0-9]', '', 'g'), 10) AS d FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS raw FROM (
       SELECT doc_id, regexp_extract_all(text || text, '\\(\\d{{3}}\\) \\d{{3}}-\\d{{4}}') AS l FROM documents)))) GROUP BY ALL""",
)(
    lambda spark, sf_dir: D.dedup_phone_candidates(
        table(spark, sf_dir, "documents")
        .select("doc_id", F.posexplode(F.regexp_extract_all(F.concat("text", "text"), F.lit(r"\(\d{3}\) \d{3}-\d{4}"), F.lit(0))).alias("pos", "raw"))
        .select("doc_id", F.col("pos").cast("bigint").alias("pos"), C.normalize_phone_us("raw", "null").alias("phone"), F.expr(f"CAST({_CONF} AS BIGINT)").alias("confidence")),
        "doc_id")
)
