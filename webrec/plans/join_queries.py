"""Queries for joins, expansions and set operations."""

from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions.urls import score_topic_url, url_netloc
from webrec.operators import joins as J
from webrec.plans import sqltext as S
from webrec.plans.inputs import table, view, with_views
from webrec.plans.registry import query

CO = with_views("companies")
A = with_views("articles")
CR = with_views("crawl")
U = with_views("urls")


def _co(spark, sf_dir):
    return view(spark, sf_dir, "companies")


# -- enrichment payloads: one answer for two of three companies -----------------
_PAY = """CASE id % 3 WHEN 0 THEN '{"materials":[" Copper","brass","copper",""],"prices":[{"material":"Copper","price_value":' || CAST(id % 7 + 1 AS STRING) || ',"currency":"USD","unit":"lb"},{"material":"","price_value":1},{"material":"Iron","note":"call us"}]}'
 WHEN 1 THEN '{"materials":"none","prices":[{"material":"Zinc"}]}' ELSE '{bad json' END"""


def _payloads(spark, sf_dir):
    return _co(spark, sf_dir).where("website is not null").select(F.concat(F.lit("enrich::"), "website").alias("custom_id"), F.expr(_PAY).alias("payload"), F.col("id").alias("pos"))


query(
    "merge_enrichment",
    f"""{CO}, l AS (SELECT website, max(id) AS last FROM companies WHERE website IS NOT NULL GROUP BY website)
        SELECT id, CASE WHEN last % 3 = 0 THEN 'brass, copper' ELSE array_to_string(materials, ', ') END AS materials,
        CASE WHEN last % 3 = 0 THEN 'Copper, ' || (last % 7 + 1) || ' USD/lb | Iron, call us' ELSE pricing END AS material_prices FROM companies c LEFT JOIN l ON c.website = l.website""",
)(
    lambda spark, sf_dir: J.merge_enrichment(
        _co(spark, sf_dir).select("id", "website", F.array_join("materials", ", ").alias("materials"), F.col("pricing").alias("material_prices")), _payloads(spark, sf_dir)
    ).select("id", "materials", "material_prices")
)


def _twice(answers, field, older):
    """Each key with an earlier answer too, which must not count or add a row."""
    return answers.withColumn("at", F.lit(2)).unionByName(answers.withColumns({"at": F.lit(1), field: F.lit(older)}))


_VAL = """CASE id % 5 WHEN 0 THEN '{"valid":true,"confidence":0.9,"name":"Checked ' || CAST(id AS STRING) || '","state":"OH"}' WHEN 1 THEN '{"valid":true,"confidence":0.5}' WHEN 2 THEN '{"valid":false}' ELSE 'oops' END"""
query(
    "merge_validation_result",
    f"""{CO} SELECT id, CASE WHEN source <> 'search' AND id % 5 = 0 THEN 'Checked ' || id ELSE name END AS name, city, CASE WHEN source <> 'search' AND id % 5 = 0 THEN 'OH' ELSE state END AS region
        FROM companies WHERE source = 'search' OR id % 5 NOT IN (1, 2)""",
)(
    lambda spark, sf_dir: J.merge_validation_result(
        _co(spark, sf_dir).select("id", "name", "city", F.col("state").alias("region")),
        _twice(_co(spark, sf_dir).where("source <> 'search'").select("id", F.expr(_VAL).alias("payload")), "payload", '{"valid":true,"confidence":1.0,"name":"older"}'),
        order="at").select("id", "name", "city", "region")
)


# -- fusion: three sources per company ------------------------------------------
def _sources(spark, sf_dir):
    return _co(spark, sf_dir).select("id", F.inline(F.expr(
        "array(named_struct('prio', 1, 'source', 'map', 'phone', CASE WHEN id % 2 = 0 THEN '' ELSE NULL END, 'email', 'm' || id || '@map.org'),"
        " named_struct('prio', 2, 'source', 'web', 'phone', CASE WHEN id % 3 = 0 THEN NULL ELSE 'web' || id END, 'email', NULL),"
        " named_struct('prio', 3, 'source', 'dir', 'phone', CASE WHEN id % 9 = 0 THEN NULL ELSE 'dir' || id END, 'email', 'd' || id || '@dir.org'))")))


_BP = "CASE WHEN id % 3 <> 0 THEN 'web' || id WHEN id % 9 <> 0 THEN 'dir' || id END"
query(
    "fuse_fill_missing",
    f"""{CO} SELECT id, coalesce(nullif(phone, ''), {_BP}) AS phone, coalesce(nullif(email, ''), 'm' || id || '@map.org') AS email,
        CASE WHEN coalesce(phone, '') <> '' THEN 'record' WHEN id % 3 <> 0 THEN 'web' WHEN id % 9 <> 0 THEN 'dir' END AS phone_source FROM companies""",
)(
    lambda spark, sf_dir: J.fuse_fill_missing(_co(spark, sf_dir).select("id", "phone", "email"), _sources(spark, sf_dir), ["phone", "email"]).select("id", "phone", "email", "phone_source")
)
query(
    "fuse_override",
    f"{CO} SELECT id, CASE WHEN source = 'map' THEN 'site' || id ELSE phone END AS phone, city FROM companies",
)(
    lambda spark, sf_dir: J.fuse_override(
        _co(spark, sf_dir).select("id", "phone", "city"),
        _co(spark, sf_dir).where("source in ('map', 'directory')").select("id", F.expr("CASE WHEN source = 'map' THEN 'site' || id ELSE '' END").alias("phone")).transform(_twice, "phone", "older"), ["phone"], order="at").select("id", "phone", "city")
)


# -- known URLs -----------------------------------------------------------------
def _crawl(spark, sf_dir):
    return view(spark, sf_dir, "crawl")


_NEW = "run_id = 'run-2'"
query("anti_join_known_urls", f"{CR} SELECT DISTINCT url FROM crawl WHERE {_NEW} AND url NOT IN (SELECT url FROM crawl WHERE run_id = 'run-0')")(
    lambda spark, sf_dir: J.anti_join_known_urls(
        _crawl(spark, sf_dir).where(_NEW).select("url").distinct(), _crawl(spark, sf_dir).where("run_id = 'run-0'"))
)
query("remaining_urls", f"{CR} SELECT event_id, url FROM crawl WHERE source <> 'purchase' AND url NOT IN (SELECT url FROM crawl WHERE source = 'purchase')")(
    lambda spark, sf_dir: J.remaining_urls(
        _crawl(spark, sf_dir).where("source <> 'purchase'").select("event_id", "url"), _crawl(spark, sf_dir).where("source = 'purchase'"))
)
query("except_urls", f"{CR} SELECT DISTINCT url FROM crawl WHERE source = 'view' AND url NOT IN (SELECT url FROM crawl WHERE source = 'click')")(
    lambda spark, sf_dir: J.except_urls(_crawl(spark, sf_dir).where("source = 'view'").select("url").distinct(), _crawl(spark, sf_dir).where("source = 'click'"))
)
query("union_sources", f"{CR} SELECT event_id, url, source AS collected_by FROM crawl WHERE source IN ('view', 'click', 'error')")(
    lambda spark, sf_dir: J.union_sources(**{s: _crawl(spark, sf_dir).where(F.col("source") == s).select("event_id", "url") for s in ("view", "click", "error")})
)
query("union_distinct_urls", f"{CR} SELECT DISTINCT url FROM crawl WHERE run_id IN ('run-0', 'run-1')")(
    lambda spark, sf_dir: J.union_distinct_urls(_crawl(spark, sf_dir).where("run_id = 'run-0'"), _crawl(spark, sf_dir).where("run_id = 'run-1'"))
)


# -- domain lists: short registries of the given hosts --------------------------
def _domains(spark, sf_dir, cond):
    """Registrable part of hosts of the given pages, as a domain table."""
    host = url_netloc("url")
    return table(spark, sf_dir, "pages").where(cond).select(F.regexp_extract(host, r"([^.]+\.example\.[a-z]+)$", 1).alias("domain")).distinct()


_HOSTS = "regexp_extract(regexp_extract(url, '://([^/?#]*)', 1), '([^.]+[.]example[.][a-z]+)$', 1)"
_LISTED = f"{_HOSTS} IN (SELECT {_HOSTS} FROM pages WHERE contains(url, '.example.org'))"
query("semi_join_domain_suffix", f"SELECT page_id, url FROM pages WHERE {_LISTED}")(
    lambda spark, sf_dir: J.semi_join_domain_suffix(table(spark, sf_dir, "pages").select("page_id", "url"), _domains(spark, sf_dir, F.col("url").contains(".example.org")))
)
query("anti_join_domain_suffix", f"SELECT page_id, url FROM pages WHERE NOT ({_LISTED})")(
    lambda spark, sf_dir: J.anti_join_domain_suffix(table(spark, sf_dir, "pages").select("page_id", "url"), _domains(spark, sf_dir, F.col("url").contains(".example.org")))
)
_UN = S.netloc("coalesce(url, chr(32))")
query("filter_parser_supported", f"{U} SELECT page_id, url FROM urls WHERE {S.sub_of(_UN, [*L.PARSER_SUPPORTED_DOMAINS, 'mining.com'])} AND NOT {S.sub_of(_UN, L.PARSER_BLOCKED_DOMAINS)}")(
    lambda spark, sf_dir: J.filter_parser_supported(
        view(spark, sf_dir, "urls").select("page_id", "url"),
        spark.createDataFrame([(d,) for d in [*L.PARSER_SUPPORTED_DOMAINS, "mining.com"]], "domain string"),
        spark.createDataFrame([(d,) for d in L.PARSER_BLOCKED_DOMAINS], "domain string"))
)
REGISTRY = [
    {"key": "mining", "base_url": "https://mining.com/", "category": "markets"},
    {"key": "guru", "base_url": "https://steelguru.com/news", "category": "business"},
    {"key": "ria", "base_url": "https://ria.ru", "category": "economy"},
    {"key": "late", "base_url": "https://mining.com/other", "category": "tech"},
]
query(
    "join_source_registry",
    f"{U} SELECT page_id, CASE WHEN page_id % 26 = 21 THEN 'mining' WHEN page_id % 26 = 8 THEN 'guru' WHEN page_id % 26 = 18 THEN 'ria' ELSE 'default' END AS source_key, "
    "CASE WHEN page_id % 26 = 21 THEN 'markets' WHEN page_id % 26 = 8 THEN 'business' WHEN page_id % 26 = 18 THEN 'economy' END AS source_category FROM urls",
)(lambda spark, sf_dir: J.join_source_registry(view(spark, sf_dir, "urls").select("page_id", "url"), REGISTRY).select("page_id", "source_key", "source_category"))
_WEIGHT = " + ".join(f"CASE WHEN contains(lower(coalesce(url, '')), {S.lit(k)}) THEN {v} ELSE 0 END" for k, v in L.TOPIC_WEIGHTS.items())
query(
    "category_lookup_mode",
    f"{U} SELECT page_id, CAST({_WEIGHT} AS BIGINT) AS score, CAST(CASE source_type WHEN 'metallurgy_focused' THEN 10 WHEN 'newsapi' THEN 15 WHEN 'general' THEN 20 WHEN 'rss' THEN 12 ELSE 15 END AS BIGINT) AS threshold FROM urls",
)(
    lambda spark, sf_dir: J.category_lookup_mode(view(spark, sf_dir, "urls"), score_topic_url("url", simple=True))
    .select("page_id", F.col("score").cast("bigint").alias("score"), F.col("threshold").cast("bigint").alias("threshold"))
)

# -- expansions: one location per company -----------------------------------------
_LOC = "SELECT id, CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Houston' WHEN 2 THEN 'San Diego' WHEN 3 THEN 'Erie' WHEN 4 THEN '' ELSE 'Boise' END AS city, CASE id % 6 WHEN 0 THEN '' WHEN 1 THEN 'Texas' WHEN 2 THEN 'California' WHEN 3 THEN 'Pennsylvania' WHEN 4 THEN 'New York' ELSE 'Idaho' END AS state, 'USA' AS country FROM {companies}"
LOC = CO.rstrip() + ", loc AS (" + _LOC.replace("{companies}", "companies") + ") "


def _locations(spark, sf_dir):
    return spark.sql(_LOC, companies=_co(spark, sf_dir))


_PL = "concat_ws(' ', nullif(city, ''), nullif(state, ''), country)"
_PC = "concat_ws(', ', nullif(city, ''), nullif(state, ''), country)"
_QL = "[" + ", ".join([f"'{t} ' || {_PL}" for t in [*L.SEARCH_TERMS, *L.SEARCH_TERM_PREFIXES]] + [f"'{t} ' || {_PC}" for t in L.DIRECTORY_QUERY_PREFIXES]) + "]"
query("expand_search_terms", f"{LOC} SELECT id, CAST(pos AS BIGINT) AS pos, q AS query FROM (SELECT id, unnest(range({9 + len(L.DIRECTORY_QUERY_PREFIXES)})) AS pos, unnest({_QL}) AS q FROM loc)")(
    lambda spark, sf_dir: J.expand_search_terms(_locations(spark, sf_dir)).select("id", F.col("pos").cast("bigint").alias("pos"), "query")
)
query("expand_tasks", f"{LOC} SELECT id, s AS source, t AS term, 'main' AS phase FROM loc, (SELECT unnest(['yelp', 'maps']) AS s), (SELECT unnest(['scrap yard', 'metal']) AS t)")(
    lambda spark, sf_dir: J.expand_tasks(_locations(spark, sf_dir), ["yelp", "maps"], ["scrap yard", "metal"]).select("id", "source", "term", "phase")
)
query(
    "expand_search_pages",
    f"""{LOC} SELECT id, p AS page, 'https://www.google.com/search?q=' || replace(q, ' ', '+') || '&start=' || ((p - 1) * 10) AS url, CASE WHEN p >= 3 THEN 'deep' ELSE 'surface' END AS expected_depth
        FROM (SELECT id, 'scrap ' || city AS q FROM loc UNION ALL SELECT id, city || ' metal' FROM loc), (SELECT unnest(range(1, 6)) AS p)""",
)(
    lambda spark, sf_dir: J.expand_search_pages(_locations(spark, sf_dir), ["scrap {city}", "{city} metal"]).select("id", F.col("page").cast("bigint").alias("page"), "url", "expected_depth")
)


def _tasks(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("task_id"), F.lit("maps").alias("source"), F.concat(F.lit("term "), (F.col("s_suppkey") % 5).cast("string")).alias("term"),
        F.col("s_name").alias("location"), F.timestamp_add("MINUTE", (F.col("s_suppkey") % 1000).cast("int"), F.lit("2024-01-01").cast("timestamp")).alias("started_at"))


query(
    "tag_search_metadata",
    f"""{CO} SELECT id, id % 100 AS task_id, CASE WHEN s_suppkey IS NOT NULL THEN 'maps' END AS source, 'term ' || (s_suppkey % 5) AS term, s_name AS location,
        TIMESTAMP '2024-01-01' + CAST(s_suppkey % 1000 AS INT) * INTERVAL 1 MINUTE AS started_at FROM companies LEFT JOIN supplier ON s_suppkey = id % 100""",
)(
    lambda spark, sf_dir: J.tag_search_metadata(_co(spark, sf_dir).select("id", (F.col("id") % 100).alias("task_id")),
        _tasks(spark, sf_dir).unionByName(_tasks(spark, sf_dir).withColumns({"source": F.lit("older"), "started_at": F.lit("2000-01-01").cast("timestamp")})))
)
_ENC = lambda x: f"replace(replace({x}, ',', '%2C'), ' ', '%20')"
_LOCX = _ENC("CASE WHEN city <> '' AND state <> '' THEN city || ', ' || state ELSE state END")


def _fill(t):
    out = S.lit(t)
    for k, v in (("{loc}", _LOCX), ("{city}", _ENC("city")), ("{state_lower}", f"lower({_ENC('state')})"), ("{state}", _ENC("state"))):
        out = f"replace({out}, '{k}', {v})"
    return out


query(
    "expand_directory_urls",
    f"{LOC} SELECT id, CAST(pos AS BIGINT) AS pos, url FROM (SELECT id, unnest(range({len(L.DIRECTORY_URL_TEMPLATES)})) AS pos, unnest([{', '.join(_fill(t) for t in L.DIRECTORY_URL_TEMPLATES)}]) AS url FROM loc) WHERE NOT ends_with(url, '//') AND NOT contains(url, '++')",
)(lambda spark, sf_dir: J.expand_directory_urls(_locations(spark, sf_dir)).select("id", F.col("pos").cast("bigint").alias("pos"), "url"))
_DIMS = (
    "cities AS (SELECT * FROM (VALUES " + ", ".join(f"({S.lit(s)}, {S.lit(c)}, {i})" for s, cs in L.MAJOR_CITIES.items() for i, c in enumerate(cs)) + ") v(s, c, i)), "
    "nb AS (SELECT * FROM (VALUES " + ", ".join(f"({S.lit(s)}, {S.lit(c)}, {i})" for s, cs in L.STATE_NEIGHBOURS.items() for i, c in enumerate(cs)) + ") v(s, c, i)) "
)
query(
    "expand_nearby_locations",
    f"""{LOC.rstrip()}, {_DIMS} SELECT id, near_city, near_state, CAST(priority AS BIGINT) AS priority FROM (
        SELECT id, city AS near_city, state AS near_state, 1 AS priority FROM loc WHERE city <> '' AND state <> ''
        UNION ALL SELECT id, c, state, 2 FROM loc JOIN cities ON s = state AND i < 5 AND lower(c) <> lower(city) WHERE city <> ''
        UNION ALL SELECT id, '', state, 3 FROM loc WHERE city <> '' AND state <> ''
        UNION ALL SELECT id, '', c, 4 FROM loc JOIN nb ON s = state AND i < 2 WHERE city <> ''
        UNION ALL SELECT id, '', state, 1 FROM loc WHERE city = '')""",
)(
    lambda spark, sf_dir: J.expand_nearby_locations(_locations(spark, sf_dir)).select("id", "near_city", "near_state", F.col("priority").cast("bigint").alias("priority"))
)

# -- materials: supplier - part bridge --------------------------------------------
query(
    "join_materials_bridge",
    """WITH b AS (SELECT l_suppkey AS c, p_type AS m, l_extendedprice / l_quantity AS price FROM lineitem JOIN part ON p_partkey = l_partkey),
        m AS (SELECT c, m, avg(price) AS price, count(*) AS n FROM b GROUP BY c, m),
        r AS (SELECT c, string_agg(m, '|' ORDER BY m) AS materials, max(price) AS best, sum(n) AS offers FROM m GROUP BY c)
       SELECT s_suppkey AS center_id, materials, round(best, 4) AS best_price, CAST(offers AS BIGINT) AS offers FROM supplier LEFT JOIN r ON s_suppkey = c""",
)(
    lambda spark, sf_dir: J.join_materials_bridge(
        table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("center_id")),
        table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("center_id"), F.col("l_partkey").alias("material_id"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price")),
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("material_id"), F.col("p_type").alias("material")),
    ).select("center_id", F.array_join("materials", "|").alias("materials"), F.round("best_price", 4).alias("best_price"), "offers")
)
query(
    "upsert_material_dim",
    "SELECT name, CAST(count(*) AS BIGINT) AS copies, bool_and(known) AS was_known FROM (SELECT DISTINCT p_type AS name, true AS known FROM part UNION ALL "
    "SELECT DISTINCT p_name, false FROM part WHERE p_name NOT IN (SELECT p_type FROM part)) GROUP BY name",
)(
    lambda spark, sf_dir: J.upsert_material_dim(
        table(spark, sf_dir, "part").select(F.col("p_type").alias("name")).distinct().withColumn("id", F.length("name").cast("bigint")),
        table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).union(table(spark, sf_dir, "part").select("p_type")),
    ).groupBy("name").agg(F.count("*").alias("copies"), F.bool_and(F.col("id") == F.length("name")).alias("was_known"))
)
query(
    "join_processing_log",
    f"""{A} SELECT event_id AS log_id, user_id AS article_id, event_type AS stage, title, url FROM (SELECT * FROM events WHERE user_id IN (SELECT id FROM articles) ) e
        JOIN articles a ON a.id = e.user_id""",
)(
    lambda spark, sf_dir: J.join_processing_log(
        view(spark, sf_dir, "articles"),
        table(spark, sf_dir, "events").select(F.col("event_id").alias("log_id"), F.col("user_id").alias("article_id"), F.col("event_type").alias("stage"), F.col("ts").alias("created_at")),
    ).select("log_id", "article_id", "stage", "title", "url")
)
