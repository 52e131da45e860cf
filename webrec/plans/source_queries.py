"""Queries for readers, writers and batch payloads. Files to read are first
written by Spark from the given tables into the shared folder."""

from pyspark.sql import functions as F

from webrec.operators.extraction import scan_pages
from webrec.functions.html import html_to_text
from webrec.plans import sqltext as S
from webrec.plans.inputs import table, view, with_views
from webrec.plans.registry import query
from webrec.session import scratch
from webrec.sources import batch_payloads as B
from webrec.sources import readers as R
from webrec.sources import sinks as K

CO = with_views("companies")
A = with_views("articles")
CR = with_views("crawl")


def _co(spark, sf_dir):
    return view(spark, sf_dir, "companies")


def _raw_records(spark, sf_dir):
    """Three shapes of the same list: JSON array, comma text, Python list."""
    mats = F.expr("""CASE id % 3 WHEN 0 THEN to_json(materials) WHEN 1 THEN array_join(materials, ', ') ELSE "['" || array_join(materials, "', '") || "']" END""")
    return _co(spark, sf_dir).select(
        F.concat_ws(":", F.col("id").cast("string"), "name").alias("name"), "website", F.col("address").alias("street_address"), "city", F.col("state").alias("region"),
        F.coalesce("phone", F.lit("")).alias("phones"), F.coalesce("email", F.lit("")).alias("emails"), mats.alias("materials"),
        F.concat(F.lit("line one\nline \"two\" "), F.col("id").cast("string")).alias("description"))


_REC = """SELECT CAST(id AS VARCHAR) || coalesce(':' || name, '') AS name, nullif(website, '') AS website, address AS street_address, phone AS phones,
 array_to_string(materials, '|') AS materials, 'line one' || chr(10) || 'line "two" ' || id AS description FROM companies"""


def _shape(df):
    return df.select("name", "website", "street_address", F.array_join("phones", "|").alias("phones"), F.array_join("materials", "|").alias("materials"), "description")


@query("scan_company_records", f"{CO} {_REC}")
def scan_company_records(spark, sf_dir):
    path = scratch(spark, "records-json")
    _raw_records(spark, sf_dir).write.json(path)
    return _shape(R.scan_company_records(spark, json=path, multi_line=False))


@query("scan_company_records_csv", f"{CO} {_REC}")
def scan_company_records_csv(spark, sf_dir):
    path = scratch(spark, "records-csv")
    _raw_records(spark, sf_dir).write.option("header", True).option("escape", '"').csv(path)
    return _shape(R.scan_company_records(spark, csv=path))


def _runs(spark, sf_dir):
    """Run documents of at most 100 URLs each."""
    path = scratch(spark, "runs")
    docs = view(spark, sf_dir, "crawl").groupBy(F.floor(F.col("event_id") / 100).alias("doc")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("event_id", "url"))), lambda x: x["url"]).alias("urls"),
        F.max(F.col("ts").cast("string")).alias("collected_at"), F.count("*").cast("int").alias("total_urls"))
    docs.select(F.lit(1).alias("stage"), F.lit("en").alias("language"), "total_urls", "collected_at", "urls").write.json(path)
    return R.scan_run_documents(spark, path, multi_line=False)


_DOCS = "r AS (SELECT *, event_id // 100 AS doc, event_id % 100 AS pos FROM crawl), h AS (SELECT doc, max(ts) AS t FROM r GROUP BY doc)"
query("scan_run_documents", f"{CR}, {_DOCS} SELECT strftime(t, '%Y-%m-%d %H:%M:%S') AS collected_at, CAST(pos AS BIGINT) AS pos, url FROM r JOIN h ON r.doc = h.doc")(
    lambda spark, sf_dir: _runs(spark, sf_dir)[1].select(F.substring("collected_at", 1, 19).alias("collected_at"), F.col("pos").cast("bigint").alias("pos"), "url")
)
query("latest_run", f"{CR}, {_DOCS} SELECT CAST(pos AS BIGINT) AS pos, url FROM r WHERE doc = (SELECT arg_max(doc, t) FROM h)")(
    lambda spark, sf_dir: R.latest_run(*_runs(spark, sf_dir)).select(F.col("pos").cast("bigint").alias("pos"), "url")
)

# -- raw answers built from the tables ------------------------------------------
_NEWS = """'{"status":"' || CASE WHEN doc_id % 11 = 0 THEN 'error' ELSE 'ok' END || '","articles":[{"title":"T' || CAST(doc_id AS STRING) || '","content":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '"Body"' END
 || ',"description":"Desc","url":"https://n.org/' || CAST(doc_id AS STRING) || '","publishedAt":"2024-02-03T04:05:06Z","source":{"name":"' || source || '"}},{"title":"no url","url":""}]}'"""
query(
    "scan_news_api",
    "SELECT 'T' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'Desc' ELSE 'Body' END AS content, 'https://n.org/' || doc_id AS url, source, TIMESTAMP '2024-02-03 04:05:06' AS published_at FROM documents WHERE doc_id % 11 <> 0",
)(
    lambda spark, sf_dir: R.scan_news_api(table(spark, sf_dir, "documents").select(F.expr(_NEWS).alias("value"))).select("title", "content", "url", "source", "published_at")
)
_RSS = """'<rss><channel><item><title><![CDATA[A & B ' || lang || ']]></title><link>https://f.org/' || CAST(doc_id AS STRING) || '/1</link><description>&lt;b&gt;Bold&lt;/b&gt; text</description></item>
<item><title>Two</title><link>https://f.org/' || CAST(doc_id AS STRING) || '/2</link></item><item><title>Three</title><link>https://f.org/3</link></item></channel></rss>'"""
query(
    "scan_rss_items",
    "SELECT doc_id, CAST(0 AS BIGINT) AS pos, 'https://f.org/' || doc_id || '/1' AS url, 'A & B ' || lang AS title, 'Bold text' AS summary FROM documents UNION ALL SELECT doc_id, 1, 'https://f.org/' || doc_id || '/2', 'Two', '' FROM documents",
)(
    lambda spark, sf_dir: R.rss_items(table(spark, sf_dir, "documents").select("doc_id", F.expr(_RSS).alias("value")), 2, feed="doc_id")
    .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "url", "title", "summary")
)
_OSM = """'{"elements":[{"id":' || CAST(id AS STRING) || ',"type":"node","lat":29.5,"lon":-95.25,"tags":{"name":"Yard ' || CAST(id AS STRING) || '","addr:housenumber":"12","addr:street":"Main St","contact:phone":"713-868-4111","shop":"scrap_yard"}},
{"id":' || CAST(id AS STRING) || ',"type":"way","center":{"lat":1.5,"lon":2.5},"tags":{"name":"","operator":"Op ' || CAST(id AS STRING) || '","addr:full":"Full address"}},
{"id":' || CAST(id AS STRING) || ',"type":"way","geometry":[{"lat":1.0,"lon":2.0},{"lat":2.0,"lon":4.0}],"tags":{"brand":"Brand","addr:city":"Erie"}},{"id":0,"type":"node","lat":1.0,"lon":1.0,"tags":{"name":"ab"}}]}'"""
query(
    "scan_osm_elements",
    f"""{CO} SELECT id AS osm_id, 'node' AS osm_type, 'Yard ' || id AS name, '12 Main St' AS address, NULL AS city, '(713) 868-4111' AS phone, CAST(29.5 AS DOUBLE) AS latitude, CAST(-95.25 AS DOUBLE) AS longitude FROM companies
        UNION ALL SELECT id, 'way', 'Op ' || id, 'Full address', NULL, NULL, 1.5, 2.5 FROM companies UNION ALL SELECT id, 'way', 'Brand', NULL, 'Erie', NULL, 1.5, 3.0 FROM companies""".replace("NULL AS city", "CAST(NULL AS VARCHAR) AS city"),
)(
    lambda spark, sf_dir: R.scan_osm_elements(_co(spark, sf_dir).select(F.expr(_OSM).alias("value"))).select("osm_id", "osm_type", "name", "address", "city", "phone", "latitude", "longitude")
)
_EPA = """'{"FacilityName":"' || CASE WHEN id % 3 = 0 THEN 'Big Metal Works' ELSE 'Dairy' END || '","CityName":"' || coalesce(city, '') || '","StateAbbr":"' || coalesce(state, '') || '","FacilityId":"' || lpad(CAST(id AS STRING), 12, '0') || '","Latitude":1.25}'"""
query(
    "scan_epa_facilities",
    f"{CO} SELECT 'Big Metal Works' AS name, coalesce(city, '') AS city, lpad(CAST(id AS VARCHAR), 12, '0') AS facility_id, CAST(1.25 AS DOUBLE) AS latitude FROM companies WHERE id % 3 = 0",
)(lambda spark, sf_dir: R.scan_epa_facilities(_co(spark, sf_dir).select(F.expr(_EPA).alias("value"))).select("name", "city", "facility_id", "latitude"))


@query(
    "scan_search_links",
    with_views("urls") + "SELECT page_id AS n, title, url, CAST(page_no AS BIGINT) AS page FROM urls WHERE url IS NOT NULL",
)
def scan_search_links(spark, sf_dir):
    base = scratch(spark, "links")
    links = view(spark, sf_dir, "urls").where("url is not null").select("title", "url", F.col("page_id").cast("string").alias("query"), F.col("page_no").alias("page"))
    # one folder of dumps whose names carry the engine, one of others
    links.write.json(f"{base}/google_links.json")
    links.write.json(f"{base}/other_links")
    found = R.scan_search_links(spark, f"{base}/google*", name="*.json", multi_line=False)
    return found.select(F.col("query").cast("bigint").alias("n"), "title", "url", F.col("page").cast("bigint").alias("page"))


# -- writers ------------------------------------------------------------------
@query("sink_records", f"{CO} SELECT id, name, array_to_string(materials, ', ') AS materials, 'csv' AS kind FROM companies UNION ALL SELECT id, name, array_to_string(materials, ', '), 'parquet' FROM companies")
def sink_records(spark, sf_dir):
    paths = K.sink_records(_co(spark, sf_dir).select("id", "name", "materials"), scratch(spark, "out"), "r1", ("parquet", "csv"))
    csv = spark.read.schema("id bigint, name string, materials string").option("header", True).option("escape", '"').csv(paths["csv"])
    pq = spark.read.parquet(paths["parquet"]).select("id", "name", F.array_join("materials", ", ").alias("materials"))
    return csv.withColumn("kind", F.lit("csv")).unionByName(pq.withColumn("kind", F.lit("parquet")))


@query("sink_report_sheets", f"{CO} SELECT 'states' AS sheet, state AS label, CAST(count(*) AS BIGINT) AS n FROM companies GROUP BY state UNION ALL SELECT 'sources', source, CAST(count(*) AS BIGINT) FROM companies GROUP BY source")
def sink_report_sheets(spark, sf_dir):
    co = _co(spark, sf_dir)
    sheets = {
        "states": co.groupBy(F.col("state").alias("label")).agg(F.count("*").alias("n")),
        "sources": co.groupBy(F.col("source").alias("label")).agg(F.count("*").alias("n")),
    }
    paths = K.sink_report_sheets(sheets, scratch(spark, "sheets"))
    parts = [spark.read.parquet(p).withColumn("sheet", F.lit(n)) for n, p in paths.items()]
    return parts[0].unionByName(parts[1])


@query("sink_category_partition", f"{A} SELECT DISTINCT id, trim(unnest(coalesce(string_split(categories_list, ','), ['uncategorized']))) AS category FROM articles")
def sink_category_partition(spark, sf_dir):
    path = K.sink_category_partition(view(spark, sf_dir, "articles").select("id", "categories_list", "title"), scratch(spark, "categories"))
    return spark.read.parquet(path).select("id", F.col("category").cast("string").alias("category"))


# -- batch payloads -------------------------------------------------------------
_DROP = "script|style|nav|header|footer|aside"
query(
    "llm_request_ndjson",
    f"""SELECT 'full::' || url || CASE WHEN k > 0 THEN '#' || k ELSE '' END AS custom_id, 'POST' AS method, 'gpt-4o-mini' AS model,
        'Website: ' || url || chr(10) || 'TEXT:' || chr(10) || t[k * 800 + 1:k * 800 + 800] AS tail
        FROM (SELECT url, t, unnest(range(greatest(1, CAST(ceil(length(t) / 800) AS BIGINT)))) AS k FROM (SELECT url, {S.plain(S.without('html', _DROP))} AS t FROM pages))""",
)(
    lambda spark, sf_dir: B.llm_request_ndjson(scan_pages(table(spark, sf_dir, "pages")).select("url", html_to_text("html").alias("text")), chars=800).select(
        "custom_id", F.get_json_object("value", "$.method").alias("method"), F.get_json_object("value", "$.body.model").alias("model"),
        F.regexp_replace(F.get_json_object("value", "$.body.messages[1].content"), r"^Keys: [^\n]*\n", "").alias("tail"))
)
_RESP = """CASE conv_id % 4 WHEN 0 THEN 'not json' WHEN 1 THEN '{"custom_id":"enrich::https://c' || CAST(conv_id AS STRING) || '.org","response":{"body":{"choices":[{"message":{"content":"{\\\\"turn\\\\":' || CAST(turn AS STRING) || '}"}}]}}}'
 WHEN 2 THEN '{"custom_id":"full::https://c' || CAST(conv_id AS STRING) || '.org","response":{"body":{"choices":[{"message":{"content":"{broken"}}]}}}' ELSE '{"custom_id":"full::x' || CAST(conv_id AS STRING) || '"}' END"""
query(
    "llm_response_parse",
    """SELECT conv_id, turn, CASE conv_id % 4 WHEN 1 THEN 'enrich' ELSE 'full' END AS kind, CASE conv_id % 4 WHEN 3 THEN 'x' || conv_id ELSE 'https://c' || conv_id || '.org' END AS key,
       CASE conv_id % 4 WHEN 1 THEN '{"turn":' || turn || '}' ELSE '{}' END AS payload FROM conversations WHERE conv_id % 4 <> 0""",
)(
    lambda spark, sf_dir: B.llm_response_parse(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_RESP).alias("value")), carry=("conv_id", "turn"))
    .select("conv_id", "turn", "kind", "key", "payload")
)
_TRUNC = "'{\"companies\": [' || chr(10) || '    {\"name\":\"A' || CAST(conv_id AS STRING) || '\"' || chr(10) || '    },' || chr(10) || '    {\"name\":\"B\"' || chr(10) || '    }' || CASE turn % 3 WHEN 0 THEN chr(10) || '  ]' || chr(10) || '}' WHEN 1 THEN ',' || chr(10) || '    {\"name\":\"C' ELSE '' END"
query(
    "truncated_json_repair",
    "SELECT conv_id, turn, CAST(2 AS BIGINT) AS n, 'A' || conv_id || '|B' AS names FROM conversations WHERE turn % 3 < 2 UNION ALL SELECT conv_id, turn, NULL, NULL FROM conversations WHERE turn % 3 = 2",
)(
    lambda spark, sf_dir: table(spark, sf_dir, "conversations").select("conv_id", "turn", B.companies_of(F.expr(_TRUNC)).alias("c"))
    .select("conv_id", "turn", F.when(F.col("c").isNotNull(), F.size("c")).cast("bigint").alias("n"), F.array_join(F.transform("c", lambda x: x["name"]), "|").alias("names"))
)
