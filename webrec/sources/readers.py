"""Readers: saved records, run documents, API answers, feeds, map data, link
dumps. Schemas are given, never inferred, so a read is one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webrec.functions.common import blank_to_null, filled, first_match, first_of, squeeze, text
from webrec.functions.contacts import build_osm_address, first_tag, normalize_phone_us
from webrec.functions.html import unescape
from webrec.operators.dedup import top_per_key

TEXT_FIELDS = ["name", "website", "street_address", "city", "region", "postal_code", "country", "opening_hours", "description"]
LIST_FIELDS = ["phones", "emails", "whatsapp", "social_links", "materials", "material_prices"]
# read as text: a JSON array then arrives as its own text
RECORD_SCHEMA = ", ".join(f"{c} string" for c in [*TEXT_FIELDS, *LIST_FIELDS])


def as_list(c: Column) -> Column:
    """JSON array, Python-style list or comma text -> array; null if empty."""
    t = F.trim(c)
    parsed = F.from_json(t, "array<string>", {"allowSingleQuotes": "true"})
    items = F.when(t.startswith("["), parsed).otherwise(F.split(t, ", "))
    return F.when(filled(t), F.filter(items, lambda x: x.isNotNull() & (x != "")))


def _one_schema(raw: DataFrame) -> DataFrame:
    return raw.select(*[blank_to_null(c).alias(c) for c in TEXT_FIELDS], *[as_list(F.col(c)).alias(c) for c in LIST_FIELDS])


def scan_company_records(spark: SparkSession, json: str | None = None, csv: str | None = None, multi_line: bool = True) -> DataFrame:
    """Exports of any age as one schema. JSON arrays need ``multi_line``; files
    with one record per line do not, and split across tasks."""
    parts = []
    if json:
        parts.append(_one_schema(spark.read.schema(RECORD_SCHEMA).option("multiLine", multi_line).json(json)))
    if csv:
        raw = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').csv(csv)
        have = {c: F.col(c) for c in raw.columns}
        parts.append(_one_schema(raw.select(*[have.get(c, F.lit(None)).cast("string").alias(c) for c in [*TEXT_FIELDS, *LIST_FIELDS]])))
    if not parts:
        raise ValueError("give a json or csv path")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


RUN_SCHEMA = (
    "stage int, language string, total_urls int, target_limit int, collection_time_seconds double, collected_at string, "
    "sources map<string,bigint>, urls array<string>"
)


def scan_run_documents(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(headers, urls): one header row per run document, one row per URL."""
    docs = spark.read.schema(RUN_SCHEMA).option("multiLine", multi_line).json(path).withColumn("run_file", F.col("_metadata.file_name"))
    urls = docs.select("run_file", "collected_at", F.posexplode("urls").alias("pos", "url"))
    return docs.drop("urls"), urls


def latest_run(headers: DataFrame, urls: DataFrame) -> DataFrame:
    """URLs of the newest run by its own time stamp."""
    newest = headers.agg(F.max("collected_at")).scalar()
    return urls.where(F.col("collected_at") == newest)


NEWS_SCHEMA = (
    "status string, articles array<struct<title:string, content:string, description:string, url:string, author:string, "
    "publishedAt:string, source:struct<name:string>>>"
)


def scan_news_api(raw: DataFrame, column: str = "value", language: str = "en") -> DataFrame:
    """API answers (one JSON text per row) -> articles with a URL."""
    doc = raw.select(F.from_json(column, NEWS_SCHEMA).alias("d")).where("d.status = 'ok'")
    a = doc.select(F.explode("d.articles").alias("a")).where(filled("a.url"))
    return a.select(
        "a.title", first_of(F.col("a.content"), F.col("a.description")).alias("content"), "a.url", F.col("a.source.name").alias("source"),
        F.lit(language).alias("language"), "a.author", F.try_to_timestamp("a.publishedAt").alias("published_at"), F.col("a.description").alias("summary"),
        F.lit(False).alias("is_processed"), F.lit(False).alias("is_published"))


def _xml_text(item: Column, tag: str) -> Column:
    inner = first_match(item, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>")
    bare = F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    return blank_to_null(F.trim(unescape(bare)))


def scan_rss_items(spark: SparkSession, path: str, per_feed: int | None = None) -> DataFrame:
    """Feed files -> (feed, pos, url, title, summary), the first N per feed in
    file order. A feed is one small document, read whole to keep the order."""
    feeds = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_name").alias("feed"), "value")
    return rss_items(feeds, per_feed=per_feed)


def rss_items(feeds: DataFrame, per_feed: int | None = None, xml: str = "value", feed: str = "feed") -> DataFrame:
    """Same over a table of feed documents."""
    items = feeds.select(feed, F.posexplode(F.regexp_extract_all(xml, F.lit(r"(?is)<item\b.*?</item\s*>"), F.lit(0))).alias("pos", "item"))
    rows = items.select(
        feed, "pos", _xml_text(F.col("item"), "link").alias("url"), _xml_text(F.col("item"), "title").alias("title"),
        squeeze(F.regexp_replace(text(_xml_text(F.col("item"), "description")), "<[^>]*>", " ")).alias("summary"))
    rows = rows.where(filled("url"))
    return top_per_key(rows, [feed], [F.asc("pos")], per_feed) if per_feed else rows


OSM_SCHEMA = (
    "elements array<struct<id:bigint, type:string, lat:double, lon:double, center:struct<lat:double, lon:double>, "
    "geometry:array<struct<lat:double, lon:double>>, tags:map<string,string>>>"
)


def scan_osm_elements(raw: DataFrame, column: str = "value") -> DataFrame:
    """Map answers -> businesses with a name of three characters or more."""
    e = raw.select(F.explode(F.from_json(column, OSM_SCHEMA)["elements"]).alias("e")).select("e.*")

    def mean(f):
        g = F.col("geometry")
        return F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda s, p: s + p[f]) / F.size(g))

    t = F.col("tags")
    tag = lambda *ks: first_tag(t, list(ks))
    rows = e.select(
        F.col("id").alias("osm_id"), F.col("type").alias("osm_type"), F.trim(tag("name", "operator", "brand", "official_name")).alias("name"),
        build_osm_address(t).alias("address"), tag("addr:city").alias("city"), tag("addr:state").alias("state"), tag("addr:postcode").alias("zip_code"),
        F.coalesce(tag("addr:country"), F.lit("US")).alias("country"), normalize_phone_us(tag("phone", "contact:phone"), "keep").alias("phone"),
        tag("website", "contact:website").alias("website"), tag("email", "contact:email").alias("email"),
        F.coalesce(F.col("lat"), F.col("center.lat"), mean("lat")).alias("latitude"), F.coalesce(F.col("lon"), F.col("center.lon"), mean("lon")).alias("longitude"),
        tag("shop", "amenity", "industrial").alias("shop_type"), tag("opening_hours").alias("opening_hours"), tag("description").alias("description"), "tags")
    return rows.where(F.length("name") >= 3)


EPA_SCHEMA = "FacilityName string, LocationAddress string, CityName string, StateAbbr string, ZipCode string, Latitude double, Longitude double, FacilityId string"


def scan_epa_facilities(raw: DataFrame, column: str = "value", word: str = "metal", limit: int | None = None) -> DataFrame:
    """Facility answers -> businesses whose name contains the word."""
    f = raw.select(F.from_json(column, EPA_SCHEMA).alias("f")).select("f.*").where(F.lower("FacilityName").contains(word))
    out = f.select(
        F.col("FacilityName").alias("name"), F.col("LocationAddress").alias("address"), F.col("CityName").alias("city"), F.col("StateAbbr").alias("state"),
        F.col("ZipCode").alias("zip_code"), F.col("Latitude").alias("latitude"), F.col("Longitude").alias("longitude"), F.col("FacilityId").alias("facility_id"))
    return out.orderBy("facility_id").limit(limit) if limit else out


LINK_SCHEMA = "title string, url string, description string, query string, page int"


def scan_search_links(spark: SparkSession, folder: str, name: str = "*google*.json", multi_line: bool = True) -> DataFrame:
    """Saved link dumps by file name, tagged with their file."""
    return (
        spark.read.schema(LINK_SCHEMA).option("multiLine", multi_line).option("pathGlobFilter", name).option("recursiveFileLookup", True).json(folder)
        .withColumn("source_file", F.col("_metadata.file_name"))
    )
