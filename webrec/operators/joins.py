"""Joins between records, payloads, registries and URL tables, and the
expansions that make task tables.

Lookup sides are made unique per key by an aggregate before they meet the
records, so a key holding a third of the records only ever meets one row and
the adaptive skew join may split it. Small parameter lists become literals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions.common import at_most, blank_to_null, col, filled, text
from webrec.functions.urls import threshold_for, url_netloc

ENRICHMENT = (
    "materials array<string>, prices array<struct<material:string, price_value:string, currency:string, unit:string, note:string>>"
)
VALIDATION = (
    "valid boolean, confidence double, name string, phones array<string>, emails array<string>, street_address string, "
    "city string, state string, postal_code string, materials array<string>, description string"
)


def spread_nulls(key: str, columns: Sequence[str]) -> Column:
    """Join key whose nulls are replaced by values that match nothing and
    differ per row, so rows without a key do not meet in one task."""
    return F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\u0000"), F.xxhash64(*columns).cast("string")))


# -- enrichment ---------------------------------------------------------------
def enriched_materials(materials: Column) -> Column:
    """Trimmed, lower, distinct, sorted, joined; null when there is no list."""
    m = F.filter(F.transform(materials, lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_distinct(m)), ", ")


def enriched_prices(prices: Column, limit: int | None = None) -> Column:
    """``material, value currency/unit, note`` joined; needs a material and a
    value or note; null when none is left."""
    def one(p):
        value = F.when(filled(p["price_value"]), F.trim(F.concat(text(p["price_value"]), F.lit(" "), text(p["currency"]), F.lit("/"), text(p["unit"]))))
        ok = filled(F.trim(p["material"])) & (value.isNotNull() | filled(F.trim(p["note"])))
        return F.when(ok, F.concat_ws(", ", F.trim(p["material"]), value, blank_to_null(F.trim(p["note"]))))

    kept = F.filter(F.transform(at_most(prices, limit), one), lambda x: x.isNotNull())
    return blank_to_null(F.array_join(kept, " | "))


def latest_per_key(df: DataFrame, key: str, value: str, order: str | None) -> DataFrame:
    """One value per key: that of the last row by ``order`` (without one, or in
    a tie, the largest value). Aggregates before the shuffle."""
    rank = F.struct(*([order] if order else []), value)
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, rank).alias(value))


def merge_enrichment(records: DataFrame, payloads: DataFrame, order: str = "pos") -> DataFrame:
    """Put enrichment payloads (custom_id, payload, order) onto records by
    exact website. ``materials`` and ``material_prices`` are text."""
    good = payloads.where(F.col("custom_id").startswith("enrich::")).withColumn("_site", F.expr("substring(custom_id, 9)"))
    one = latest_per_key(good, "_site", "payload", order).select("_site", F.from_json("payload", ENRICHMENT).alias("_p"))
    one = one.select("_site", enriched_materials(F.col("_p.materials")).alias("_m"), enriched_prices(F.col("_p.prices")).alias("_pr"))
    return (
        records.withColumn("_k", spread_nulls("website", records.columns))
        .join(one, F.col("_k") == F.col("_site"), "left")
        .withColumns({"materials": F.coalesce("_m", "materials"), "material_prices": F.coalesce("_pr", "material_prices")})
        .drop("_k", "_site", "_m", "_pr")
    )


def merge_validation_result(records: DataFrame, results: DataFrame, key: str = "id", least: float = 0.7, order: str | None = None) -> DataFrame:
    """Accepted rows take the validated fields, rejected rows go, rows without
    a readable answer stay as they are. Of several answers for one key the
    last by ``order`` counts."""
    one = latest_per_key(results, key, "payload", order)
    r = one.select(F.col(key).alias("_key"), F.from_json("payload", VALIDATION).alias("_v"))
    ok = F.coalesce(F.col("_v.valid") & (F.col("_v.confidence") > least), F.lit(False))
    answered = F.coalesce(F.col("_v.valid").isNotNull() | F.col("_v.confidence").isNotNull(), F.lit(False))
    fields = {"name": "name", "phones": "phones", "emails": "emails", "street_address": "street_address", "city": "city", "region": "state",
              "postal_code": "postal_code", "materials": "materials", "description": "description"}
    joined = records.join(r, records[key] == r["_key"], "left").where(ok | ~answered)
    new = {c: F.when(ok, F.coalesce(F.col(f"_v.{v}"), F.col(c))).otherwise(F.col(c)) for c, v in fields.items() if c in records.columns}
    return joined.withColumns(new).drop("_key", "_v")


# -- fusion -------------------------------------------------------------------
def fuse_fill_missing(records: DataFrame, sources: DataFrame, fields: Sequence[str], key: str = "id") -> DataFrame:
    """Fill only empty fields from source rows (key, prio, source, fields);
    the best-ranked filled value wins. ``<first field>_source`` tells where the
    first field came from."""
    def best(c, what):
        return F.min_by(what, F.when(filled(c), F.col("prio")))

    lead = fields[0]
    agg = sources.groupBy(key).agg(
        *[F.when(F.max(filled(c)), best(c, c)).alias(f"_{c}") for c in fields],
        F.when(F.max(filled(lead)), best(lead, "source")).alias("_src"),
    )
    out = records.join(agg, key, "left")
    new = {c: F.coalesce(blank_to_null(c), F.col(f"_{c}")) for c in fields}
    src = F.when(filled(lead), F.lit("record")).otherwise(F.col("_src"))
    return out.withColumn(f"{lead}_source", src).withColumns(new).drop("_src", *[f"_{c}" for c in fields])


def fuse_override(records: DataFrame, site: DataFrame, fields: Sequence[str], key: str = "id", order: str | None = None) -> DataFrame:
    """Values found on the site replace those of the record. Of several site
    rows for one key the last by ``order`` counts."""
    found = site.select(key, *([order] if order else []), F.struct(*fields).alias("_site"))
    s = latest_per_key(found, key, "_site", order).select(key, *[F.col(f"_site.{c}").alias(f"_{c}") for c in fields])
    out = records.join(s, key, "left")
    return out.withColumns({c: F.coalesce(blank_to_null(f"_{c}"), F.col(c)) for c in fields}).drop(*[f"_{c}" for c in fields])


# -- known URLs ---------------------------------------------------------------
def anti_join_known_urls(new: DataFrame, known: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL is not known; a null URL is never known."""
    seen = known.select(F.col(url).alias("_seen")).where("_seen is not null").distinct()
    return new.withColumn("_k", spread_nulls(url, new.columns)).join(seen, F.col("_k") == F.col("_seen"), "left_anti").drop("_k")


remaining_urls = anti_join_known_urls


def host_suffixes(host: Column) -> Column:
    """host, and every part of it after a dot."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def listed_hosts(df: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """Distinct hosts of df that equal or lie below a listed domain. Works on
    distinct hosts, so a busy host counts once."""
    hosts = df.select(url_netloc(url).alias("_host")).where("_host is not null").distinct()
    parts = hosts.select("_host", F.explode(host_suffixes(F.col("_host"))).alias("domain"))
    return parts.join(domains.select("domain"), "domain", "left_semi").select("_host").distinct()


def semi_join_domain_suffix(df: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    hit = listed_hosts(df, domains, url)
    return df.withColumn("_host", url_netloc(url)).join(hit, "_host", "left_semi").drop("_host")


def anti_join_domain_suffix(df: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    hit = listed_hosts(df, domains, url)
    keyed = df.withColumn("_host", url_netloc(url)).withColumn("_host", spread_nulls("_host", df.columns))
    return keyed.join(hit, "_host", "left_anti").drop("_host")


def filter_parser_supported(df: DataFrame, supported: DataFrame, blocked: DataFrame, url: str = "url") -> DataFrame:
    return semi_join_domain_suffix(anti_join_domain_suffix(df, blocked, url), supported, url)


def join_source_registry(urls: DataFrame, registry: Sequence[Mapping[str, str]], url: str = "url") -> DataFrame:
    """Add the key and category of the first registry entry whose base URL
    contains the host; ``default`` otherwise. The registry is a short ordered
    parameter, so it becomes a CASE and there is no join at all."""
    host = url_netloc(url)
    key, category = F.lit("default"), F.lit(None).cast("string")
    for r in reversed(list(registry)):
        hit = F.lit(r["base_url"]).contains(host)
        key = F.when(hit, F.lit(r["key"])).otherwise(key)
        category = F.when(hit, F.lit(r.get("category"))).otherwise(category)
    return urls.withColumns({"source_key": key, "source_category": category})


def category_lookup_mode(urls: DataFrame, score: Column, source_type: str = "source_type", thresholds=L.TOPIC_THRESHOLDS) -> DataFrame:
    """Threshold of the source type, 15 when unknown, next to the score."""
    return urls.withColumns({"score": score, "threshold": threshold_for(F.col(source_type), thresholds)})


# -- expansions: parameters are literal arrays, exploded beside the rows -------
def _place(*cols: str) -> Column:
    return F.concat_ws(" ", *[blank_to_null(c) for c in cols])


def expand_search_terms(locations: DataFrame, terms=L.SEARCH_TERMS, prefixes=L.SEARCH_TERM_PREFIXES, directory=L.DIRECTORY_QUERY_PREFIXES) -> DataFrame:
    """locations(city, state, country) -> one row per query, distinct, in order."""
    place = _place("city", "state", "country")
    commas = F.concat_ws(", ", *[blank_to_null(c) for c in ("city", "state", "country")])
    queries = F.array_distinct(F.array(
        *[F.trim(F.concat(F.lit(t + " "), place)) for t in [*terms, *prefixes]],
        *[F.concat(F.lit(t + " "), commas) for t in directory],
    ))
    return locations.select("*", F.posexplode(queries).alias("pos", "query"))


def expand_tasks(locations: DataFrame, sources: Sequence[str], terms: Sequence[str], phase: str = "main") -> DataFrame:
    """sources x terms for every location."""
    pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("term")) for s in sources for t in terms])
    return locations.select("*", F.inline(pairs)).withColumn("phase", F.lit(phase))


def expand_search_pages(cities: DataFrame, templates: Sequence[str], pages: int = 5, base: str = "https://www.google.com/search") -> DataFrame:
    """Search page URLs per template, city and page; page 3 and on is deep."""
    queries = F.array(*[F.replace(F.lit(t), F.lit("{city}"), F.col("city")) for t in templates])
    out = cities.select("*", F.explode(queries).alias("query")).select("*", F.explode(F.sequence(F.lit(1), F.lit(pages))).alias("page"))
    url = F.concat(F.lit(base + "?q="), F.url_encode("query"), F.lit("&start="), ((F.col("page") - 1) * 10).cast("string"))
    return out.withColumns({"url": url, "expected_depth": F.when(F.col("page") >= 3, "deep").otherwise("surface")})


def tag_search_metadata(records: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    """Add source, term, location and time of the task a record came from: of
    a task listed more than once, of its last start."""
    fields = ["source", "term", "location", "started_at"]
    found = tasks.select(F.col(key).alias("_task"), F.struct(*fields).alias("_t"), "started_at")
    one = latest_per_key(found, "_task", "_t", "started_at")
    joined = records.withColumn("_k", spread_nulls(key, records.columns)).join(one, F.col("_k") == F.col("_task").cast("string"), "left")
    return joined.select(*records.columns, *[F.col(f"_t.{c}").alias(c) for c in fields])


def expand_directory_urls(locations: DataFrame, templates=L.DIRECTORY_URL_TEMPLATES) -> DataFrame:
    """Directory search URLs per location; those with empty parts are left out."""
    enc = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    loc = enc(F.when(filled("city") & filled("state"), F.concat_ws(", ", "city", "state")).otherwise(text("state")))
    values = {"{loc}": loc, "{city}": enc(text("city")), "{state}": enc(text("state")), "{state_lower}": F.lower(enc(text("state")))}

    def fill(t):
        out = F.lit(t)
        for k, v in values.items():
            if k in t:
                out = F.replace(out, F.lit(k), v)
        return out

    urls = locations.select("*", F.posexplode(F.array(*[fill(t) for t in templates])).alias("pos", "url"))
    return urls.where(~F.col("url").endswith("//") & ~F.col("url").contains("++"))


def expand_nearby_locations(locations: DataFrame, cities=L.MAJOR_CITIES, neighbours=L.STATE_NEIGHBOURS) -> DataFrame:
    """(city, state) -> itself (1), five big cities of the state (2), the state
    (3), two neighbour states (4); less is known, less is expanded."""
    def lookup(table, n):
        m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v[:n]]))])
        return F.coalesce(F.try_element_at(m, F.col("state")), F.array().cast("array<string>"))

    def place(c, s, p):
        return F.struct(c.alias("near_city"), s.alias("near_state"), F.lit(p).alias("priority"))

    blank, city, state = F.lit(""), text("city"), text("state")
    big = F.filter(lookup(cities, 5), lambda c: F.lower(c) != F.lower(city))
    full = F.concat(
        F.array(place(city, state, 1)), F.transform(big, lambda c: place(c, state, 2)),
        F.array(place(blank, state, 3)), F.transform(lookup(neighbours, 2), lambda s: place(blank, s, 4)))
    near = F.when((city != "") & (state != ""), full).when(state != "", F.array(place(blank, state, 1))).otherwise(F.array(place(blank, blank, 1)))
    return locations.select("*", F.posexplode(near).alias("pos", "n")).select(*locations.columns, "pos", "n.*")


# -- materials ----------------------------------------------------------------
def join_materials_bridge(centers: DataFrame, bridge: DataFrame, materials: DataFrame) -> DataFrame:
    """Centres with their materials and mean prices. The bridge is aggregated
    to one row per pair before it is joined; the per-centre set is bounded by
    the material dimension."""
    pairs = bridge.groupBy("center_id", "material_id").agg(F.avg("price").alias("price"), F.count("*").alias("offers"))
    named = pairs.join(materials.select("material_id", "material"), "material_id")
    per = named.groupBy("center_id", "material").agg(F.sum(F.col("price") * F.col("offers")).alias("s"), F.sum("offers").alias("offers"))
    per = per.withColumn("price", F.col("s") / F.col("offers")).drop("s")
    rows = per.groupBy("center_id").agg(
        F.array_sort(F.collect_set("material")).alias("materials"), F.max("price").alias("best_price"), F.sum("offers").alias("offers"))
    return centers.join(rows, "center_id", "left")


def upsert_material_dim(dim: DataFrame, names: DataFrame) -> DataFrame:
    """Add unseen names with an id that depends on the name only."""
    new = names.select("name").where(filled("name")).distinct().join(dim.select("name"), "name", "left_anti")
    return dim.select("id", "name").unionByName(new.select(F.xxhash64("name").alias("id"), "name"))


def join_processing_log(articles: DataFrame, log: DataFrame, limit: int | None = None) -> DataFrame:
    """Log rows with their article; with a limit the newest ones."""
    joined = log.join(articles.select(F.col("id").alias("article_id"), "title", "url"), "article_id")
    return joined if limit is None else joined.orderBy(F.desc("created_at"), F.desc("log_id")).limit(limit)


# -- set operations -----------------------------------------------------------
def union_sources(**sources: DataFrame) -> DataFrame:
    """Per-source URL lists as one table, tagged."""
    out = None
    for name, df in sources.items():
        tagged = df.withColumn("collected_by", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def union_distinct_urls(*lists: DataFrame, url: str = "url") -> DataFrame:
    out = lists[0].select(url)
    for df in lists[1:]:
        out = out.union(df.select(url))
    return out.distinct()


except_urls = anti_join_known_urls


def cap_by_priority(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], priority: str = "priority", caps=L.PRIORITY_CAPS, default: int = L.PRIORITY_CAP_DEFAULT) -> DataFrame:
    """At most 20/15/10/5 rows per location, by its priority."""
    limit = F.lit(default)
    for p, n in caps.items():
        limit = F.when(col(priority) == p, n).otherwise(limit)
    from pyspark.sql import Window

    w = Window.partitionBy(*keys, priority).orderBy(*order)
    top = max([*caps.values(), default])
    ranked = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= top)
    return ranked.where(F.col("_rn") <= limit).drop("_rn")


