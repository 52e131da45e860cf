"""Coverage, distribution and run reports.

All are one-pass aggregates (partial aggregation before the shuffle); shares of
a total come from a one-row scalar subquery, never from a window over the
whole table.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webrec.functions.common import blank_to_null, cut, filled, filled_array, text
from webrec.session import cut_lineage

BIG = "bigint"


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Share in percent; 0 when there is nothing."""
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(F.lit(0.0))


def with_share(counts: DataFrame, total: DataFrame, digits: int = 1, n: str = "n") -> DataFrame:
    """Add the share of each count in a one-row total."""
    return counts.withColumn("percent", percent(F.col(n), total.scalar(), digits))


def long_counts(df: DataFrame, measures: Mapping[str, Column], label: str = "field") -> DataFrame:
    """Several counts in one pass, one row each, with their share of rows."""
    one = df.agg(F.count("*").alias("_total"), *[F.count_if(c).alias(k) for k, c in measures.items()])
    pairs = F.array(*[F.struct(F.lit(k).alias(label), F.col(k).alias("n")) for k in measures])
    return one.select(F.inline(pairs), F.col("_total").alias("total")).withColumn("percent", percent(F.col("n"), F.col("total")))


def agg_validation_issues(issues: DataFrame, col: str = "issues") -> DataFrame:
    """Issue -> rows, most frequent first; valid and total beside it."""
    # one pass: every row also counts as itself, and as valid where it is
    every, valid = F.lit("\u0000all"), F.lit("\u0000valid")
    marked = F.concat(F.col(col), F.array(every), F.when(F.size(col) == 0, F.array(valid)).otherwise(F.array().cast("array<string>")))
    counts = issues.select(F.explode(marked).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # over one row per kind of issue
    of = lambda mark: F.coalesce(F.max(F.when(F.col("issue") == mark, F.col("n"))).over(whole), F.lit(0)).cast(BIG)
    return counts.withColumns({"total": of(every), "valid": of(valid)}).where(~F.col("issue").startswith("\u0000")).orderBy(F.desc("n"), "issue")


def agg_contact_coverage(records: DataFrame) -> DataFrame:
    return long_counts(records, {
        "phone": filled("phone"), "email": filled("email"), "website": filled("website"), "address": filled("address"),
        "coordinates": F.col("latitude").isNotNull() & F.col("longitude").isNotNull(),
    })


def distribution(records: DataFrame, key: Column, name: str, total: DataFrame | None = None) -> DataFrame:
    """Value counts with share, most frequent first."""
    counts = records.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    # the groups cover all rows, so their sum is the total: no second scan
    out = with_share(counts, total if total is not None else counts.agg(F.coalesce(F.sum("n"), F.lit(0))))
    return out.orderBy(F.desc("n"), name)


def agg_country_distribution(records: DataFrame) -> DataFrame:
    return records.groupBy(F.coalesce(blank_to_null("country"), F.lit("Unknown")).alias("country")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "country")


def agg_state_distribution(records: DataFrame) -> DataFrame:
    return distribution(records, F.coalesce(blank_to_null("state"), F.lit("Unknown")), "state")


def agg_material_distribution(records: DataFrame, top: int = 20) -> DataFrame:
    """Materials with their share of businesses, the top ones."""
    counts = records.select(F.explode("materials").alias("material")).groupBy("material").agg(F.count("*").alias("n"))
    return with_share(counts, records.agg(F.count("*"))).orderBy(F.desc("n"), "material").limit(top)


def agg_geo_market(profiled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """By state: count, mean completeness and contact quality, most common
    size (smallest name on ties). By tier: count, high priority, completeness."""
    sizes = profiled.groupBy("state", "business_size_estimate").agg(
        F.count("*").alias("n"), F.sum("completeness").alias("c"), F.sum("contact_quality").alias("q"))
    by_state = sizes.groupBy("state").agg(
        F.sum("n").alias("businesses"), F.round(F.sum("c") / F.sum("n"), 2).alias("avg_completeness"),
        F.round(F.sum("q") / F.sum("n"), 2).alias("avg_contact_quality"),
        F.min_by("business_size_estimate", F.struct(-F.col("n"), F.col("business_size_estimate"))).alias("common_size"))
    by_tier = profiled.groupBy("market_tier").agg(
        F.count("*").alias("businesses"), F.count_if(F.col("outreach_priority") == "High").alias("high_priority"),
        F.round(F.avg("completeness"), 2).alias("avg_completeness"))
    return by_state, by_tier


def agg_size_analysis(profiled: DataFrame) -> DataFrame:
    return profiled.groupBy("business_size_estimate").agg(
        F.count("*").alias("businesses"), F.round(F.avg("completeness"), 2).alias("avg_completeness"),
        F.count_if(F.col("outreach_priority") == "High").alias("high_priority"))


def agg_service_capability(profiled: DataFrame, flags: Sequence[str]) -> DataFrame:
    return long_counts(profiled, {f: F.col(f) == "Yes" for f in flags}, "service")


def agg_factor_shares(df: DataFrame, factors: Mapping[str, str]) -> DataFrame:
    """Value counts with share for several columns, stacked under a label. One
    scan: each row becomes its (label, value) pairs, combined before the
    shuffle."""
    pairs = F.array(*[F.struct(F.lit(label).alias("factor"), F.col(c).cast("string").alias("value")) for c, label in factors.items()])
    counts = df.select(F.inline(pairs)).groupBy("factor", "value").agg(F.count("*").alias("n"))
    return with_share(counts, df.agg(F.count("*")))


def agg_source_quality(records: DataFrame) -> DataFrame:
    return records.groupBy("source").agg(F.count("*").alias("n"), F.count_if(filled("phone")).alias("with_phone")).withColumn(
        "percent", percent(F.col("with_phone"), F.col("n")))


def agg_extraction_method(records: DataFrame) -> DataFrame:
    with_phone = records.where(filled("phone"))
    return distribution(with_phone, F.col("method"), "method")


def agg_search_page_distribution(records: DataFrame) -> DataFrame:
    return distribution(records, F.col("page_no"), "page_no")


def exploded_categories(articles: DataFrame, col: str = "categories_list") -> DataFrame:
    return articles.where(filled(col)).select("*", F.explode(F.transform(F.split(col, ","), lambda x: F.trim(x))).alias("category"))


def agg_category_counts(articles: DataFrame) -> DataFrame:
    return exploded_categories(articles).groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category")


def agg_category_stats(articles: DataFrame, top: int = 10) -> DataFrame:
    """Top categories with totals and coverage; an article is covered if its
    categories say more than ``type:other``."""
    covered = filled("categories_list") & (F.col("categories_list") != "type:other")
    totals = articles.agg(F.count("*").alias("total"), F.count_if(covered).alias("covered"))
    counts = agg_category_counts(articles).limit(top)
    return counts.withColumns({"total": totals.select("total").scalar(), "coverage": totals.select(F.col("covered") / F.col("total")).scalar()})


def agg_article_status(articles: DataFrame, digests: DataFrame | None = None) -> DataFrame:
    """One row: totals, processed, published, shares; zeros when empty."""
    out = articles.agg(
        F.count("*").alias("total"), F.count_if("is_processed").alias("processed"), F.count_if("is_published").alias("published"),
        F.count_if(F.col("is_processed") & ~F.col("is_published")).alias("waiting"))
    out = out.withColumns({"processed_percent": percent(F.col("processed"), F.col("total")), "published_percent": percent(F.col("published"), F.col("total"))})
    return out.withColumn("digests", digests.agg(F.count("*")).scalar()) if digests is not None else out


def agg_articles_by_source(articles: DataFrame) -> DataFrame:
    return articles.where("source is not null").groupBy("source").agg(F.count("*").alias("n"))


def agg_run_report(sightings: DataFrame, floor_minutes: float = 0.1) -> DataFrame:
    """Per run: collected, distinct, duplicates, per-source map, URLs per
    minute. URL counts are made per (run, url) first, so one busy run or URL
    is combined before it is counted."""
    per_url = sightings.groupBy("run_id", "source", "url").agg(F.count("*").alias("n"), F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    per_pair = per_url.groupBy("run_id", "url").agg(
        F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    urls = per_pair.groupBy("run_id").agg(
        F.sum("n").alias("collected"), F.count("*").alias("distinct_urls"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    src = per_url.groupBy("run_id", "source").agg(F.sum("n").alias("n")).groupBy("run_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("sources"))
    seconds = F.unix_micros(F.col("t1").cast("timestamp")) / 1e6 - F.unix_micros(F.col("t0").cast("timestamp")) / 1e6
    return urls.join(src, "run_id").select(
        "run_id", "collected", "distinct_urls", (F.col("collected") - F.col("distinct_urls")).alias("duplicates_removed"), "sources",
        F.round(F.col("distinct_urls") / F.greatest(seconds / 60, F.lit(floor_minutes)), 4).alias("urls_per_minute"))


def agg_parsing_stats(articles: DataFrame) -> DataFrame:
    return articles.groupBy("parser").agg(F.count("*").alias("n"))


def agg_funnel(collected: DataFrame, processed: DataFrame, generated: DataFrame, key: str = "run_id") -> DataFrame:
    """Per run: collected -> processed -> generated, with conversion."""
    parts = [df.groupBy(key).agg(F.count("*").alias(n)) for df, n in ((collected, "collected"), (processed, "processed"), (generated, "generated"))]
    out = reduce(lambda a, b: a.join(b, key, "left"), parts).na.fill(0, ["processed", "generated"])
    return out.withColumns({"processed_percent": percent(F.col("processed"), F.col("collected")), "generated_percent": percent(F.col("generated"), F.col("processed"))})


def agg_keyword_suggestions(docs: DataFrame, stopwords: Sequence[str], column: str = "text", top: int = 10, longer_than: int = 3) -> DataFrame:
    """Most frequent tokens that are not stop words. Tokens are counted on the
    map side; the stop list is a short literal."""
    tokens = docs.select(F.explode(F.split(F.lower(column), r"\s+")).alias("word"))
    kept = tokens.where((F.length("word") > longer_than) & ~F.col("word").isin(*stopwords))
    return kept.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(top)


def agg_metal_specialization(profiled: DataFrame) -> DataFrame:
    """One row per business and metal."""
    return profiled.select(
        "id", "name", "city", "state", F.explode_outer("materials").alias("metal"),
        F.when(F.size("materials") > 0, F.round(100.0 / F.size("materials"), 1)).alias("confidence"), "contact_quality")


def agg_quality_overview(profiled: DataFrame) -> DataFrame:
    return profiled.agg(
        F.count("*").alias("total"), F.count_if(filled_array("materials")).alias("with_metals"), F.count_if(filled("pricing")).alias("with_pricing"),
        F.count_if(filled_array("services")).alias("with_services"), F.count_if(filled("website")).alias("with_website"),
        F.count_if(filled("phone")).alias("with_phone"), F.round(F.avg("completeness"), 2).alias("avg_completeness"))


# -- positions and bulks ------------------------------------------------------
def global_position(df: DataFrame, order: str) -> DataFrame:
    """(order, pos): 0-based place of every row in the order of a unique
    column, without one task seeing all rows. Rows are range-partitioned and
    sorted, numbered inside their partition, and the sizes of the partitions
    before (one row each) are added. The slim result is checkpointed, so both
    readers see the same split; the places do not depend on the split."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = df.select(order).repartitionByRange(n, order).sortWithinPartitions(order)
    mark = F.monotonically_increasing_id()
    placed = cut_lineage(slim.select(order, F.shiftright(mark, 33).alias("_p"), mark.bitwiseAND((1 << 33) - 1).alias("_i")))
    sizes = placed.groupBy("_p").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    before = sizes.select("_p", F.coalesce(earlier, F.lit(0)).alias("_before"))
    # one row per partition: at most `n` rows
    return placed.join(F.broadcast(before), "_p").select(order, (F.col("_before") + F.col("_i")).alias("pos"))


def agg_llm_chunks(docs: DataFrame, order: str, bulk: int = 20, url: str = "url", body: str = "text", chars: int | None = None) -> DataFrame:
    """Bulks of N documents, one prompt body each (N is the bound of a group),
    whole texts unless ``chars`` is given."""
    places = global_position(docs, order)
    rows = docs.select(order, url, cut(F.col(body), chars).alias("_t")).join(places, order).select(F.floor(F.col("pos") / bulk).cast(BIG).alias("chunk"), "pos", F.col(url).alias("_u"), "_t")
    grouped = rows.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("pos", "_u", "_t"))).alias("docs"))
    doc = lambda d, i: F.concat(F.lit("-- DOC "), (i + 1).cast("string"), F.lit(" --\nURL: "), text(d["_u"]), F.lit("\nTEXT:\n"), text(d["_t"]))
    return grouped.select("chunk", F.size("docs").cast(BIG).alias("n_docs"), F.array_join(F.transform("docs", doc), "\n\n").alias("prompt"))

