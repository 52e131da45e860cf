"""Category digests. Every group that is put together is bounded first: at
most ``articles`` rows per period and ``k`` per category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webrec.functions.common import blank_to_null, filled, text
from webrec.operators.dedup import top_per_key


# fixed values in this module: headings, labels and the layout of entries, which
# are the text of the digests
def _entry(read: str) -> Column:
    title = F.coalesce(blank_to_null("translated_title"), F.col("title"))
    return F.concat(
        F.lit("- **"), title, F.lit("**\n"),
        F.when(filled("summary"), F.concat(F.lit("  "), F.substring("summary", 1, 100), F.lit("...\n"))).otherwise(""),
        F.lit(f"  [{read}]("), text("url"), F.lit(")\n\n"))


def _assemble(picked: DataFrame, keys: list[str], read: str, k: int, heading) -> DataFrame:
    """Rows (keys, id, categories...) -> one digest body per keys."""
    cats = picked.select(
        *keys, "id", "published_at", _entry(read).alias("entry"),
        F.explode(F.when(filled("categories_list"), F.transform(F.split("categories_list", ","), lambda x: F.trim(x))).otherwise(F.array(F.lit("other")))).alias("category"))
    top = top_per_key(cats, [*keys, "category"], [F.asc("published_at"), F.asc("id")], k)
    sections = top.groupBy(*keys, "category").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("published_at", "id", "entry"))), lambda e: e["entry"]), "").alias("body"),
        F.count("*").alias("n"))
    section = F.concat(F.lit("## "), heading(F.col("category")), F.lit("\n\n"), F.col("body"))
    gathered = F.sort_array(F.collect_list(F.struct("category", section.alias("s"), "n")))
    grouped = sections.groupBy(*keys) if keys else sections.groupBy()
    return grouped.agg(gathered.alias("parts")).select(
        *keys,
        F.array_join(F.transform("parts", lambda p: p["s"]), "").alias("sections"),
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, p: a + p["n"]).alias("listed"),
        F.array_join(F.transform("parts", lambda p: p["category"]), ", ").alias("categories"))


def _title_case(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def digest_period(articles: DataFrame, start: str, end: str, frequency: str = "daily", articles_limit: int | None = None, k: int = 5) -> DataFrame:
    """Processed articles published in [start, end]: one digest row with
    markdown, article count (with multiplicity) and categories."""
    window = F.col("published_at").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp"))
    picked = articles.where(F.col("is_processed") & window)
    if articles_limit is not None:
        picked = picked.orderBy("published_at", "id").limit(articles_limit)
    head = f"# {frequency.title()} дайджест новостей металлургической отрасли\n\n"
    days = [F.date_format(F.lit(x).cast("timestamp"), "dd.MM.yyyy") for x in (start, end)]
    body = _assemble(picked, [], "Читать далее", k, _title_case)
    return body.where("listed > 0").select(
        F.lit(frequency).alias("digest_type"),
        F.concat(F.lit(head + "Период: "), days[0], F.lit(" - "), days[1], F.lit("\n\n"), F.col("sections")).alias("content"),
        F.col("listed").alias("article_count"), "categories")


def digest_simple(articles: DataFrame, frequency: str = "daily", k: int = 3) -> DataFrame:
    """Given articles, at most k per category; the count is that of articles."""
    head = f"# {frequency.title()} дайджест металлургической отрасли\n\n"
    body = _assemble(articles, [], "Читать", k, lambda c: F.initcap(F.replace(c, F.lit(":"), F.lit(" "))))
    return body.select(
        F.concat(F.lit(head), F.col("sections")).alias("content"), articles.agg(F.count("*")).scalar().alias("article_count"), "categories",
        F.lit(frequency).alias("frequency"))


def digest_by_frequency(articles: DataFrame, frequency: str = "weekly", articles_limit: int | None = None, k: int = 5) -> DataFrame:
    """One digest per day, week or month of publication."""
    unit = {"daily": "day", "weekly": "week", "monthly": "month"}[frequency]
    dated = articles.where("is_processed").withColumn("period", F.date_trunc(unit, "published_at"))
    picked = dated if articles_limit is None else top_per_key(dated, ["period"], [F.asc("published_at"), F.asc("id")], articles_limit)
    return _assemble(picked, ["period"], "Читать далее", k, _title_case).select(
        "period", F.lit(frequency).alias("digest_type"), "sections", F.col("listed").alias("article_count"), "categories")
