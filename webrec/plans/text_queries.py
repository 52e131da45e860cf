"""Queries for lexicons, prices, attributes, summaries and post fields."""

from pyspark.sql import functions as F

from webrec import lexicons as L
from webrec.functions import text as T
from webrec.plans import sqltext as S
from webrec.plans.inputs import table, view, with_views
from webrec.plans.registry import query

A = with_views("articles")
CO = with_views("companies")

# lexicons made of words of the given prose
DEMO = {"common": ["thanedble", "tion", "hehely"], "german": ["keit", "ungen", "lich"], "contact": ["example.com", "555", "api"], "none": ["zzz-no-such"]}
DEMO_WORDS = ["the", "tion", "der", "que", "inoran"]
ABOUT = "(description || ' ' || coalesce(hours, '') || ' Paying $3.25 per pound; brass 2.10 lb. We offer roll-off and hauling. Since ' || CAST(1980 + id % 40 AS STRING) || '.')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _articles(spark, sf_dir):
    return view(spark, sf_dir, "articles")


def _about(spark, sf_dir):
    return view(spark, sf_dir, "companies").select("id", F.expr(ABOUT).alias("about"))


def _about_sql(expr, name):
    return f"{CO}, ab AS (SELECT id, {ABOUT} AS about FROM companies) SELECT id, {expr} AS {name} FROM ab"


def _about_query(name, col, expr, fn):
    query(name, _about_sql(expr, col))(lambda spark, sf_dir: _about(spark, sf_dir).select("id", fn().alias(col)))


# -- lexicons -----------------------------------------------------------------
query(
    "lexicon_match",
    "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {S.has_any('lower(text)', ws)} THEN '{c}' END" for c, ws in DEMO.items())
    + "], lambda v: v IS NOT NULL), '|') AS categories FROM documents",
)(lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.array_join(T.lexicon_match("text", DEMO), "|").alias("categories")))


def _n(words, body="lower(text)"):
    return "(" + " + ".join(f"(length({body}) - length(replace({body}, {S.lit(w)}, ''))) // {len(w)}" for w in words) + ")"


query(
    "lexicon_count_score",
    "SELECT doc_id, category, least(n / 5.0, 1.0)::DOUBLE AS score FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, {_n(ws)} AS n FROM documents" for c, ws in DEMO.items()) + ") WHERE n > 0",
)(
    lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.explode(T.lexicon_count_score("text", DEMO)).alias("category", "score"))
)
_METALS = {"common": ["the", "thanedble", "in", "an of"], "rare": ["inoran", "ononst"], "german": ["der", "und", "die"]}
query(
    "lexicon_confidence",
    "SELECT doc_id, type, CAST(n AS BIGINT) AS found, round(n * 100.0 / total, 1)::DOUBLE AS confidence FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS type, len([w for w in {S.lst(ws)} if list_contains(regexp_split_to_array(text, '\\s+'), w)]) AS n, {len(ws)} AS total FROM documents"
        for c, ws in _METALS.items()) + ") WHERE n > 0",
)(
    lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.explode(T.lexicon_confidence("text", _METALS)).alias("m"))
    .select("doc_id", "m.type", F.size("m.keywords_found").cast("bigint").alias("found"), "m.confidence")
)
_SORTED = sorted(DEMO_WORDS)
query("intersect_keywords", f"SELECT doc_id, array_to_string([w for w in {S.lst(_SORTED)} if list_contains(regexp_split_to_array(text, '\\s+'), w)], '|') AS words FROM documents")(
    lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", F.array_join(F.array_sort(T.intersect_keywords("text", _SORTED)), "|").alias("words"))
)
query("filter_relevant_article", f"{A} SELECT id FROM articles WHERE {S.has_any('lower(title || chr(32) || content)', ['inoran', 'keit', 'élan'])}")(
    lambda spark, sf_dir: _articles(spark, sf_dir).where(T.filter_relevant_article("title", "content", ["inoran", "Keit", "élan"])).select("id")
)
query("keyword_search", f"{A} SELECT id, title FROM articles WHERE {S.has_any('lower(title || chr(32) || content)', ['hehely', 'a.b*', 'über'])}")(
    lambda spark, sf_dir: _articles(spark, sf_dir).where(T.keyword_search("title", "content", ["HEHELY", "a.b*", "über"])).select("id", "title")
)
_LB = "lower(title || ' ' || content)"
_CATS = ", ".join(
    [f"CASE WHEN {S.has_any(_LB, ws)} THEN 'material:{c}' END" for c, ws in DEMO.items()]
    + [f"CASE WHEN {S.has_any(_LB, ws)} THEN 'region:{c}' END" for c, ws in L.CATEGORY_REGIONS.items()]
    + [f"CASE WHEN {S.has_any(_LB, ws)} THEN 'type:{c}' END" for c, ws in L.CATEGORY_NEWS_TYPES.items()])
query(
    "categorize_article",
    f"{A} SELECT id, CASE WHEN c = '' THEN 'type:other' ELSE c END AS categories FROM (SELECT id, array_to_string(list_filter([{_CATS}], lambda v: v IS NOT NULL), '|') AS c FROM articles)",
)(
    lambda spark, sf_dir: _articles(spark, sf_dir).select("id", F.array_join(T.categorize_article("title", "content", DEMO), "|").alias("categories"))
)
query(
    "merge_text_sources",
    f"{CO} SELECT id, coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(materials, []), coalesce(services, []), ['steel']))), '|'), '') AS merged FROM companies",
)(
    lambda spark, sf_dir: view(spark, sf_dir, "companies").select(
        "id", F.array_join(T.merge_text_sources(F.col("materials"), F.col("services"), F.array(F.lit("steel"))), "|").alias("merged"))
)
query("combine_text_sources", f"{CO} SELECT id, lower(concat_ws(' ', nullif(name, ''), nullif(description, ''), nullif(website, ''), nullif(city, ''))) AS body FROM companies")(
    lambda spark, sf_dir: view(spark, sf_dir, "companies").select("id", T.combine_text_sources("name", "description", "website", "city").alias("body"))
)

# -- materials, prices, attributes --------------------------------------------
_about_query(
    "materials_string", "materials", f"array_to_string(list_sort({S.words_in('lower(coalesce(about, chr(32)))', L.MATERIAL_KEYWORDS)}), ', ')",
    lambda: T.materials_string("about"),
)
_about_query(
    "extract_inline_prices", "prices",
    # the sentence has one price that fits, with known words on both sides
    r"""coalesce(CASE WHEN regexp_matches(about[greatest(1, strpos(about, '$3.25 per pound') - 60):strpos(about, '$3.25 per pound') + 74], '(?i)copper|aluminum|steel|stainless|iron|brass|lead|zinc|nickel|wire') THEN
      trim(regexp_replace(about[greatest(1, strpos(about, '$3.25 per pound') - 60):strpos(about, '$3.25 per pound') + 74], '\s+', ' ', 'g')) END, '')""",
    lambda: F.array_join(T.extract_inline_prices("about"), "|"),
)
_about_query(
    "extract_price_struct", "prices",
    r"CASE WHEN about IS NULL THEN '' ELSE 'paying:3.25:per pound|brass:2.10:lb|-:3.25:per pound|-:3.25:per pound|brass:2.10:-' END",
    lambda: F.array_join(F.transform(T.extract_price_struct("about"), lambda p: F.concat_ws(
        ":", F.coalesce(p["metal"], F.lit("-")), F.format_number(p["price"], 2), F.coalesce(p["unit"], F.lit("-")))), "|"),
)
_PHRASES = "list_concat(" * 5 + "".join(
    (f"{', ' if i else ''}[trim(x) for x in regexp_extract_all(coalesce(about, ''), '(?i){p}', {1 if '([^.]+)' in p else 0})]" + (")" if i else ""))
    for i, p in enumerate(L.SERVICE_PHRASES))
_about_query(
    "services_from_text", "services",
    f"array_to_string({S.distinct('list_concat(' + S.words_in('lower(coalesce(about, chr(32)))', L.SERVICES) + ', ' + _PHRASES + ')')}, '|')",
    lambda: F.array_join(T.services_from_text("about"), "|"),
)
query(
    "payment_methods",
    _about_sql(f"array_to_string({S.words_in('lower(coalesce(about, chr(32)))', L.PAYMENT_KEYWORDS)}, '|')", "methods")
    .replace(" AS methods FROM", " AS methods, coalesce(nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {S.has_any('lower(about)', ws)} THEN '{n}' END" for n, ws in L.PAYMENT_GROUPS) + "), ''), 'Standard Methods') AS groups FROM"),
)(
    lambda spark, sf_dir: _about(spark, sf_dir).select("id", F.array_join(T.payment_methods("about"), "|").alias("methods"), T.payment_groups("about").alias("groups"))
)


def _cat_all(patterns, body="coalesce(about, '')", group=0):
    out = f"regexp_extract_all({body}, '(?i){patterns[0]}', {group})"
    for p in patterns[1:]:
        out = f"list_concat({out}, regexp_extract_all({body}, '(?i){p}', {group}))"
    return out


query(
    "certifications",
    _about_sql(f"array_to_string({_cat_all(L.CERTIFICATION_PATTERNS)}, '|')", "found")
    .replace(" AS found FROM", " AS found, coalesce(nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {S.has_any('lower(about)', ws)} THEN '{n}' END" for n, ws in L.CERTIFICATION_FLAGS) + "), ''), 'Standard Compliance') AS flags FROM"),
)(
    lambda spark, sf_dir: _about(spark, sf_dir).select("id", F.array_join(T.certifications("about"), "|").alias("found"), T.certification_flags("about").alias("flags"))
)
_about_query(
    "years_in_business", "years", "coalesce(" + ", ".join(f"nullif(regexp_extract(about, '(?i){p}', 1), '')" for p in L.YEARS_PATTERNS) + ")",
    lambda: T.years_in_business("about"),
)
_about_query(
    "established_year", "year", r"CAST(list_min([y for y in [CAST(x AS INT) for x in regexp_extract_all(about, '\b(?:19|20)\d{2}\b')] if y BETWEEN 1950 AND 2024]) AS BIGINT)",
    lambda: T.established_year("about").cast("bigint"),
)
_about_query(
    "languages_spoken", "languages",
    "array_to_string(list_concat(list_concat(list_concat(" + ", ".join(f"regexp_extract_all(coalesce(about, ''), '(?i){p}', {g})" + (")" if i else "") for i, (p, g) in enumerate(L.LANGUAGE_PATTERNS)) + ", '|')",
    lambda: F.array_join(T.languages_spoken("about"), "|"),
)
_about_query(
    "additional_info", "info", f"array_to_string({_cat_all(L.ADDITIONAL_INFO_PATTERNS, group=1)}, '|')",
    lambda: F.array_join(T.additional_info("about"), "|"),
)

# -- summaries ----------------------------------------------------------------
_H = "text[1:200]"
query(
    "summary_truncate",
    f"""SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE CASE WHEN strpos(reverse({_H}), ' ') > 0 AND 200 - strpos(reverse({_H}), ' ') > 0
        THEN {_H}[1:length({_H}) - strpos(reverse({_H}), ' ')] ELSE {_H} END || '...' END AS summary,
        CASE WHEN length(text) <= 200 THEN text ELSE text[1:197] || '...' END AS summary_cut FROM documents""",
)(lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", T.summary_truncate("text").alias("summary"), T.summary_cut("text").alias("summary_cut")))
query(
    "summary_first_sentences",
    """WITH s AS (SELECT doc_id, text, string_split(text, '.') AS l FROM documents),
     k AS (SELECT doc_id, text, l, len([i for i in range(1, least(len(l), 192) + 1) if list_sum([length(x) for x in l[1:i]]) + i - 1 <= 190]) AS n FROM s)
     SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN n = 0 THEN text[1:197] || '...' ELSE array_to_string(l[1:n], '.') || '.' END AS summary FROM k""",
)(lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", T.summary_first_sentences("text").alias("summary")))
_SENT = r"[s for s in [regexp_replace(x, '^\s+|\s+$', '', 'g') for x in string_split(regexp_replace(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), '\n+', chr(1), 'g'), chr(1))] if s <> '']"
query(
    "summary_extractive",
    f"""WITH d AS (SELECT doc_id, text, {_SENT} AS l FROM documents),
     u AS (SELECT doc_id, text, unnest(l) AS s, unnest(range(len(l))) AS i FROM d),
     o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {S.n_hits('lower(s)', DEMO_WORDS)} DESC, i) AS r FROM u),
     c AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY r) - 1 AS total FROM o),
     f AS (SELECT doc_id, coalesce(min(CASE WHEN total > 190 THEN r END), 1000000) AS stop FROM c GROUP BY doc_id),
     g AS (SELECT c.doc_id, string_agg(s, ' ' ORDER BY r) AS chosen FROM c JOIN f ON c.doc_id = f.doc_id AND r < stop GROUP BY c.doc_id)
     SELECT d.doc_id, CASE WHEN chosen IS NULL THEN text[1:197] || '...' WHEN length(text) > 200 THEN chosen || '...' ELSE chosen END AS summary FROM d LEFT JOIN g ON d.doc_id = g.doc_id""",
)(lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", T.summary_extractive("text", DEMO_WORDS).alias("summary")))
query(
    "basic_rewrite",
    r"SELECT doc_id, CASE WHEN j <> '' AND NOT starts_with(j, '#') THEN '## Обзор' || chr(10) || chr(10) || j ELSE j END AS rewritten FROM (SELECT doc_id, array_to_string([x for x in [trim(regexp_replace(l, '\s+', ' ', 'g')) for l in string_split(text, chr(10))] if x <> ''], chr(10) || chr(10)) AS j FROM documents)",
)(lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", T.basic_rewrite("text").alias("rewritten")))
query(
    "capitalize_sentences",
    f"SELECT doc_id, CASE WHEN length(j) < length(text) * 0.5 THEN text ELSE j END AS rewritten FROM (SELECT doc_id, text, array_to_string([upper(s[1]) || s[2:] for s in {_SENT}], ' ') AS j FROM documents)",
)(lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", T.capitalize_sentences("text").alias("rewritten")))
_PARA = "replace(text, chr(10), chr(10) || chr(10))"
query(
    "segment_paragraphs",
    rf"SELECT doc_id, CAST(len(p) AS BIGINT) AS n, array_to_string(p, '|') AS paragraphs FROM (SELECT doc_id, [x for x in [regexp_replace(s, '^\s+|\s+$', '', 'g') for s in string_split({_PARA}, chr(10) || chr(10))] if length(x) > 50] AS p FROM documents)",
)(
    lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", T.segment_paragraphs(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("p"))
    .select("doc_id", F.size("p").cast("bigint").alias("n"), F.array_join("p", "|").alias("paragraphs"))
)
query(
    "dedup_lines",
    rf"SELECT doc_id, array_to_string({S.distinct('l')}, ' ') AS cleaned FROM (SELECT doc_id, [x for x in [regexp_replace(s, '^\s+|\s+$', '', 'g') for s in string_split(text, chr(10))] if length(x) > 2] AS l FROM documents)",
)(lambda spark, sf_dir: _docs(spark, sf_dir).select("doc_id", T.dedup_lines("text").alias("cleaned")))

# -- posts --------------------------------------------------------------------
_CATLIST = "coalesce([trim(c) for c in string_split(categories_list, ',')], [])"
_TAGS = S.distinct(
    f"list_concat(list_concat({_CATLIST}, ['source:' || source]), list_concat(CASE WHEN contains(coalesce(categories_list, ''), 'scrap') THEN {S.lst(T.TAG_SCRAP)} ELSE [] END, "
    f"CASE WHEN contains(lower(title || ' ' || content), 'inoran') THEN {S.lst(T.TAG_STEEL)} ELSE [] END))")
query("article_tags", f"{A} SELECT id, array_to_string({_TAGS}, '|') AS tags FROM articles")(
    lambda spark, sf_dir: _articles(spark, sf_dir).select(
        "id", F.array_join(T.article_tags("categories_list", "source", "title", "content", steel_word="inoran"), "|").alias("tags"))
)
_RULES = [(["inoran", "лом"], ["scrap metal", "металлолом"]), (["keit"], ["steel", "сталь"])]
query(
    "article_tags_export",
    f"{A} SELECT id, array_to_string({S.distinct('t')}, ', ') AS tags FROM (SELECT id, list_concat(list_concat({_CATLIST}, ['source:' || source]), list_concat("
    + ", ".join(f"CASE WHEN {S.has_any('lower(content)', ws)} THEN {S.lst(ts)} ELSE [] END" for ws, ts in _RULES) + ")) AS t FROM articles)",
)(lambda spark, sf_dir: _articles(spark, sf_dir).select("id", T.article_tags_export("categories_list", "source", "content", _RULES).alias("tags")))
_ST = "CASE WHEN length(t || ' | Blog') > 60 THEN t[1:57] || '...' ELSE t || ' | Blog' END"
_SD = "coalesce(nullif(summary[1:160], ''), nullif(content[1:160], ''), 'Новости металлургической отрасли: ' || t[1:100])"
query("seo_meta", f"{A} SELECT id, {_ST} AS seo_title, {_SD} AS seo_description, array_to_string({_TAGS}, ', ') AS keywords FROM (SELECT *, coalesce(translated_title, title) AS t FROM articles)")(
    lambda spark, sf_dir: _articles(spark, sf_dir).select(
        "id", T.seo_meta(F.coalesce("translated_title", "title"), "content", "summary", T.article_tags("categories_list", "source", "title", "content", steel_word="inoran")).alias("m")
    ).select("id", F.col("m.title").alias("seo_title"), F.col("m.description").alias("seo_description"), "m.keywords")
)
query(
    "format_blog_post",
    f"""{A} SELECT id, coalesce(translated_title, title) AS title, coalesce(rewritten_content, translated_content, content) AS content, title AS original_title,
        CAST(len(coalesce(string_split(categories_list, ','), [])) AS BIGINT) AS n_categories, strftime(published_at, '%Y-%m-%dT%H:%M:%S') AS published_at, url, is_published,
        {_ST} AS seo_title FROM (SELECT *, coalesce(translated_title, title) AS t FROM articles)""",
)(
    lambda spark, sf_dir: _articles(spark, sf_dir).select(T.format_blog_post().alias("p")).select(
        "p.id", "p.title", "p.content", "p.original_title", F.size("p.categories").cast("bigint").alias("n_categories"), "p.published_at", "p.url", "p.is_published",
        F.col("p.seo_meta.title").alias("seo_title"))
)
query(
    "article_preview",
    f"{A} SELECT id, CASE WHEN length(content) > 1000 THEN content[1:1000] || '...' ELSE content END AS preview_1000, CASE WHEN length(content) > 500 THEN content[1:500] || '...' ELSE content END AS preview_500 FROM articles",
)(lambda spark, sf_dir: _articles(spark, sf_dir).select("id", T.article_preview("content").alias("preview_1000"), T.article_preview("content", 500).alias("preview_500")))
query("embedding_text", f"{A} SELECT id, coalesce(translated_title, title) || '. ' || coalesce(summary, '') || '. ' || coalesce(translated_content, content) AS body FROM articles")(
    lambda spark, sf_dir: _articles(spark, sf_dir).select("id", T.embedding_text().alias("body"))
)
