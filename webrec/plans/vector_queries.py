"""Queries for vector search over the given embeddings."""

from pyspark.sql import functions as F

from webrec.operators import vectors as V
from webrec.plans.inputs import table
from webrec.plans.registry import query
from webrec.session import scratch


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings")


def _theme_rows(spark, sf_dir):
    """The first vector of each label stands for the theme."""
    e = _emb(spark, sf_dir)
    return e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding"))


def _themes(spark, sf_dir):
    return V.query_vectors(_theme_rows(spark, sf_dir), "label", "embedding")


def _one(spark, sf_dir):
    return V.query_vectors(_emb(spark, sf_dir).where("vec_id = 7"), "vec_id", "embedding").get("7")


_D = "list_sum([(a[i] - b[i]) * (a[i] - b[i]) for i in range(1, len(a) + 1)])"
_V = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS a FROM embeddings)"
_TH = f"WITH {_V}, t AS (SELECT CAST(label AS VARCHAR) AS theme, arg_min(a, vec_id) AS b FROM e GROUP BY label), d AS (SELECT theme, vec_id, label, {_D} AS d FROM e, t), " \
      "r AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY d, vec_id) AS rn FROM d), " \
      "h AS (SELECT *, row_number() OVER (PARTITION BY theme ORDER BY d, vec_id) AS k FROM r WHERE rn <= 10 AND d < 1.9)"
query("vector_theme_topk", f"{_TH} SELECT theme, vec_id, round(d, 6) AS distance, round(1 - d / 2, 6) AS similarity FROM h WHERE k <= 5")(
    lambda spark, sf_dir: V.vector_theme_topk(_emb(spark, sf_dir), _themes(spark, sf_dir), 5, 1.9)
    .select("theme", "vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"))
)
query(
    "agg_theme_relevance",
    f"{_TH} SELECT theme, count(*) AS hits, round(avg(1 - d / 2), 6) AS mean_similarity, string_agg('v' || vec_id, '; ' ORDER BY d, vec_id) FILTER (k <= 3) AS top_titles FROM h WHERE k <= 5 GROUP BY theme",
)(
    lambda spark, sf_dir: V.agg_theme_relevance(
        V.vector_theme_topk(_emb(spark, sf_dir), _themes(spark, sf_dir), 5, 1.9).withColumn("title", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    ).withColumn("mean_similarity", F.round("mean_similarity", 6))
)
_Q = f"WITH {_V}, q AS (SELECT a AS b FROM e WHERE vec_id = 7)"
query("vector_similar", f"{_Q} SELECT vec_id, round({_D}, 6) AS distance FROM e, q ORDER BY {_D}, vec_id LIMIT 10")(
    lambda spark, sf_dir: V.vector_similar(_emb(spark, sf_dir), _one(spark, sf_dir), 10).select("vec_id", F.round("distance", 6).alias("distance"))
)
query(
    "vector_topk",
    f"WITH {_V}, d AS (SELECT q.vec_id AS query_id, e.vec_id, list_sum([(e.a[i] - q.a[i]) * (e.a[i] - q.a[i]) for i in range(1, len(e.a) + 1)]) AS d FROM e, e AS q WHERE q.vec_id % 50 = 0), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM d) SELECT query_id, rank, vec_id, round(d, 6) AS distance FROM r WHERE rank <= 10",
)(
    lambda spark, sf_dir: V.vector_topk(_emb(spark, sf_dir), _emb(spark, sf_dir).where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 10)
    .select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("distance", 6).alias("distance"))
)
_COS = "list_sum([a[i] * b[i] for i in range(1, len(a) + 1)]) / (sqrt(list_sum([x * x for x in a])) * sqrt(list_sum([x * x for x in b])))"
query("cosine_filter", f"{_Q} SELECT vec_id, label, round({_COS}, 6) AS similarity FROM e, q WHERE {_COS} > 0.2")(
    lambda spark, sf_dir: V.cosine_filter(_emb(spark, sf_dir), _one(spark, sf_dir), 0.2).withColumn("similarity", F.round("similarity", 6))
)
query(
    "vector_upsert",
    "SELECT vec_id, CAST(CASE WHEN label < 4 THEN label + 100 ELSE label END AS BIGINT) AS label FROM embeddings UNION ALL SELECT vec_id + 10000000, 100 + label FROM embeddings WHERE label < 4",
)(
    lambda spark, sf_dir: (lambda e, n: V.vector_upsert(e, n.unionByName(n.withColumn("vec_id", F.col("vec_id") + 10000000))))(
        _emb(spark, sf_dir), _emb(spark, sf_dir).where("label < 4").withColumn("label", (F.col("label") + 100).cast("int"))
    ).select("vec_id", F.col("label").cast("bigint").alias("label"))
)
query("vector_rebuild", "SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings")(
    lambda spark, sf_dir: V.vector_rebuild(_emb(spark, sf_dir), scratch(spark, "vectors"))
    .select("vec_id", F.col("label").cast("bigint").alias("label"), F.size("embedding").cast("bigint").alias("dim"))
)


@query(
    "vector_store_upsert",
    "SELECT vec_id, CAST(CASE WHEN label < 4 THEN label + 100 ELSE label END AS BIGINT) AS label FROM embeddings UNION ALL SELECT vec_id + 10000000, 100 + label FROM embeddings WHERE label < 4",
)
def vector_store_upsert(spark, sf_dir):
    e, path = _emb(spark, sf_dir), scratch(spark, "vectors")
    V.vector_rebuild(e, path)
    changed = e.where("label < 4").withColumn("label", (F.col("label") + 100).cast("int"))
    V.vector_store_upsert(changed, path)
    V.vector_store_upsert(changed.withColumn("vec_id", F.col("vec_id") + 10000000), path)
    return V.vector_current(spark, path).select("vec_id", F.col("label").cast("bigint").alias("label"))


query("vector_stats", "SELECT CAST(label AS BIGINT) AS label, count(*) AS vectors, CAST(min(len(embedding)) AS BIGINT) AS min_dim, CAST(max(len(embedding)) AS BIGINT) AS max_dim FROM embeddings GROUP BY label")(
    lambda spark, sf_dir: V.vector_stats(_emb(spark, sf_dir)).select(*[F.col(c).cast("bigint").alias(c) for c in ("label", "vectors", "min_dim", "max_dim")])
)
