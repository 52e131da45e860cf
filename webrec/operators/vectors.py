"""Vector search over an embedding column.

Few query vectors (themes) travel inside the task code after a size check; the
corpus is scanned once. Distances are a matrix product per Arrow batch, several
times faster than a lambda per element, and top-k per query is cut on the map
side before anything is shuffled. Any number of queries goes block against
block (``vector_topk``).
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webrec.operators.dedup import top_per_key

MAX_QUERIES = 256
#: Vectors of a block of queries, of the corpus, and queries compared at once.
QUERY_ROWS = 4096
CORPUS_ROWS = 16384
TILE_ROWS = 128


def query_vectors(df: DataFrame, key: str, vector: str, limit: int = MAX_QUERIES) -> dict[str, list[float]]:
    """Read query vectors to the driver; refuses more than ``limit``."""
    rows = df.select(F.col(key).cast("string"), vector).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} query vectors")
    return {r[0]: [float(x) for x in r[1]] for r in sorted(rows, key=lambda r: r[0])}


def _matrix(batch: pd.Series) -> np.ndarray:
    return np.stack(batch.to_numpy()).astype("float64")


def squared_l2(vector: Column, queries: Sequence[Sequence[float]]) -> Column:
    """Array of squared distances to each query."""
    q = np.asarray(queries, dtype="float64")

    @F.pandas_udf("array<double>")
    def distances(batch: pd.Series) -> pd.Series:
        m = _matrix(batch)
        d = (m * m).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2 * (m @ q.T)
        return pd.Series(list(np.maximum(d, 0.0)))

    return distances(vector)


def cosine(vector: Column, query: Sequence[float]) -> Column:
    q = np.asarray(query, dtype="float64")
    q = q / np.linalg.norm(q)

    @F.pandas_udf("double")
    def similarity(batch: pd.Series) -> pd.Series:
        m = _matrix(batch)
        return pd.Series(m @ q / np.linalg.norm(m, axis=1))

    return similarity(vector)


def indexed(corpus: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    """Rows that have a vector of the right length."""
    return corpus.where(F.size(vector) == dim)


def vector_theme_topk(corpus: DataFrame, themes: Mapping[str, Sequence[float]], k: int = 5, max_distance: float = 1.2, vector: str = "embedding", row_id: str = "vec_id", keep: Sequence[str] = ()) -> DataFrame:
    """Per theme the 2k nearest, of those the ones nearer than the limit, first
    k; similarity = 1 - d/2. Farther rows are dropped before the ranking: a row
    within the limit has only nearer rows before it, so its place among all
    rows and among the near ones is the same."""
    if not themes:  # no theme has rows
        corpus, themes = corpus.limit(0), {"": [1.0]}
    names = sorted(themes)
    rows = indexed(corpus, len(themes[names[0]]), vector)
    near = F.transform(squared_l2(F.col(vector), [themes[n] for n in names]), lambda d, i: F.struct(i.alias("i"), d.alias("distance")))
    # filtered inside the generator: the distances are made once
    hits = rows.select(row_id, *keep, F.inline(F.filter(near, lambda n: n["distance"] < max_distance)))
    named = hits.withColumn("theme", F.get(F.array(*[F.lit(n) for n in names]), F.col("i"))).drop("i")
    top = top_per_key(named, ["theme"], [F.asc("distance"), F.asc(row_id)], k)
    return top.withColumn("similarity", 1 - F.col("distance") / 2)


def vector_similar(corpus: DataFrame, query: Sequence[float] | None, k: int = 5, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """Top-k of one query, no threshold; no rows without a query."""
    if query is None:
        corpus, query = corpus.limit(0), [1.0]
    d = F.get(squared_l2(F.col(vector), [query]), F.lit(0))
    return indexed(corpus, len(query), vector).select(row_id, d.alias("distance")).orderBy("distance", row_id).limit(k)


def _block_matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = pc.list_flatten(vectors).to_numpy()
    return flat.reshape(len(vectors), -1)


def _nearest(k: int, max_distance: float | None):
    """The k nearest of a block of the corpus to each query of a block. The
    product finds who may be among them, within its rounding; distances are
    then summed from the differences, so equal vectors tie exactly."""

    def product(queries: pa.Table, corpus: pa.Table) -> pa.Table:
        empty = pa.table({"query": queries["query"][:0], "id": corpus["id"][:0], "distance": pa.array([], pa.float64())})
        if not queries.num_rows or not corpus.num_rows:
            return empty
        q, c = _block_matrix(queries["v"]), _block_matrix(corpus["v"])
        place = np.empty(len(c), np.int64)
        place[pc.sort_indices(corpus["id"], null_placement="at_start").to_numpy()] = np.arange(len(c))
        norm = (c * c).sum(1)
        found = []
        for at in range(0, len(q), TILE_ROWS):
            tile = q[at : at + TILE_ROWS]
            own = (tile * tile).sum(1)
            d = own[:, None] + norm[None, :] - 2 * (tile @ c.T)
            slack = 1e-9 * (own + norm.max())
            limit = np.full(len(tile), np.inf) if max_distance is None else max_distance + slack
            if len(c) > k:
                limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1] + 2 * slack)
            for i, (row, most) in enumerate(zip(d, limit)):
                near = np.flatnonzero(row <= most)
                exact = ((c[near] - tile[i]) ** 2).sum(1)
                if max_distance is not None:
                    near, exact = near[exact < max_distance], exact[exact < max_distance]
                first = np.lexsort((place[near], exact))[:k]
                found.append((np.full(len(first), at + i), near[first], exact[first]))
        rows, hits, distance = (np.concatenate(x) for x in zip(*found))
        return pa.table({"query": queries["query"].take(pa.array(rows)), "id": corpus["id"].take(pa.array(hits)), "distance": distance})

    return product


def vector_topk(
    corpus: DataFrame, queries: DataFrame, k: int = 5, max_distance: float | None = None, query_id: str = "query_id", vector: str = "embedding", row_id: str = "vec_id",
    query_rows: int = QUERY_ROWS, corpus_rows: int = CORPUS_ROWS,
) -> DataFrame:
    """``query_id, rank, row_id, distance``: the k rows of least squared
    distance to each row of ``queries``, of those nearer than ``max_distance``
    where it is given; ties by row id. Query ids are unique.

    Both tables are dealt into blocks by position, so they should be stored: an
    input whose row order changes when a lost task runs again may move rows
    between blocks. Each block of queries meets
    each block of the corpus in one task, and only k rows per query leave it;
    the ranking merges them, again cut to k before its shuffle. No vector
    reaches the driver, two counts do. The smaller ``query_rows``, the oftener
    the corpus is sent: once per block of queries.

    Vectors that are null, empty or hold null or non-finite components neither
    ask nor answer; only vectors of one length are compared. Repeated rows
    answer each; an empty table gives no rows; other columns are not read."""

    def sound(df: DataFrame, key: str, name: str) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col(key).alias(name), v.alias("v")).where(good)

    def dealt(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        block = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_own)).cast("int")
        return df.withColumn(own, block).withColumn("dim", F.size("v")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    asked, rows = sound(queries, query_id, "query"), sound(corpus, row_id, "id")
    n_q, n_c = (max(1, -(-df.count() // size)) for df, size in ((asked, query_rows), (rows, corpus_rows)))
    pair = ["dim", "q_block", "c_block"]
    left, right = dealt(asked, "q_block", n_q, "c_block", n_c), dealt(rows, "c_block", n_c, "q_block", n_q)
    schema = f"query {asked.schema['query'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, distance double"
    hits = left.groupBy(*pair).cogroup(right.groupBy(*pair)).applyInArrow(_nearest(k, max_distance), schema)
    order = Window.partitionBy("query").orderBy("distance", "id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), "rank", F.col("id").alias(row_id), "distance")


def cosine_filter(rows: DataFrame, query: Sequence[float] | None, more_than: float = 0.3, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """Rows with cosine above the limit, best first; none without a query."""
    if query is None:
        rows, query = rows.limit(0), [1.0]
    # filtered inside the generator: a filter behind it would be pushed down
    # and run the similarity twice
    hit = F.filter(F.array(cosine(F.col(vector), query)), lambda s: s > more_than)
    scored = indexed(rows, len(query), vector).select(*[c for c in rows.columns if c != vector], F.explode(hit).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), row_id)


def vector_upsert(index: DataFrame, new: DataFrame, row_id: str = "vec_id") -> DataFrame:
    """Rows of ``new`` replace rows of the same id."""
    return index.join(new.select(row_id), row_id, "left_anti").unionByName(new)


def _versions(spark: SparkSession, path: str):
    """Hadoop path of the folder of manifests, and its file context."""
    fs = spark._jvm.org.apache.hadoop.fs
    return fs.Path(f"{path.rstrip('/')}/_versions"), fs.FileContext.getFileContext(fs.Path(path).toUri(), spark._jsc.hadoopConfiguration())


def vector_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the finished versions of a stored index, oldest first."""
    folder, files = _versions(spark, path)
    if not files.util().exists(folder):
        return []
    names = [s.getPath().getName() for s in files.util().listStatus(folder)]
    return sorted(int(n) for n in names if n.isdigit())


def vector_current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version of a stored index, or the one named. A reader keeps
    the version that it began with."""
    known = vector_versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no finished version at {path}")
    folder, _ = _versions(spark, path)
    manifest = f"{folder.toString()}/{known[-1] if version is None else version}"
    snapshot = spark.read.text(manifest).first()[0]
    return spark.read.parquet(f"{path.rstrip('/')}/{snapshot}")


def vector_rebuild(new: DataFrame, path: str) -> DataFrame:
    """Replace the stored index by the new rows. They go to a folder of their
    own; only when all are written is its name renamed into place as the next
    version, so a failed write leaves the old one current. Of two writers that
    began at one version, the second fails instead of undoing the first. Old
    versions stay, so ``new`` may be made from the stored rows."""
    spark = new.sparkSession
    number = max(vector_versions(spark, path), default=0) + 1
    snapshot = f"rows-{uuid.uuid4().hex}"
    new.write.parquet(f"{path.rstrip('/')}/{snapshot}")
    folder, files = _versions(spark, path)
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs
    draft = fs.Path(folder, f".{snapshot}")
    system = draft.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(draft, False)
    out.write(bytearray(snapshot.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    files.rename(draft, fs.Path(folder, str(number)), options)
    return vector_current(spark, path, number)


def vector_store_upsert(new: DataFrame, path: str, row_id: str = "vec_id") -> DataFrame:
    """``vector_upsert`` into the stored index, as its next version."""
    return vector_rebuild(vector_upsert(vector_current(new.sparkSession, path), new, row_id), path)


def vector_stats(index: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    return index.groupBy(label).agg(F.count("*").alias("vectors"), F.min(F.size(vector)).alias("min_dim"), F.max(F.size(vector)).alias("max_dim"))


def agg_theme_relevance(hits: DataFrame, title: str = "title", titles: int = 3) -> DataFrame:
    """Per theme: hits, mean similarity, top titles (hits are at most k per
    theme already)."""
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("s"), F.col(title).alias("t"))))
    return hits.groupBy("theme").agg(
        F.count("*").alias("hits"), F.avg("similarity").alias("mean_similarity"), ranked.alias("_r")
    ).select("theme", "hits", "mean_similarity", F.array_join(F.transform(F.slice("_r", 1, titles), lambda r: r["t"]), "; ").alias("top_titles"))
